"""Which items go in when each takes two keys and an earlier item that went in holds either of them.

Items in order are edges between a left and a right key; inserting one by one keeps the first edge whose two ends are free.
That is a greedy matching, and it is found here without going through the items one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.session import set_aside

PLACE = "_place"


def earlier_rival(items: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Add how many earlier items share the ``keys`` (0, 1, or 2 for more) and the first of them.

    Only the two smallest places of a key are needed; both are mergeable minima, so a hot key is no long group.
    A null key is shared with nobody.
    """
    known = items.filter(" and ".join(f"{k} is not null" for k in keys))
    first = known.groupBy(*keys).agg(F.min(PLACE).alias("_first"))
    later = known.join(first, list(keys)).filter(F.col(PLACE) > F.col("_first"))
    second = later.groupBy(*keys).agg(F.min("_first").alias("_first"), F.min(PLACE).alias("_second"))
    found = items.join(second, list(keys), "left")
    # A key without a second item leaves both columns null.
    count = (
        F.when(F.col("_second").isNull() | (F.col(PLACE) == F.col("_first")), 0)
        .when(F.col(PLACE) == F.col("_second"), 1)
        .otherwise(2)
    )
    return found.withColumn(f"{name}_n", count).withColumn(f"{name}_up", F.col("_first")).drop("_first", "_second")


def settle_chains(items: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Places of items that surely go in.

    An item without an earlier rival goes in.  One with a single earlier rival goes in exactly if that one does not,
    so along a chain of single rivals the answer alternates: pointers double in each round until all point to the head
    of their chain, which takes rounds in the logarithm of its length.  Chains that hang on an item with more
    rivals stay open.
    """
    rivals = earlier_rival(earlier_rival(items, left, "l"), right, "r")
    total = F.col("l_n") + F.col("r_n")
    up = F.when(F.col("l_n") == 1, F.col("l_up")).when(F.col("r_n") == 1, F.col("r_up"))
    links = set_aside(
        rivals.select(
            PLACE,
            # Heads point to themselves; open says that the head has more than one rival.
            F.when(total == 1, up).otherwise(F.col(PLACE)).alias("up"),
            (total == 1).alias("odd"),
            (total > 1).alias("open"),
        )
    )
    while True:
        ahead = links.select(
            F.col(PLACE).alias("_at"), F.col("up").alias("_up"), F.col("odd").alias("_odd"), F.col("open").alias("_open")
        )
        jumped = set_aside(
            links.join(ahead, F.col("up") == F.col("_at")).select(
                PLACE, F.col("_up").alias("up"), (F.col("odd") != F.col("_odd")).alias("odd"),
                (F.col("open") | F.col("_open")).alias("open"), (F.col("up") != F.col("_up")).alias("moved"),
            )
        )
        links = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return links.filter("not open and not odd").select(PLACE)


def greedy_matching(items: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """The items (keys and ``_place``, each place once) that inserting one by one would keep.

    Each round settles every chain of single rivals at once and then drops the items whose keys are taken.  What is left had two
    rivals, one of which is settled now, so rounds follow the nesting of such forks, not the length of chains.
    """
    waiting, taken = items, None
    while True:
        now_in = set_aside(waiting.join(settle_chains(waiting, left, right), PLACE, "left_semi").select(*items.columns))
        taken = now_in if taken is None else set_aside(taken.unionByName(now_in))
        waiting = set_aside(_free(_free(waiting, now_in, left), now_in, right))
        if waiting.isEmpty():
            return taken


def _free(items: DataFrame, taken: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items none of whose ``keys`` is taken; a null key cannot be."""
    held = taken.select(*[F.col(k).alias(f"_t_{k}") for k in keys]).distinct()
    same: Column | None = None
    for k in keys:
        term = F.col(k) == F.col(f"_t_{k}")
        same = term if same is None else same & term
    return items.join(held, same, "left_anti")

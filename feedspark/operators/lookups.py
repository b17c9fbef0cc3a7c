"""Joins with tables that are usually small, and keys that may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.functions.identity import spread

# A table is broadcast only after counting that it has no more rows than this.
SMALL_ROWS = 10_000

SALTS = 16


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    setting = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(setting))


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` in a form that is certain to be broadcast, or ``None`` if it is not small.

    A table whose size Spark already knows to be under its limit is left alone.  For anything else
    the estimate says nothing (a distinct over a huge table may hold four rows), so up to
    ``rows + 1`` rows are fetched: if they are all there is, they become the broadcast table.
    """
    if estimated_bytes(df) <= broadcast_limit(df):
        return df
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def lookup(
    big: DataFrame, small: DataFrame, keys: Sequence[str], salt_from: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join a large table with a table of its sources, domains, models, ...

    A small table is broadcast and the large one is not shuffled.  Otherwise a key may still hold a
    large share of the rows, so the large side gets a salt from row-unique columns and the small
    side one copy per salt: one key is then shared by many tasks.
    """
    known = small_side(small)
    if known is not None:
        return big.join(known, list(keys), how)
    salted = big.withColumn("_salt", spread(SALTS, *[F.col(c) for c in salt_from]))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def present_in(big: DataFrame, small: DataFrame, keys: Sequence[str], rows: int = 10 * SMALL_ROWS) -> DataFrame:
    """Rows of ``big`` whose keys occur in ``small``; ``big`` is shuffled only if ``small`` is not small."""
    known = small_side(small, rows)
    return big.join(small if known is None else known, list(keys), "left_semi")

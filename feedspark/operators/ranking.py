"""Order-based building blocks that never hold a whole group in one task.

A plain window over ``partitionBy(group)`` sorts each group in a single task.  Groups here (one
source, one domain, the whole store) can hold a large share of all rows, so these helpers use
mergeable aggregates, Spark's partial top-k, or a range partitioning with per-range offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.session import set_aside

# A sorted cut up to this many rows runs as Spark's per-partition top-k; a larger one is ranked
# with offsets, so that no single task has to hold it.
TOP_K_ROWS = 10_000

# Spark keeps only the leading rows of each group per map task up to this rank
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT_ROWS = 1_000


def order_struct(*cols: Column) -> Column:
    """Columns compared left to right as one value (nulls first)."""
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ordered_rank(
    df: DataFrame, order: Sequence[Column], *, within: Sequence[str] = (), name: str = "rn", parts: int | None = None
) -> DataFrame:
    """Add the exact 1-based position of each row in ``order`` inside its ``within`` group.

    Rows are range-partitioned on (group, order) and numbered inside each range; a small table of
    range sizes gives each range its starting position.  ``order`` must be total.  The numbered
    rows are written once, because the range borders are sampled and both uses of them have to see
    the same ones.  Pass narrow rows and join payload back afterwards.
    """
    group = [F.col(c) for c in within]
    keys = [*[c.asc() for c in group], *order]
    numbered = set_aside(
        df.repartitionByRange(parts or shuffle_width(df), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_slot", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright("_slot", 33))
    )
    ranges = numbered.groupBy("_range", *within).agg(
        F.count(F.lit(1)).alias("_size"), F.min("_slot").alias("_first")
    )
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    placed = null_safe_join(numbered, starts, ["_range", *within])
    return placed.withColumn(name, F.col("_start") + F.col("_slot") - F.col("_first") + 1).drop(
        "_slot", "_range", "_first", "_start"
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also pairs null keys; the right-hand key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"_r_{k}"])
        condition = term if condition is None else condition & term
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def take_ordered(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in a total ``order``; nothing for ``n <= 0``."""
    n = max(int(n), 0)
    if n <= TOP_K_ROWS:
        return df.orderBy(*order).limit(n)
    return ordered_rank(df, order, name="_taken").filter(F.col("_taken") <= n).drop("_taken")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Exactly one row per key: the one with the smallest ``order`` columns.

    One mergeable aggregate.  Copies of a hot key collapse in each map task, so at most one row per
    key and task is shuffled, and the input is read once.
    """
    rest = [c for c in df.columns if c not in keys]
    place = order_struct(*[F.col(c) for c in order])
    first = F.min_by(F.struct(*rest), place).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def top_n_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: Column, largest_n: int
) -> DataFrame:
    """Keep up to ``n`` rows per group, where ``n`` may differ by group but not exceed ``largest_n``."""
    if largest_n <= 0:
        return df.limit(0)
    if largest_n <= GROUP_LIMIT_ROWS:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        ranked = df.withColumn("_rn", rank).filter(F.col("_rn") <= F.lit(largest_n))
    else:
        ranked = ordered_rank(df, order, within=group, name="_rn")
    return ranked.filter(F.col("_rn") <= n).drop("_rn")

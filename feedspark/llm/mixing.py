"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and size S wants every document T / S times.  The whole part is taken as it
is; the fraction is rounded by transferring mass between two documents at random until one of them
is in or out.  Mass is counted in words, so a transfer leaves the words of the source unchanged and
each document's expected share stays what it was.  Documents of a source are ordered by size, the
largest first, and folded block by block; the one document of a block that stays fractional goes to
the next round, so the rounds form a reduction tree and no task sees more than one block at a time.
The last document of a source is rounded at random; it is the only error against the target.

Random numbers are hashes of positions, so reruns agree.

Defined results.  A null or empty text has size 0 and takes nothing.  Null is a source of its own, the
last one.  A source without words has target 0.  Rows are handled one by one: repeated rows may be
taken a different number of times, and equal rows are interchangeable.  Rows without a document id are
mixed like others.  An empty table gives no row.  Only the columns asked for are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.functions.text import bind
from feedspark.llm.common import free_name, words_of
from feedspark.operators.ranking import null_safe_join, ordered_rank
from feedspark.session import set_aside

# The weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK = 64


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target: all words shared by weight, no source above ``most`` times its own.

    Sources reach their limit in the order of size per weight.  With the first k at their limits,
    the others share what is left; the first k for which nobody is above its limit is the answer.
    One row per source, so the windows here are as small as the list of weights.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
    by_limit = Window.orderBy(F.col("source_size") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, all_rows = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    left = F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    shared = F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    level = weighed.withColumn("_level", left / shared).withColumn(
        "_open", F.col("_level") * F.col("_weight") <= most * F.col("source_size")
    )
    reached = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(all_rows)
    limit = (most * F.col("source_size")).cast("double")
    return level.withColumn("_reached", reached).select(
        "source", "source_size", F.least(limit, F.coalesce(F.col("_reached") * F.col("_weight"), limit)).alias("target")
    )


def _uniform(seed: int, *parts: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11)
    return bits.cast("double") / float(2**53)


def _fold(level: int, seed: int) -> Column:
    """Fold the array ``units`` (rn, w, p): what is decided, and the one unit left over."""
    unit = "struct<rn: bigint, w: double, p: double>"
    empty = F.array().cast("array<struct<rn: bigint, up: boolean>>")

    def done(u: Column, up: bool) -> Column:
        return F.array(F.struct(u["rn"].alias("rn"), F.lit(up).alias("up")))

    def rest(u: Column, p: Column) -> Column:
        return F.struct(u["rn"].alias("rn"), u["w"].alias("w"), p.alias("p"))

    def step(state: Column, new: Column) -> Column:
        old = state["rest"]
        grow = F.least((1 - old["p"]) * old["w"], new["p"] * new["w"])
        shrink = F.least(old["p"] * old["w"], (1 - new["p"]) * new["w"])

        def choose(pair: Column) -> Column:
            a, b = pair["a"], pair["b"]
            first = F.when(a + b > 0, _uniform(seed, F.lit(level), F.col("source"), old["rn"], new["rn"]) * (a + b) < b)
            old_in = F.struct(rest(new, new["p"] - a / new["w"]).alias("rest"), done(old, True).alias("out"))
            new_out = F.struct(rest(old, old["p"] + a / old["w"]).alias("rest"), done(new, False).alias("out"))
            old_out = F.struct(rest(new, new["p"] + b / new["w"]).alias("rest"), done(old, False).alias("out"))
            new_in = F.struct(rest(old, old["p"] - b / old["w"]).alias("rest"), done(new, True).alias("out"))
            up = F.when((1 - old["p"]) * old["w"] <= new["p"] * new["w"], old_in).otherwise(new_out)
            down = F.when(old["p"] * old["w"] <= (1 - new["p"]) * new["w"], old_out).otherwise(new_in)
            return F.when(F.coalesce(first, F.lit(True)), up).otherwise(down)

        moved = bind(F.struct(grow.alias("a"), shrink.alias("b")), choose)
        return bind(
            moved, lambda m: F.struct(m["rest"].alias("rest"), F.concat(state["out"], m["out"]).alias("out"))
        )

    begin = F.struct(F.get(F.col("units"), 0).cast(unit).alias("rest"), empty.alias("out"))
    return F.aggregate(F.slice("units", 2, BLOCK), begin, step)


def round_units(units: DataFrame, seed: int) -> DataFrame:
    """Round ``units`` (source, rn from 1, w, p) within each source: source, rn, up."""
    decided: DataFrame | None = None
    level = 0
    while True:
        block = F.floor((F.col("rn") - 1) / BLOCK) if level == 0 else F.floor((F.col("turn") - 1) / BLOCK)
        place = "rn" if level == 0 else "turn"
        sorted_units = F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), "rn", "w", "p")))
        folded = set_aside(
            units.withColumn("block", block)
            .groupBy("source", "block")
            .agg(sorted_units.alias("units"))
            .withColumn("units", F.transform("units", lambda u: F.struct(u["rn"].alias("rn"), u["w"].alias("w"), u["p"].alias("p"))))
            .withColumn("folded", _fold(level, seed))
            .select("source", "block", "folded.rest", "folded.out")
        )
        out = folded.select("source", F.explode("out").alias("o")).select("source", "o.rn", "o.up")
        decided = out if decided is None else decided.unionByName(out)
        left = folded.select("source", (F.col("block") + 1).alias("turn"), "rest.rn", "rest.w", "rest.p")
        if left.agg(F.max("turn")).first()[0] in (None, 1):
            last = left.select(
                "source", "rn", (_uniform(seed, F.lit(-1), F.col("source"), F.col("rn")) < F.col("p")).alias("up")
            )
            return decided.unionByName(last)
        units, level = left, level + 1


def _with_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column that tells its rows apart: doc_id, or a number written beside the rows."""
    doubtful = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 or doc_id is null")
    if doubtful.isEmpty():
        return docs, "doc_id"
    key = free_name(docs.columns, "_row")
    return set_aside(docs.withColumn(key, F.monotonically_increasing_id())), key


def mix_sources(docs: DataFrame, keep: Sequence[str] = ("doc_id",), seed: int = 17) -> DataFrame:
    """``keep`` columns of each row, source, size, source_size, target, copies and words taken.

    Rows are ranked and rounded without their other columns, which meet the result in one join at the end.
    """
    extra = [c for c in dict.fromkeys(keep) if c not in ("source", "doc_id")]
    rows, key = _with_key(docs) if extra else (docs, "doc_id")
    names, source = list(dict.fromkeys(["doc_id", key])), F.col("source").cast("string").alias("source")
    size = F.size(words_of(F.col("text").cast("string"))).cast("long").alias("size")
    sized = set_aside(rows.select(*names, source, size))
    order = [F.col("size").desc(), *[F.col(c).asc_nulls_first() for c in names]]
    ranked = ordered_rank(sized, order, within=["source"], name="rn")
    wanted = set_aside(targets(sized))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    priced = null_safe_join(ranked, wanted, ["source"]).withColumn("_times", times)
    fraction = F.col("_times") - F.floor("_times")
    units = priced.filter((F.col("size") > 0) & (fraction > 0)).select(
        "source", "rn", F.col("size").cast("double").alias("w"), fraction.alias("p")
    )
    rounded = round_units(units, seed).filter("up")
    joined = null_safe_join(priced, rounded.withColumn("_up", F.lit(1)).drop("up"), ["source", "rn"], "left")
    copies = F.when(F.col("size") > 0, F.floor("_times") + F.coalesce(F.col("_up"), F.lit(0))).otherwise(0)
    results = ["size", "source_size", "target", "copies"]
    mixed = joined.withColumn("copies", copies.cast("long")).select(
        *names, "source", *results, (F.col("copies") * F.col("size")).alias("taken")
    )
    if extra:
        mixed = rows.select(key, *extra).join(mixed, key)
    return mixed.select("doc_id", "source", *extra, *results, "taken")

"""Quality rules: fixed base rules and robust multivariate outliers.

Each text that passes the base rules has a vector of transformed statistics: logarithm of the mean word length,
and the roots of the shares of symbols, capitals and other marks.  Per language and source the
minimum-covariance-determinant estimate of centre and scatter is sought from three deterministic
starts (quartiles, spatial signs, all rows) by concentration steps: keep the three quarters nearest to the
present estimate, estimate again, until the determinant falls no more.  The start with the smallest determinant
counts.  Texts whose Mahalanobis distance exceeds the chi-square cut-off are rejected.

Equal vectors count once per group, so copies of one text cannot take over the estimate, and the variances get a
floor, so a statistic that is nearly constant in a group does not reject its smallest departure.  Groups
with fewer than ``MIN_GROUP`` vectors use their language, languages with fewer use all texts, and a table with
fewer rejects nothing by this rule.

Everything is made of built-in expressions; the steps pass over a narrow table of vectors and
exchange one row per group.

Defined results.  A null or empty text has no words and fails the base rules.  Null languages and sources are
groups of their own.  Repeated rows get equal verdicts.  Rows without a document id are judged like others.  An
empty table gives no row.  Only the columns asked for are kept, whatever else the input holds.  Texts
of any length are judged whole, each within its own row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import bind
from feedspark.llm.common import words_of
from feedspark.session import set_aside

# The base rules.
SYMBOLS = r"[#*$%&|<>]"
A_WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED = 30

VECTOR = ("f0", "f1", "f2", "f3")
P = len(VECTOR)
MIN_GROUP = 50
# Share of the vectors that an estimate is made of, and the chance that a normal vector is rejected.
CORE = 0.75
REJECT = 1e-6
# Smallest standard deviation of each statistic.
FLOOR = 0.05
MOST_STEPS = 30
RANK_PRECISION = 10_000


def chi2_below(x: float, df: int) -> float:
    """P(chi-square <= x) for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))


def chi2_quantile(p: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, df) < p else (low, mid)
    return high


# The nearest three quarters have too small a scatter; this makes it right for normal vectors.
CONSISTENCY = CORE / chi2_below(chi2_quantile(CORE, P), P + 2)
CUTOFF = chi2_quantile(1 - REJECT, P)


def repeated_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more in the array."""

    def pairs(hashes: Column, step: int) -> Column:
        return F.transform(hashes, lambda x, i: F.xxhash64(x, F.get(hashes, i + step)))

    def of_windows(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))

        def marked(s: Column) -> Column:
            return F.filter(
                s,
                lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]),
            )

        places = F.sort_array(F.transform(bind(ordered, marked), lambda x: x["p"]))
        covered = F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"), p.alias("last")),
            lambda s: s["n"],
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(covered)

    def of_hashes(hashes: Column) -> Column:
        eight = bind(bind(pairs(hashes, 1), lambda h: pairs(h, 2)), lambda h: pairs(h, 4))
        return bind(F.slice(eight, F.lit(1), F.size(hashes) - (WINDOW - 1)), of_windows)

    hashed = bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)
    return F.when(F.size(words) > WINDOW, hashed).otherwise(0)


def statistics(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the base statistics, the verdict of the base rules, and the vector of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    def removed(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(A_WORD)))
    one = docs.select(
        *keep,
        bind(words_of(F.col("text").cast("string")), of_words).alias("_w"),
        removed(SYMBOLS).alias("n_symbols"),
        bind(lines, of_lines).alias("n_dup_lines"),
        removed(r"\p{Lu}+").alias("n_capitals"),
        removed(r"[^\p{L}\p{M}\p{N}\s]+").alias("n_marks"),
    )
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return (
        one.select(*keep, "_w.*", "n_symbols", "n_dup_lines", "n_capitals", "n_marks")
        .withColumn("base_failed", failed)
        .withColumns(
            {
                "f0": F.round(F.log(chars / F.greatest(F.col("n_words"), F.lit(1))), 6),
                "f1": F.round(F.sqrt(F.col("n_symbols") / chars), 6),
                "f2": F.round(F.sqrt(F.col("n_capitals") / chars), 6),
                "f3": F.round(F.sqrt(F.col("n_marks") / chars), 6),
            }
        )
    )


def _cholesky(fit: DataFrame, cov: dict[tuple[int, int], Column], key: Sequence[str]) -> DataFrame:
    """Lower triangle l_ij of the covariance with its floor, the logarithm of its determinant, and the means."""
    out = fit.withColumns({f"a_{i}_{j}": cov[i, j] + (FLOOR**2 if i == j else 0.0) for i in range(P) for j in range(i + 1)})
    for j in range(P):
        own = F.col(f"a_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(own, F.lit(1e-12))))
        out = out.withColumns(
            {
                f"l_{i}_{j}": (
                    F.col(f"a_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
                )
                / F.col(f"l_{j}_{j}")
                for i in range(j + 1, P)
            }
        )
    logdet = sum((F.log(f"l_{j}_{j}") for j in range(P)), F.lit(0.0)) * 2
    factors = [f"l_{i}_{j}" for i in range(P) for j in range(i + 1)]
    return out.select(*key, *[f"m_{i}" for i in range(P)], *factors, logdet.alias("logdet"))


def _fit(rows: DataFrame, key: Sequence[str], factor: float) -> DataFrame:
    """Mean and covariance of the rows of each key, from one mergeable aggregate."""
    sums = [F.avg(f"f{i}").alias(f"m_{i}") for i in range(P)]
    products = [F.avg(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"s_{i}_{j}") for i in range(P) for j in range(i + 1)]
    fit = rows.groupBy(*key).agg(*sums, *products)
    cov = {
        (i, j): (F.col(f"s_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor for i in range(P) for j in range(i + 1)
    }
    return _cholesky(fit, cov, key)


def _distance() -> Column:
    """Squared Mahalanobis distance of the row's vector: forward substitution with the triangle."""

    def solve(i: int, done: Column) -> Column:
        left = F.col(f"f{i}") - F.col(f"m_{i}")
        for k in range(i):
            left = left - F.col(f"l_{i}_{k}") * F.get(done, k)
        return left / F.col(f"l_{i}_{i}")

    def append(i: int) -> Callable[[Column], Column]:
        return lambda done: F.array_append(done, solve(i, done))

    z = F.array(solve(0, F.array()))
    for i in range(1, P):
        z = bind(z, append(i))
    return F.aggregate(z, F.lit(0.0), lambda s, v: s + v * v)


def _starts(vectors: DataFrame) -> DataFrame:
    """First estimates: quartiles, spatial signs, and all rows."""
    quartiles = [F.percentile_approx(f"f{i}", [0.25, 0.5, 0.75], RANK_PRECISION).alias(f"q_{i}") for i in range(P)]
    middle = set_aside(vectors.groupBy("grp").agg(*quartiles).select(
        "grp",
        *[F.get(f"q_{i}", 1).alias(f"m_{i}") for i in range(P)],
        *[F.sqrt(F.pow((F.get(f"q_{i}", 2) - F.get(f"q_{i}", 0)) / 1.349, 2) + FLOOR**2).alias(f"w_{i}") for i in range(P)],
    ))
    diagonal = {(i, j): F.pow(F.col(f"w_{i}"), 2) if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)}
    by_quartiles = _cholesky(middle, diagonal, ["grp"]).withColumn("start", F.lit(0))
    placed = vectors.join(middle, "grp")
    length = F.sqrt(sum((F.pow((F.col(f"f{i}") - F.col(f"m_{i}")) / F.col(f"w_{i}"), 2) for i in range(P)), F.lit(0.0)))
    signs = placed.withColumn("_len", F.greatest(length, F.lit(1e-9))).select(
        "grp", *[((F.col(f"f{i}") - F.col(f"m_{i}")) / F.col("_len")).alias(f"u{i}") for i in range(P)]
    )
    shape = signs.groupBy("grp").agg(
        *[(F.avg(F.col(f"u{i}") * F.col(f"u{j}")) * P).alias(f"s_{i}_{j}") for i in range(P) for j in range(i + 1)]
    )
    by_signs = _cholesky(
        shape.join(middle, "grp"), {(i, j): F.col(f"s_{i}_{j}") for i in range(P) for j in range(i + 1)}, ["grp"]
    ).withColumn("start", F.lit(1))
    by_all = _fit(vectors, ["grp"], 1.0).withColumn("start", F.lit(2))
    return by_quartiles.unionByName(by_signs).unionByName(by_all)


def estimate(vectors: DataFrame) -> DataFrame:
    """The estimate of each group of ``vectors`` (grp, f0..): means, triangle, logdet."""
    present = set_aside(_starts(vectors).withColumn("logdet", F.lit(float("inf"))).withColumn("falls", F.lit(True)))
    for _ in range(MOST_STEPS):
        # Starts that have come to their end stay as they are; a step reads the vectors of the others only.
        moving = present.filter("falls")
        scored = vectors.join(moving.drop("logdet", "falls"), "grp").withColumn("d2", _distance()).select("grp", "start", *VECTOR, "d2")
        reach = scored.groupBy("grp", "start").agg(F.percentile_approx("d2", CORE, RANK_PRECISION).alias("reach"))
        core = scored.join(reach, ["grp", "start"]).filter("d2 <= reach")
        fitted = _fit(core, ["grp", "start"], CONSISTENCY)
        before = moving.select("grp", "start", F.col("logdet").alias("_before"))
        falls = F.coalesce(F.col("logdet") < F.col("_before") - 1e-9, F.lit(False))
        stepped = fitted.join(before, ["grp", "start"]).withColumn("falls", falls).drop("_before")
        present = set_aside(stepped.unionByName(present.filter("not falls")))
        if present.filter("falls").isEmpty():
            break
    best = present.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("_best"))
    return present.join(best, "grp").filter("start = _best.start").drop("_best", "start", "falls")


def judge(docs: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row, its statistics, base_failed, distance and kept.

    ``keep`` must not hold columns named like a result.
    """
    named = docs.select(
        *keep,
        *[c for c in ("text",) if c not in keep],
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-")).alias("_lang"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("_source"),
    )
    rows = set_aside(statistics(named, [*keep, "_lang", "_source"]))
    passed = rows.filter(~F.col("base_failed")).select("_lang", "_source", *VECTOR).distinct()
    passed = set_aside(passed)
    pairs = passed.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_pair"))
    langs = passed.groupBy("_lang").agg(F.count(F.lit(1)).alias("_own"))
    everything = passed.agg(F.count(F.lit(1)).alias("_all"))
    level = (
        F.when(F.col("_pair") >= MIN_GROUP, F.concat_ws("\x1f", F.lit("s"), "_lang", "_source"))
        .when(F.col("_own") >= MIN_GROUP, F.concat_ws("\x1f", F.lit("l"), "_lang"))
        .when(F.lit(everything.first()[0] >= MIN_GROUP), F.lit("a"))
    )
    groups = set_aside(pairs.join(langs, "_lang").select("_lang", "_source", level.alias("grp")))
    # A language or the whole table is estimated from all its vectors, not from its small sources alone.
    wanted = groups.filter("grp is not null").select("grp").distinct()
    options = passed.select(
        *VECTOR,
        F.explode(
            F.array(
                F.concat_ws("\x1f", F.lit("s"), "_lang", "_source"), F.concat_ws("\x1f", F.lit("l"), "_lang"), F.lit("a")
            )
        ).alias("grp"),
    )
    vectors = set_aside(options.join(wanted, "grp", "left_semi").distinct())
    found = set_aside(estimate(vectors).drop("logdet"))
    judged = rows.join(groups, ["_lang", "_source"], "left").join(found, "grp", "left")
    far = F.when(F.col("m_0").isNotNull() & ~F.col("base_failed"), _distance())
    return judged.withColumn("distance", far).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)).alias("kept"),
    )

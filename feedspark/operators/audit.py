"""Event stamping, status reports and deterministic checks of texts and posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.redaction import redact
from feedspark.functions.text import WS, utrim
from feedspark.operators.rendering import HASHTAG
from feedspark.session import set_aside

# Post rules of the two domains with a written contract, and the reject vocabulary.
POST_RULES = {
    "ai": {"max_chars": 500, "min_tags": 2, "max_tags": 4, "required": "ai"},
    "football": {"max_chars": 800, "min_tags": 3, "max_tags": 6, "required": "football"},
}
MIN_WORDS = 10
REJECT_REASONS = {
    "ai": (
        "duplicate event in current batch",
        "outside technical AI scope",
        "insufficient technical details",
        "AI is only a secondary tool",
    ),
    "football": (
        "not men's professional football",
        "women's football",
        "youth football",
        "low significance",
    ),
}


def stamp_events(events: DataFrame, service: str, env: str = "local") -> DataFrame:
    """Fill in the service and environment where absent, then mask secrets everywhere."""
    stamped = events
    for name, value in (("service", service), ("env", env)):
        given = F.col(name) if name in events.columns else F.lit(None).cast("string")
        stamped = stamped.withColumn(name, F.coalesce(given, F.lit(value)))
    return redact(stamped)


def status_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("editorial_status").agg(F.count(F.lit(1)).alias("articles"))


def status_cube(articles: DataFrame) -> DataFrame:
    """Counts by domain, by status, by both and overall.

    ``summed_up`` tells a summed-up column (2: domain, 1: status, 3: both) from a null status.
    """
    return articles.cube("domain_id", "editorial_status").agg(
        F.count(F.lit(1)).alias("articles"), F.grouping_id().alias("summed_up")
    )


def word_count(text: Column) -> Column:
    trimmed = utrim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, rf"(?U){WS}+", -1)))


def short_texts(articles: DataFrame, minimum: int = MIN_WORDS) -> DataFrame:
    """Articles whose content has too few words to be decided on."""
    return articles.withColumn("words", word_count(F.col("content"))).filter(F.col("words") < minimum)


def post_checks(posts: DataFrame) -> DataFrame:
    """Rule by rule verdict on ``(domain_id, final_title, final_text)`` of domains with a contract."""
    tags = F.regexp_extract_all("final_text", F.lit(HASHTAG), 1)

    def rule(key: str) -> Column:
        picked = None
        for domain, rules in POST_RULES.items():
            hit = F.col("domain_id") == domain
            picked = F.when(hit, F.lit(rules[key])) if picked is None else picked.when(hit, F.lit(rules[key]))
        return picked

    checked = posts.filter(F.col("domain_id").isin(*POST_RULES)).withColumn("_tags", tags)
    return checked.withColumns(
        {
            "length_ok": F.length("final_text") <= rule("max_chars"),
            "tag_count_ok": F.size("_tags").between(rule("min_tags"), rule("max_tags")),
            "required_tag_ok": F.array_contains("_tags", rule("required")),
            "title_bold_ok": F.rlike("final_title", F.lit(r"(?s)^<b>.*</b>$")),
            "plain_text_ok": ~F.rlike("final_text", F.lit("<[^>]+>")),
        }
    ).drop("_tags")


def reject_reason_counts(rejected: DataFrame) -> DataFrame:
    """How often each reason occurs per domain and whether it belongs to the controlled list."""
    known = F.lit(False)
    for domain, reasons in REJECT_REASONS.items():
        known = known | ((F.col("domain_id") == domain) & F.col("rejection_reason").isin(*reasons))
    return (
        rejected.groupBy("domain_id", "rejection_reason")
        .agg(F.count(F.lit(1)).alias("articles"))
        .withColumn("in_vocabulary", F.coalesce(known, F.lit(False)))
    )


def similar_in_batch(batches: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs inside one batch whose word sets overlap by at least ``threshold`` (Jaccard).

    Candidates share one of each other's leading words in a fixed order (long words first, because
    they are rare): two sets that overlap enough must share a word among the first
    ``n - ceil(threshold * n) + 1``, so nothing is missed and no batch is paired with itself in
    full.  Candidates whose sizes, or whose words from the first shared one on, leave the threshold out of reach
    are dropped before any word set is moved.  A batch is bounded by the batch size.
    """
    tokens = F.array_distinct(F.split(F.lower(utrim(F.col("text"))), rf"(?U){WS}+", -1))
    rare_first = F.transform(
        F.sort_array(F.transform(tokens, lambda w: F.struct((-F.length(w)).alias("rank"), w.alias("w")))), lambda s: s["w"]
    )
    sets = set_aside(
        batches.join(texts, "article_id").select("batch_id", "article_id", rare_first.alias("words"))
    )
    t, n = F.lit(threshold), F.size("words")
    needed = F.ceil(n * t - F.lit(1e-9)).cast("int")
    leading = (
        sets.filter(n > 0)
        .select("batch_id", "article_id", n.alias("n"), F.posexplode(F.slice("words", 1, n - needed + 1)).alias("at", "word"))
        .select(F.xxhash64("batch_id", "word").alias("key"), "batch_id", "article_id", "n", "at")
    )
    # Both sides are one table, so that its rows are shuffled once.  Two words under one key only add a candidate.
    met = leading.alias("l").join(
        leading.alias("r"),
        (F.col("l.key") == F.col("r.key")) & (F.col("l.batch_id") == F.col("r.batch_id"))
        & (F.col("l.article_id") < F.col("r.article_id"))
        & (F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * t - F.lit(1e-9)),
    )
    # What two sets share starts at the first shared word in both.
    left_over = F.least(F.min("l.n") - F.min("l.at"), F.min("r.n") - F.min("r.at"))
    pairs = (
        met.groupBy(F.col("l.batch_id"), F.col("l.article_id"), F.col("r.article_id").alias("other_id"))
        .agg(left_over.alias("most"), (F.min("l.n") + F.min("r.n")).alias("both"))
        .filter(F.col("most") * (1 + t) >= F.col("both") * t - F.lit(1e-6))
        .select("batch_id", "article_id", "other_id")
    )
    shared = F.size(F.array_intersect("a.words", "b.words"))
    total = F.size("a.words") + F.size("b.words") - shared
    return (
        pairs.alias("p")
        .join(sets.alias("a"), (F.col("p.batch_id") == F.col("a.batch_id")) & (F.col("p.article_id") == F.col("a.article_id")))
        .join(sets.alias("b"), (F.col("p.batch_id") == F.col("b.batch_id")) & (F.col("p.other_id") == F.col("b.article_id")))
        .select("p.batch_id", "p.article_id", "p.other_id", shared.alias("shared"), total.alias("total"))
        .filter(F.col("shared") >= F.col("total") * t - F.lit(1e-9))
    )

"""Budgeted candidate batches and the request text sent for scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.functions.text import first_present, or_dash, utrim
from feedspark.operators.lookups import lookup
from feedspark.operators.ranking import TOP_K_ROWS, ordered_rank, take_ordered
from feedspark.operators.selection import awaiting_decision, with_source_name


def budgeted_candidates(
    articles: DataFrame, sources: DataFrame, domains: DataFrame, max_total: int | None
) -> DataFrame:
    """Keys of the undecided articles that fit the run budget, domains in configured order.

    Each domain takes what is left of the budget, which is the same as one ordered cut over all
    scored domains.  Only keys are ranked.  No budget (``None``) means every candidate.
    """
    scored = domains.filter("llm_enabled").select(F.col("id").alias("domain_id"), "domain_rank")
    waiting = with_source_name(
        awaiting_decision(articles).select("id", "domain_id", "source_id", "created_at", "ingest_seq"), sources
    )
    keys = lookup(waiting, scored, ["domain_id"], ["id"]).select(
        "id", "domain_id", "domain_rank", "created_at", "ingest_seq"
    )
    if max_total is None:
        return keys
    return take_ordered(keys, [F.col("domain_rank"), F.col("created_at"), F.col("ingest_seq")], max_total)


def plan_batches(
    articles: DataFrame, sources: DataFrame, domains: DataFrame, max_total: int | None, batch_size: int
) -> DataFrame:
    """``(batch_id, domain_id, batch_index, slot, article_id)``; a batch never crosses a domain."""
    size = max(int(batch_size), 1)
    keys = budgeted_candidates(articles, sources, domains, max_total)
    order = [F.col("created_at").asc(), F.col("ingest_seq").asc()]
    if max_total is not None and max_total <= TOP_K_ROWS:
        ranked = keys.withColumn("rn", F.row_number().over(Window.partitionBy("domain_id").orderBy(*order)))
    else:
        ranked = ordered_rank(keys, order, within=["domain_id"])
    index = (F.floor((F.col("rn") - 1) / size) + 1).cast("bigint")
    return ranked.select(
        F.concat_ws("#", "domain_id", index.cast("string")).alias("batch_id"),
        "domain_id",
        index.alias("batch_index"),
        (F.pmod(F.col("rn") - 1, F.lit(size)) + 1).cast("int").alias("slot"),
        F.col("id").alias("article_id"),
    )


def _filled(c: Column) -> Column:
    """Trimmed text, or a dash when nothing is left."""
    return or_dash(utrim(or_dash(c)))


def _published() -> Column:
    return first_present(F.col("published_at"), F.lit("-"))


def article_text() -> Column:
    """Request text for one article (expects the candidate columns)."""
    # The layout of a single-article request.
    return F.concat(
        F.lit("### ARTICLE\n\nSource: "), "source_name", F.lit("\nURL: "), "canonical_url",
        F.lit("\nPublished: "), _published(), F.lit("\n\nTitle:\n"), _filled(F.col("title")),
        F.lit("\n\nContent:\n"), _filled(F.col("content")), F.lit("\n"),
    )


def article_block() -> Column:
    """Block of one article inside a batch request."""
    # The layout of an article block.
    return F.concat(
        F.lit("### ARTICLE\n\nArticle-ID: "), "article_id", F.lit("\nSource: "), "source_name",
        F.lit("\nURL: "), "canonical_url", F.lit("\nPublished: "), _published(),
        F.lit("\n\nTitle:\n"), _filled(F.col("title")), F.lit("\n\nContent:\n"), _filled(F.col("content")),
        F.lit("\n\n### END ARTICLE\n"),
    )


def build_requests(batches: DataFrame, articles: DataFrame, sources: DataFrame, prompts: DataFrame) -> DataFrame:
    """One request per batch: the prompt of its domain and the blocks of its articles in slot order.

    A batch holds at most the configured batch size, so gathering its blocks is bounded.
    """
    payload = with_source_name(
        articles.select(
            F.col("id").alias("article_id"), "source_id", "canonical_url", "published_at", "title", "content"
        ),
        sources,
    )
    blocks = batches.join(payload, "article_id").select(
        "batch_id", "domain_id", "batch_index", F.struct("slot", article_block().alias("block")).alias("b")
    )
    texts = blocks.groupBy("batch_id", "domain_id", "batch_index").agg(
        F.sort_array(F.collect_list("b")).alias("bs")
    )
    joined = F.array_join(F.transform("bs", lambda b: b["block"]), "\n")
    return texts.select(
        "batch_id",
        "domain_id",
        "batch_index",
        F.size("bs").alias("articles"),
        F.concat(utrim(joined), F.lit("\n")).alias("input_text"),
    ).join(prompts.select("domain_id", "prompt"), "domain_id", "left")

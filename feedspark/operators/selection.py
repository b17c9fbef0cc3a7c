"""Choosing sources, domains and stored articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.operators.lookups import lookup
from feedspark.operators.ranking import take_ordered

LLM_COLUMNS = (
    "id", "domain_id", "source_id", "canonical_url", "title", "content", "published_at", "editorial_status",
    "source_name", "created_at", "ingest_seq",
)
READY_COLUMNS = (
    "id", "domain_id", "source_id", "canonical_url", "published_at", "final_title", "final_text", "final_language",
    "telegram_message_id", "telegram_channel", "telegram_published_at", "publication_status", "source_name",
    "llm_processed_at", "ingest_seq",
)
LOOKUP_COLUMNS = (
    "id", "domain_id", "source_id", "canonical_url", "title", "published_at", "publication_status",
    "telegram_message_id", "telegram_channel", "telegram_published_at", "source_name",
)


def active_sources(source_config: DataFrame, source_type: str = "rss") -> DataFrame:
    return source_config.filter((F.col("type") == source_type) & F.col("enabled"))


def select_domains(domains: DataFrame, wanted: Sequence[str] | None) -> DataFrame:
    """The wanted domains in configured order; none wanted means all, an unknown one is an error."""
    if not wanted:
        return domains
    asked = domains.sparkSession.createDataFrame([(w,) for w in set(wanted)], "id string")
    unknown = unknown_domains(domains, asked).first()["unknown_ids"]
    if unknown:
        raise ValueError(f"Unknown domain ids in config: {unknown}")
    return domains.join(asked, "id", "left_semi")


def unknown_domains(domains: DataFrame, asked: DataFrame) -> DataFrame:
    """Sorted list of asked ids that no domain has."""
    return asked.join(domains, "id", "left_anti").agg(F.sort_array(F.collect_set("id")).alias("unknown_ids"))


def in_domains(articles: DataFrame, domain_ids: Sequence[str]) -> DataFrame:
    return articles.filter(F.col("domain_id").isin(*domain_ids) if domain_ids else F.lit(False))


def with_source_name(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Add ``source_name``; an article without a stored source drops out.

    """
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    unique = "id" if "id" in articles.columns else "article_id"
    return lookup(articles, names, ["source_id"], [unique])


def awaiting_decision(articles: DataFrame) -> DataFrame:
    return articles.filter(F.col("editorial_status").isNull() | (F.col("editorial_status") == "NEW"))


def deliverable(articles: DataFrame) -> DataFrame:
    """READY, not delivered, and not excluded by an earlier publish step."""
    return articles.filter(F.col("editorial_status") == "READY").transform(undelivered)


def undelivered(articles: DataFrame) -> DataFrame:
    return articles.filter(
        (F.col("publication_status").isNull() | F.col("publication_status").isin("unpublished", "failed"))
        & F.col("telegram_message_id").isNull()
        & F.col("telegram_published_at").isNull()
    )


def oldest_first() -> list[Column]:
    return [F.col("created_at").asc(), F.col("ingest_seq").asc()]


def oldest_decision_first() -> list[Column]:
    return [F.col("llm_processed_at").asc_nulls_first(), F.col("ingest_seq").asc()]


def llm_candidates(articles: DataFrame, sources: DataFrame, domain_ids: Sequence[str], limit: int) -> DataFrame:
    """Undecided articles of the domains, oldest first."""
    rows = with_source_name(awaiting_decision(in_domains(articles, domain_ids)), sources)
    return take_ordered(rows.select(*LLM_COLUMNS), oldest_first(), limit)


def ready_for_publication(articles: DataFrame, sources: DataFrame, domain_ids: Sequence[str], limit: int) -> DataFrame:
    """Deliverable articles of the domains, oldest decision first."""
    rows = with_source_name(deliverable(in_domains(articles, domain_ids)), sources)
    return take_ordered(rows.select(*READY_COLUMNS), oldest_decision_first(), limit)


def unpublished_candidates(
    articles: DataFrame, sources: DataFrame, domain_ids: Sequence[str], limit: int
) -> DataFrame:
    """Undelivered articles whatever their editorial status, newest first."""
    rows = with_source_name(undelivered(in_domains(articles, domain_ids)), sources)
    newest_first = [F.col("created_at").desc(), F.col("ingest_seq").asc()]
    return take_ordered(rows.select(*LOOKUP_COLUMNS, "created_at", "ingest_seq"), newest_first, limit)


def articles_by_ids(articles: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles named in ``ids(id)``."""
    return with_source_name(articles.join(ids.select("id"), "id", "left_semi"), sources).select(*LOOKUP_COLUMNS)

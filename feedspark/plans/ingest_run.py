"""Landed fetches to new articles, events and source health."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.operators.entries import normalize_entries, select_entries
from feedspark.operators.health import fold_source_health, record_fetches
from feedspark.operators.ingest import FETCH, ingest, run_summary, source_summary
from feedspark.operators.ranking import order_struct
from feedspark.operators.selection import active_sources
from feedspark.session import set_aside
from feedspark.sources.config import feed_settings
from feedspark.sources.connectors import ReaderRegistry
from feedspark.sources.feeds import external_id, settle_fetches


@dataclass(frozen=True)
class IngestRun:
    articles: DataFrame
    events: DataFrame
    quarantine: DataFrame
    warnings: DataFrame
    per_source: DataFrame
    summary: DataFrame
    fetch_log: DataFrame


def ingest_run(
    attempts: DataFrame,
    source_config: DataFrame,
    domains: DataFrame,
    store: DataFrame,
    now: Column,
    *,
    strict: bool = False,
    source_type: str = "rss",
    readers: ReaderRegistry | None = None,
    stage: Callable[[DataFrame], DataFrame] = set_aside,
) -> IngestRun:
    """Everything one ingest run derives from recorded fetch attempts.

    Documents are parsed once: ``stage`` keeps the read documents, then the chosen entries for all the results below.
    """
    sources = active_sources(source_config, source_type)
    settings = feed_settings(sources)
    outcomes = settle_fetches(attempts, settings).join(
        sources.select(F.col("id").alias("source_id")), "source_id", "left_semi"
    )
    entries, warnings = (readers or ReaderRegistry(stage)).get(source_type)(outcomes.filter("ok"))
    kept = stage(select_entries(entries, settings, now))
    articles, bad = normalize_entries(kept, sources)
    stored, events, quarantine = ingest(articles, bad, store, domains, now, strict=strict)
    failed = outcomes.filter(~F.col("ok")).select("source_id")
    if strict:
        failed = failed.unionByName(quarantine.select("source_id"))
    per_source = source_summary(kept, stored, failed, sources)
    log = fetch_log(outcomes, kept, quarantine if strict else None, now)
    return IngestRun(stored, events, quarantine, warnings, per_source, run_summary(per_source), log)


def fetch_log(outcomes: DataFrame, kept: DataFrame, stopped: DataFrame | None, now: Column) -> DataFrame:
    """One row per fetch; in strict mode a source stopped by a bad item adds a failure after its success."""
    leading = kept.groupBy(*FETCH).agg(
        F.min_by(external_id(kept), order_struct(F.col("sort_key"), F.col("pos"))).alias("last_item_external_id")
    )
    status = F.when(F.col("ok"), F.lit(200)).otherwise(F.col("http_status"))
    fetched = outcomes.drop("body").join(leading, FETCH, "left").select(
        "source_id",
        now.alias("at"),
        "run_id",
        F.lit(0).cast("bigint").alias("seq"),
        "ok",
        status.cast("int").alias("http_status"),
        F.when(~F.col("ok"), F.col("error_message")).alias("error_message"),
        F.when(F.col("ok"), F.col("last_item_external_id")).alias("last_item_external_id"),
        F.lit(None).cast("string").alias("last_item_published_at"),
    )
    if stopped is None:
        return fetched
    broken = stopped.groupBy(*FETCH).agg(F.min("defect").alias("error_message")).select(
        *FETCH, "error_message", now.alias("at"), F.lit(1).cast("bigint").alias("seq"), F.lit(False).alias("ok")
    )
    return fetched.unionByName(broken, allowMissingColumns=True)


def refreshed_sources(sources: DataFrame, run: IngestRun, now: Column) -> DataFrame:
    return record_fetches(sources, fold_source_health(run.fetch_log), now)

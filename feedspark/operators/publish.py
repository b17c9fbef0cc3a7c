"""Choosing what to publish, when, and applying recorded delivery outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.functions.dates import is_fresh
from feedspark.functions.text import empty_to_null
from feedspark.operators.lookups import lookup
from feedspark.operators.ranking import TOP_K_ROWS, order_struct, ordered_rank, take_ordered
from feedspark.operators.selection import (
    READY_COLUMNS,
    deliverable,
    oldest_decision_first,
    with_source_name,
)
from feedspark.operators.state import decision_columns
from feedspark.sources.feeds import TRANSIENT_ERRORS

# Fixed value: how many eligible rows a single publish step looks at.
LOOKAHEAD = 50

# Fixed value: candidates fetched per allowed publication of a capped run.
OVERFETCH = 5


def channels(domains: DataFrame) -> DataFrame:
    """``(domain_id, channel)`` of the domains that can publish at all."""
    return domains.filter(empty_to_null(F.col("channel_id")).isNotNull()).select(
        F.col("id").alias("domain_id"), F.col("channel_id").alias("channel")
    )


def eligible(articles: DataFrame, sources: DataFrame, domains: DataFrame) -> DataFrame:
    """Deliverable articles of publishable domains, with their channel."""
    rows = with_source_name(deliverable(articles), sources).select(*READY_COLUMNS)
    return lookup(rows, channels(domains), ["domain_id"], ["id"])


def never_failed() -> Column:
    return F.col("publication_status").isNull() | (F.col("publication_status") == "unpublished")


def next_to_publish(articles: DataFrame, sources: DataFrame, domains: DataFrame) -> DataFrame:
    """The one article a publish step takes: the first never-failed row among the leading 50."""
    leading = take_ordered(eligible(articles, sources, domains), oldest_decision_first(), LOOKAHEAD)
    return take_ordered(leading.filter(never_failed()), oldest_decision_first(), 1)


def release_schedule(
    articles: DataFrame, sources: DataFrame, domains: DataFrame, start: Column, interval_seconds: int
) -> DataFrame:
    """When a worker that publishes one article per tick would release each eligible article.

    Failed rows stay in the queue; once 50 of them lie ahead, nothing behind them is ever reached.
    """
    step = max(int(interval_seconds), 1)
    queue = eligible(articles, sources, domains).select(
        "id", "domain_id", "channel", "publication_status", "llm_processed_at", "ingest_seq"
    )
    place = order_struct(F.col("llm_processed_at"), F.col("ingest_seq"))
    stuck = take_ordered(queue.filter(~never_failed()), oldest_decision_first(), LOOKAHEAD).agg(
        F.when(F.count(F.lit(1)) == LOOKAHEAD, F.max(place)).alias("wall")
    )
    wall = stuck.scalar()
    reachable = queue.filter(never_failed() & (wall.isNull() | (place < wall)))
    ranked = ordered_rank(reachable, oldest_decision_first(), name="release_no")
    offset = (F.col("release_no") - 1) * F.lit(step * 1_000_000)
    return ranked.select(
        "id", "domain_id", "channel", "release_no",
        F.timestamp_micros(F.unix_micros(start) + offset).alias("release_at"),
    )


def outcome_action(permanent: str) -> Column:
    """Action of a recorded outcome; ``permanent`` names the action of a lasting failure."""
    return (
        F.when(F.col("ok"), F.lit("published"))
        .when(F.col("error_type").isin(*TRANSIENT_ERRORS), F.lit("retry"))
        .otherwise(F.lit(permanent))
    )


def _delivery_decisions(rows: DataFrame, action: Column) -> DataFrame:
    """Decisions of rows that carry ``id``, ``channel`` and the outcome columns."""
    sent = action == "published"
    failed = action.isin("retry", "abort", "fail")
    return rows.select(
        *decision_columns(
            article_id=F.col("id"),
            action=action,
            stage=F.when(failed, F.lit("PUBLISH")),
            message=F.when(failed, F.col("error_message")).when(action == "skip_old", F.col("stale_reason")),
            message_id=F.when(sent, F.col("message_id")),
            channel=F.when(sent, F.col("channel")),
            delivered_at=F.when(sent, F.col("attempted_at")),
        )
    )


def publish_decisions(posts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Single-step publishing: a lasting failure takes the article out of the queue."""
    tried = posts.select("id", "channel").join(
        outcomes.drop("channel").withColumnRenamed("article_id", "id"), "id"
    )
    return _delivery_decisions(tried.withColumn("stale_reason", F.lit(None).cast("string")), outcome_action("abort"))


def capped_publish(
    articles: DataFrame,
    sources: DataFrame,
    domains: DataFrame,
    outcomes: DataFrame,
    cap: int,
    max_age_hours: int,
    now: Column,
) -> DataFrame:
    """Rows a capped run handles, in order, with their ``action``.

    Candidates are five times the cap.  Stale rows are skipped and failures do not count, so the
    run ends with the cap-th success.
    """
    rows = take_ordered(eligible(articles, sources, domains), oldest_decision_first(), OVERFETCH * max(cap, 0))
    tried = rows.join(
        outcomes.drop("channel").withColumnRenamed("article_id", "id"), "id", "left"
    )
    fresh = is_fresh(F.col("published_at"), now, F.lit(max_age_hours))
    action = F.when(~fresh, F.lit("skip_old")).when(F.col("ok").isNotNull(), outcome_action("fail"))
    acted = tried.withColumn("action", action).withColumn(
        "stale_reason", F.lit(f"older_than_{max_age_hours}_hours_or_unparseable")
    ).filter(F.col("action").isNotNull())
    hit = F.col("action") == "published"
    if OVERFETCH * cap <= TOP_K_ROWS:
        before = Window.orderBy(*oldest_decision_first()).rowsBetween(Window.unboundedPreceding, -1)
        done = F.coalesce(F.sum(hit.cast("int")).over(before), F.lit(0))
        return acted.withColumn("_done", done).filter(F.col("_done") < cap).drop("_done")
    place = order_struct(F.col("llm_processed_at"), F.col("ingest_seq"))
    last = take_ordered(acted.filter(hit), oldest_decision_first(), cap).agg(
        F.when(F.count(F.lit(1)) == cap, F.max(place)).alias("wall")
    ).scalar()
    return acted.filter(last.isNull() | (place <= last))


def capped_decisions(handled: DataFrame) -> DataFrame:
    """State changes of a capped run; here a lasting failure stays eligible."""
    return _delivery_decisions(handled, F.col("action"))


def publish_stats(handled: DataFrame) -> DataFrame:
    return handled.agg(
        F.count_if(F.col("action") == "published").alias("published_articles"),
        F.count_if(F.col("action").isin("retry", "fail", "abort")).alias("publication_failures"),
        F.count_if(F.col("action") == "skip_old").alias("skipped_old_articles"),
    )

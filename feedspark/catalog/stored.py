"""Selection from stored articles, state changes, audit trail and status repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.catalog.views import (
    LANGS,
    OUTCOMES_CTE,
    STORED_WITH,
    domains,
    instant,
    ntz,
    outcomes,
    sources,
    stored,
    table,
)
from feedspark.operators.audit import status_counts, status_cube
from feedspark.operators.publish import publish_decisions, release_schedule
from feedspark.operators.publish import capped_decisions, capped_publish, eligible, next_to_publish, publish_stats
from feedspark.operators.selection import (
    articles_by_ids,
    awaiting_decision,
    in_domains,
    ready_for_publication,
    unpublished_candidates,
    with_source_name,
)
from feedspark.operators.state import apply_decisions, decision_events, latest_events
from feedspark.operators.selection import llm_candidates
from feedspark.sources.tables import evolve_articles

NOW = "2024-03-01 00:00:00"
FRESH_NOW = "2024-01-05 00:00:00"


def scoring_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every undecided article of two domains, with its source name."""
    rows = with_source_name(awaiting_decision(in_domains(stored(spark, d), ["en", "fr"])), sources(spark, d))
    return rows.select("id", "domain_id", "source_name", "title", "published_at", "editorial_status")


SCORING_CANDIDATES_SQL = f"""{STORED_WITH}
SELECT id, domain_id, source_name, title, published_at, editorial_status FROM candidates
WHERE domain_id IN ('en', 'fr')
"""


def oldest_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = llm_candidates(stored(spark, d), sources(spark, d), ["en", "fr", "de"], 100)
    return rows.select("id", "domain_id", "source_name", F.md5("content").alias("content_md5"))


OLDEST_CANDIDATES_SQL = f"""{STORED_WITH}
SELECT id, domain_id, source_name, md5(content) AS content_md5 FROM candidates
WHERE domain_id IN ('en', 'fr', 'de') ORDER BY created_at, ingest_seq LIMIT 100
"""


def publish_eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = eligible(stored(spark, d), sources(spark, d), domains(spark, d))
    return rows.select("id", "domain_id", "channel", "source_name", "publication_status",
                       ntz("llm_processed_at").alias("llm_processed_at"))


PUBLISH_ELIGIBLE_SQL = f"""{STORED_WITH}
SELECT id, domain_id, channel, source_name, publication_status, llm_processed_at FROM eligible
"""


def publish_queue_head(spark: SparkSession, d: str) -> DataFrame:
    rows = ready_for_publication(stored(spark, d), sources(spark, d), list(LANGS), 25)
    return rows.select("id", "source_name", "final_title", F.md5("final_text").alias("text_md5"))


PUBLISH_QUEUE_SQL = f"""{STORED_WITH}
SELECT s.id, src.name AS source_name, final_title, md5(final_text) AS text_md5
FROM stored s JOIN sources src ON src.id = s.source_id
WHERE s.editorial_status = 'READY' AND (s.publication_status IS NULL OR s.publication_status IN ('unpublished', 'failed'))
  AND s.telegram_message_id IS NULL AND s.telegram_published_at IS NULL
ORDER BY llm_processed_at NULLS FIRST, ingest_seq LIMIT 25
"""


def unpublished_newest(spark: SparkSession, d: str) -> DataFrame:
    rows = unpublished_candidates(stored(spark, d), sources(spark, d), list(LANGS), 40)
    return rows.select("id", "domain_id", "source_name", "publication_status")


UNPUBLISHED_NEWEST_SQL = f"""{STORED_WITH}
SELECT s.id, s.domain_id, src.name AS source_name, s.publication_status
FROM stored s JOIN sources src ON src.id = s.source_id
WHERE (s.publication_status IS NULL OR s.publication_status IN ('unpublished', 'failed'))
  AND s.telegram_message_id IS NULL AND s.telegram_published_at IS NULL
ORDER BY created_at DESC, ingest_seq LIMIT 40
"""


def article_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(spark, d)
    wanted = rows.filter(F.col("ingest_seq") % 4 == 1).select("id").union(
        spark.createDataFrame([("absent",)], "id string")
    )
    return articles_by_ids(rows, sources(spark, d), wanted).select("id", "title", "source_name", "publication_status")


ARTICLE_LOOKUP_SQL = f"""{STORED_WITH}
SELECT s.id, s.title, src.name AS source_name, s.publication_status
FROM stored s JOIN sources src ON src.id = s.source_id WHERE s.ingest_seq % 4 = 1
"""


def publish_next(spark: SparkSession, d: str) -> DataFrame:
    return next_to_publish(stored(spark, d), sources(spark, d), domains(spark, d)).select("id", "channel", "source_name")


PUBLISH_NEXT_SQL = f"""{STORED_WITH}
SELECT id, channel, source_name FROM (
  SELECT * FROM eligible ORDER BY llm_processed_at NULLS FIRST, ingest_seq LIMIT 50)
WHERE publication_status IS NULL OR publication_status = 'unpublished'
ORDER BY llm_processed_at NULLS FIRST, ingest_seq LIMIT 1
"""


def publish_schedule(spark: SparkSession, d: str) -> DataFrame:
    rows = release_schedule(
        stored(spark, d), sources(spark, d), domains(spark, d), instant("2024-02-01 00:00:00"), 180
    )
    return rows.select("id", "channel", "release_no", ntz("release_at").alias("release_at"))


PUBLISH_SCHEDULE_SQL = f"""{STORED_WITH}, queue AS (
  SELECT *, coalesce(sum(CASE WHEN publication_status = 'failed' THEN 1 ELSE 0 END) OVER (
    ORDER BY llm_processed_at NULLS FIRST, ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stuck
  FROM eligible),
released AS (
  SELECT *, row_number() OVER (ORDER BY llm_processed_at NULLS FIRST, ingest_seq) AS release_no
  FROM queue WHERE stuck < 50 AND (publication_status IS NULL OR publication_status = 'unpublished'))
SELECT id, channel, release_no, TIMESTAMP '2024-02-01' + to_seconds(180 * (release_no - 1)) AS release_at FROM released
"""

_CAP, _HOURS = 12, 92


def _capped(spark: SparkSession, d: str) -> DataFrame:
    return capped_publish(
        stored(spark, d), sources(spark, d), domains(spark, d), outcomes(spark, d), _CAP, _HOURS, instant(FRESH_NOW)
    )


CAPPED_CTE = f"""{OUTCOMES_CTE}, taken AS (
  SELECT e.*, o.ok, o.message_id, o.error_type, o.error_message,
    published_ts IS NOT NULL AND published_ts >= TIMESTAMP '{FRESH_NOW}' - to_hours({_HOURS}) AS fresh
  FROM (SELECT * FROM eligible ORDER BY llm_processed_at NULLS FIRST, ingest_seq LIMIT {5 * _CAP}) e
  JOIN outcomes o ON o.article_id = e.id),
acted AS (
  SELECT *, CASE WHEN NOT fresh THEN 'skip_old' WHEN ok THEN 'published' WHEN error_type = 'ConnectTimeout' THEN 'retry'
    ELSE 'fail' END AS action FROM taken),
handled AS (SELECT * FROM (
  SELECT *, coalesce(sum(CASE WHEN action = 'published' THEN 1 ELSE 0 END) OVER (
    ORDER BY llm_processed_at NULLS FIRST, ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM acted) WHERE done < {_CAP})"""


def publish_capped(spark: SparkSession, d: str) -> DataFrame:
    return capped_decisions(_capped(spark, d)).select(
        "article_id", "action", "stage", "message", "message_id", "channel", ntz("delivered_at").alias("delivered_at")
    )


PUBLISH_CAPPED_SQL = f"""{STORED_WITH}, {CAPPED_CTE}
SELECT id AS article_id, action, CASE WHEN action IN ('retry', 'fail') THEN 'PUBLISH' END AS stage,
  CASE WHEN action IN ('retry', 'fail') THEN error_message
    WHEN action = 'skip_old' THEN 'older_than_{_HOURS}_hours_or_unparseable' END AS message,
  CASE WHEN action = 'published' THEN message_id END AS message_id,
  CASE WHEN action = 'published' THEN channel END AS channel,
  CASE WHEN action = 'published' THEN TIMESTAMP '2024-02-01' END AS delivered_at
FROM handled
"""


def publish_stats_query(spark: SparkSession, d: str) -> DataFrame:
    return publish_stats(_capped(spark, d))


PUBLISH_STATS_SQL = f"""{STORED_WITH}, {CAPPED_CTE}
SELECT count(CASE WHEN action = 'published' THEN 1 END) AS published_articles,
  count(CASE WHEN action IN ('retry', 'fail') THEN 1 END) AS publication_failures,
  count(CASE WHEN action = 'skip_old' THEN 1 END) AS skipped_old_articles FROM handled
"""


def publish_all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(spark, d)
    posts = eligible(rows, sources(spark, d), domains(spark, d))
    return rows, publish_decisions(posts, outcomes(spark, d))


def publish_transitions(spark: SparkSession, d: str) -> DataFrame:
    """The whole store after every eligible article got its recorded outcome."""
    rows, decisions = publish_all(spark, d)
    return apply_decisions(rows, decisions, instant(NOW)).select(
        "id", "lifecycle_state", "publication_status", "publication_error", "telegram_message_id",
        ntz("telegram_published_at").alias("telegram_published_at"), "editorial_status",
        ntz("status_updated_at").alias("status_updated_at"), "last_error_stage", "last_error_message",
        ntz("last_error_at").alias("last_error_at"), ntz("updated_at").alias("updated_at"),
    )


_TRIED_CTE = f"""{OUTCOMES_CTE}, tried AS (
  SELECT e.id AS tried_id, e.channel, o.*, CASE WHEN ok THEN 'published' WHEN error_type = 'ConnectTimeout' THEN 'retry'
    ELSE 'abort' END AS action FROM eligible e JOIN outcomes o ON o.article_id = e.id)"""

PUBLISH_TRANSITIONS_SQL = f"""{STORED_WITH}, {_TRIED_CTE}
SELECT s.id, CASE WHEN action = 'published' THEN 'published' ELSE lifecycle_state END AS lifecycle_state,
  CASE action WHEN 'published' THEN 'published' WHEN 'retry' THEN 'unpublished' WHEN 'abort' THEN 'failed'
    ELSE publication_status END AS publication_status,
  CASE WHEN action IN ('retry', 'abort') THEN error_message END AS publication_error,
  CASE WHEN action = 'published' THEN message_id ELSE telegram_message_id END AS telegram_message_id,
  CASE WHEN action = 'published' THEN TIMESTAMP '2024-02-01' ELSE telegram_published_at END AS telegram_published_at,
  CASE action WHEN 'published' THEN 'PUBLISHED' WHEN 'abort' THEN 'ERROR' ELSE editorial_status END AS editorial_status,
  CASE WHEN action IN ('published', 'abort') THEN TIMESTAMP '{NOW}' ELSE created_at END AS status_updated_at,
  CASE WHEN action IN ('retry', 'abort') THEN 'PUBLISH' END AS last_error_stage,
  CASE WHEN action IN ('retry', 'abort') THEN error_message END AS last_error_message,
  CASE WHEN action IN ('retry', 'abort') THEN TIMESTAMP '{NOW}' END AS last_error_at,
  CASE WHEN action IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE created_at END AS updated_at
FROM stored s LEFT JOIN tried t ON t.tried_id = s.id
"""


def publish_events(spark: SparkSession, d: str) -> DataFrame:
    _, decisions = publish_all(spark, d)
    return decision_events(decisions, instant(NOW)).select(
        "article_id", "event_type", ntz("created_at").alias("created_at"), "details_json", "error_message"
    )


PUBLISH_EVENTS_SQL = f"""{STORED_WITH}, {_TRIED_CTE}
SELECT tried_id AS article_id, CASE action WHEN 'published' THEN 'PUBLISHED' ELSE 'ERROR' END AS event_type,
  TIMESTAMP '{NOW}' AS created_at,
  CASE WHEN action = 'published' THEN '{{"telegram_message_id":' || message_id || ',"telegram_channel":"' || channel
    || '"}}' END AS details_json,
  CASE WHEN action = 'abort' THEN error_message END AS error_message
FROM tried WHERE action <> 'retry'
"""


def status_counts_query(spark: SparkSession, d: str) -> DataFrame:
    return status_counts(stored(spark, d))


STATUS_COUNTS_SQL = f"""{STORED_WITH}
SELECT editorial_status, count(*) AS articles FROM stored GROUP BY editorial_status
"""


def status_cube_query(spark: SparkSession, d: str) -> DataFrame:
    return status_cube(stored(spark, d))


STATUS_CUBE_SQL = f"""{STORED_WITH}
SELECT domain_id, editorial_status, count(*) AS articles, GROUPING(domain_id, editorial_status) AS summed_up FROM stored
GROUP BY CUBE (domain_id, editorial_status)
"""


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    """The events table as audit trail: one row per event, the user standing for the article."""
    trail = table(spark, d, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("a"), "user_id").alias("article_id"),
        "event_type",
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("created_at"),
        F.col("props").alias("details_json"),
        F.when(F.col("event_type") == "error", F.lit("boom")).alias("error_message"),
    )
    return latest_events(trail)


LATEST_EVENT_SQL = """
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS back FROM events)
SELECT 'a' || user_id AS article_id, event_id AS seq, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS created_at,
  props AS details_json, CASE WHEN event_type = 'error' THEN 'boom' END AS error_message
FROM ranked WHERE back = 1
"""


def schema_repair(spark: SparkSession, d: str) -> DataFrame:
    """An older store without the newer columns, and one that only lacks statuses."""
    rows = stored(spark, d)
    narrow = evolve_articles(
        rows.filter(F.col("ingest_seq") % 2 == 0).drop(
            "editorial_status", "status_updated_at", "publication_error", "last_error_stage", "final_language"
        ),
        instant(NOW),
    )
    wide = evolve_articles(rows.filter(F.col("ingest_seq") % 2 == 1), instant(NOW))
    return narrow.unionByName(wide).select(
        "id", "editorial_status", ntz("status_updated_at").alias("status_updated_at"), "final_language",
        "publication_status", "telegram_message_id",
    )


SCHEMA_REPAIR_SQL = f"""{STORED_WITH}
SELECT id, CASE WHEN publication_status = 'published' OR telegram_message_id IS NOT NULL
    OR telegram_published_at IS NOT NULL THEN 'PUBLISHED'
    ELSE coalesce(CASE WHEN ingest_seq % 2 = 1 THEN editorial_status END, 'NEW') END AS editorial_status,
  CASE WHEN ingest_seq % 2 = 1 THEN created_at ELSE TIMESTAMP '{NOW}' END AS status_updated_at,
  CAST(NULL AS VARCHAR) AS final_language, publication_status, telegram_message_id
FROM stored
"""

QUERIES = {
    "scoring_candidates": (scoring_candidates, SCORING_CANDIDATES_SQL),
    "oldest_candidates": (oldest_candidates, OLDEST_CANDIDATES_SQL),
    "publish_eligible": (publish_eligible, PUBLISH_ELIGIBLE_SQL),
    "publish_queue_head": (publish_queue_head, PUBLISH_QUEUE_SQL),
    "unpublished_newest": (unpublished_newest, UNPUBLISHED_NEWEST_SQL),
    "article_lookup": (article_lookup, ARTICLE_LOOKUP_SQL),
    "publish_next": (publish_next, PUBLISH_NEXT_SQL),
    "publish_schedule": (publish_schedule, PUBLISH_SCHEDULE_SQL),
    "publish_capped": (publish_capped, PUBLISH_CAPPED_SQL),
    "publish_stats": (publish_stats_query, PUBLISH_STATS_SQL),
    "publish_transitions": (publish_transitions, PUBLISH_TRANSITIONS_SQL),
    "publish_events": (publish_events, PUBLISH_EVENTS_SQL),
    "status_counts": (status_counts_query, STATUS_COUNTS_SQL),
    "status_cube": (status_cube_query, STATUS_CUBE_SQL),
    "latest_event": (latest_event, LATEST_EVENT_SQL),
    "schema_repair": (schema_repair, SCHEMA_REPAIR_SQL),
}

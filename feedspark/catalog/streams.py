"""The whole ingest over landed documents, in batch and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.catalog import editorial, feeds
from feedspark.catalog.feeds import LOST_ITEM, feed_documents
from feedspark.catalog.stored import PUBLISH_TRANSITIONS_SQL, PUBLISH_SCHEDULE_SQL, publish_all
from feedspark.catalog.views import OUTCOMES_CTE, domains, instant, ntz, outcomes, sources, stored, table
from feedspark.operators.health import record_fetches
from feedspark.operators.parsing import NO_ANSWER
from feedspark.operators.state import apply_decisions, current_states
from feedspark.plans.ingest_run import ingest_run
from feedspark.schemas import ARTICLES, FETCH_ATTEMPTS, RESPONSES, STATES
from feedspark.session import use_checkpoint_dir
from feedspark.sources.connectors import recorded_deliverer
from feedspark.sources.tables import (
    follow_states, stored_articles, stored_fetch_log, stored_quarantine, stored_states, stored_warnings, write_epoch,
)
from feedspark.streaming.editorial import ANSWERS, TICKS, asked_requests, start_editorial
from feedspark.streaming.health import kept_health, start_health
from feedspark.streaming.state_store import changed_states, kept_states
from feedspark.streaming.workers import start_ingest, start_publisher

NOW = "2024-01-10 00:00:00"


def landed(spark: SparkSession, d: str) -> DataFrame:
    """Rendered feed documents as successful fetches; every third document is fetched twice."""
    values = {
        "source_id": F.col("source_id"),
        "run_id": F.concat(F.lit("r"), "again"),
        "attempt": F.lit(1),
        "http_status": F.lit(200),
        "body": F.col("body"),
    }
    number = F.substring("source_id", 5, 12).cast("bigint")
    runs = F.when(number % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return feed_documents(spark, d).withColumn("again", F.explode(runs)).select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FETCH_ATTEMPTS.fields]
    )


def feed_sources(spark: SparkSession, d: str) -> DataFrame:
    """One configured source per rendered document."""
    number = F.floor(F.col("page_id") / 10).cast("int")
    name = F.concat(F.lit("feed"), "number")
    return table(spark, d, "pages").select(number.alias("number")).distinct().select(
        F.lit("news").alias("domain_id"), F.lit(0).alias("domain_rank"), F.col("number").alias("source_rank"),
        name.alias("id"), F.lit("rss").alias("type"), name.alias("name"),
        F.lit("https://ex.org/").alias("url"), F.lit(True).alias("enabled"),
        F.create_map(F.lit("retry_attempts"), F.lit("1")).alias("config"),
    )


def news_domain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("news", True)], "id string, llm_enabled boolean")


def ingest_documents(spark: SparkSession, d: str) -> DataFrame:
    """One batch run: scan, rules, normalize, deduplicate, insert."""
    fetches = landed(spark, d)
    empty = spark.createDataFrame([], ARTICLES)
    run = ingest_run(fetches, feed_sources(spark, d), news_domain(spark), empty, instant(NOW))
    return _shown(run.articles)


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The same documents landed as files and followed by the ingest stream, in several micro-batches."""
    return _shown(stored_articles(spark, follow(spark, d, landed(spark, d))))


def new_base(spark: SparkSession) -> str:
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/feedspark-{uuid.uuid4().hex}"


def follow(spark: SparkSession, d: str, fetches: DataFrame) -> str:
    """The folder of the store that the ingest stream made of ``fetches``, in several micro-batches."""
    base = new_base(spark)
    files = max(4, 2 * spark.sparkContext.defaultParallelism)
    fetches.repartition(files, "source_id", "run_id").write.parquet(f"{base}/landing")
    query = start_ingest(
        spark, f"{base}/landing", f"{base}/store", f"{base}/progress", feed_sources(spark, d),
        news_domain(spark), clock=lambda: instant(NOW), files_per_batch=files // 2, once=True,
    )
    query.awaitTermination()
    return f"{base}/store"


def stream_warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warnings that the ingest stream stored."""
    return stored_warnings(spark, follow(spark, d, landed(spark, d))).drop("step", "epoch")


def stream_fetch_log(spark: SparkSession, d: str) -> DataFrame:
    """The fetch log that the ingest stream stored."""
    log = stored_fetch_log(spark, follow(spark, d, landed(spark, d))).drop("step", "epoch")
    return log.withColumn("at", ntz("at"))


def stream_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Items that the ingest stream set aside: here those of documents that have lost their links."""
    body = F.regexp_replace("body", r"(?s)<link[^>]*/>|<link[^>]*>.*?</link>", "")
    fetches = landed(spark, d).filter("run_id = 'r0'").withColumn("body", body)
    return stored_quarantine(spark, follow(spark, d, fetches)).drop("step", "epoch", "id")


# -- the state log and its keyed store --------------------------------------------------------------

TICKS_RUN = 3
FOLLOWED_IN = 3
LATER = "2024-03-01 00:00:00"


def files_in_parts(landed_rows: DataFrame, parts: int) -> int:
    """Files per micro-batch that follow ``landed_rows`` in about ``parts`` micro-batches, however many files there are."""
    return max(1, -(-len(landed_rows.inputFiles()) // parts))


def keyed_states(spark: SparkSession, d: str) -> DataFrame:
    """Every article's newest state, from the keyed store that followed a log of several epochs.

    An epoch of older rows lands last and changes nothing.
    """
    base = new_base(spark)
    rows, decisions = publish_all(spark, d)
    states = rows.select(*STATES.names)
    write_epoch(states, base, "states", "ingest", 0)
    changed = apply_decisions(states, decisions, instant(LATER), only_changed=True)
    for k in range(2):
        write_epoch(changed.filter(F.col("ingest_seq") % 2 == k), base, "states", "publish", k)
    stale = states.withColumns({"editorial_status": F.lit("ERROR"), "updated_at": instant("2023-01-01 00:00:00")})
    write_epoch(stale, base, "states", "publish", 2)
    log = changed_states(follow_states(spark, base, files_per_batch=files_in_parts(stored_states(spark, base), FOLLOWED_IN)))
    query = log.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{base}/progress")
    query.trigger(availableNow=True).start().awaitTermination()
    return _state_columns(kept_states(spark, f"{base}/progress"))


def _state_columns(states: DataFrame) -> DataFrame:
    return states.select(
        "id", "lifecycle_state", "publication_status", "publication_error", "telegram_message_id",
        ntz("telegram_published_at").alias("telegram_published_at"), "editorial_status",
        ntz("status_updated_at").alias("status_updated_at"), "last_error_stage", "last_error_message",
        ntz("last_error_at").alias("last_error_at"), ntz("updated_at").alias("updated_at"),
    )


def publish_worker(spark: SparkSession, d: str) -> DataFrame:
    """All states after the worker ran for ``TICKS_RUN`` ticks, started anew for each: one article is released per tick."""
    base = new_base(spark)
    write_epoch(stored(spark, d).select(*STATES.names), base, "states", "ingest", 0)
    known = outcomes(spark, d)
    # A timeout would be tried again for ever, as its recorded outcome stays the same.
    lasting = F.when(F.col("ok"), F.lit(None)).otherwise(F.lit("RuntimeError")).cast("string")
    deliver = recorded_deliverer(known.withColumn("error_type", lasting))
    for _ in range(TICKS_RUN):
        worker = start_publisher(
            None, base, f"{base}/progress", sources(spark, d), domains(spark, d), deliver, clock=lambda: instant(LATER), once=True
        )
        worker.awaitTermination()
    return _state_columns(current_states(stored_states(spark, base)))


_RELEASED_CTE = PUBLISH_SCHEDULE_SQL.split("SELECT id, channel, release_no", 1)[0]
PUBLISH_WORKER_SQL = f"""{_RELEASED_CTE}, {OUTCOMES_CTE}, tried AS (
  SELECT r.id AS tried_id, o.*, CASE WHEN ok THEN 'published' ELSE 'abort' END AS action
  FROM released r JOIN outcomes o ON o.article_id = r.id WHERE release_no <= {TICKS_RUN})
{PUBLISH_TRANSITIONS_SQL[PUBLISH_TRANSITIONS_SQL.rindex("SELECT s.id"):]}"""


def stream_source_health(spark: SparkSession, d: str) -> DataFrame:
    """Sources after their health ran along with the fetch log, which landed in three epochs, not in order of time."""
    base = new_base(spark)
    log = feeds.fetch_log(spark, d)
    for k in range(3):
        write_epoch(log.filter(F.col("seq") % 3 == k), base, "fetch_log", "ingest", k)
        if k:
            start_health(spark, base, f"{base}/progress", once=True).awaitTermination()
    health = kept_health(spark, f"{base}/progress")
    return feeds.source_health_columns(record_fetches(feeds.supplier_sources(spark, d), health, instant(feeds.NOW)))


# -- requests and answers as streams ----------------------------------------------------------------
#
# Requests land in two slices, an hour is the limit.  Of 13 batches one is answered after three hours, of 11 one never, and of 5
# one twice.

_SLICES, _LIMIT = 2, 3600


def stream_decisions(spark: SparkSession, d: str) -> DataFrame:
    """States that the editorial stream logged, run anew after each slice landed."""
    base = new_base(spark)
    no = F.substring("batch_id", 2, 12).cast("bigint")
    asked_at = F.timestamp_micros(
        F.unix_micros(instant("2024-02-01 00:00:00")) + (no % _SLICES * 7200 + no % 60 * 60) * 1_000_000
    )
    late = no % 13 == 4
    after = F.when(late, 10_800).otherwise(300).cast("bigint")
    missing = {f.name: F.lit(None).cast(f.dataType) for f in RESPONSES.fields}
    given = editorial.answers(spark, d)
    answered = given.select(*[F.col(c) if c in given.columns else missing[c].alias(c) for c in RESPONSES.names]).withColumn(
        "answered_at", F.timestamp_micros(F.unix_micros(asked_at) + after * 1_000_000)
    ).filter(no % 11 != 3).select(*ANSWERS.names)
    requests = asked_requests(editorial.batches(spark, d), editorial.waiting(spark, d).select(*STATES.names), asked_at)

    def land(rows: DataFrame, folder: str) -> None:
        rows.write.mode("append").parquet(f"{base}/{folder}")

    def run() -> None:
        ticks = spark.readStream.schema(TICKS).parquet(f"{base}/ticks")
        start_editorial(
            spark, f"{base}/requests", f"{base}/answers", base, f"{base}/progress", domains(spark, d),
            clock=lambda: instant(editorial.NOW), ticks=ticks, limit_seconds=_LIMIT, once=True,
        ).awaitTermination()

    for k in range(_SLICES):
        land(requests.filter(no % _SLICES == k), "requests")
        land(answered.filter((no % _SLICES == k) & ~late), "answers")
        if k == _SLICES - 1:
            land(answered.filter(late), "answers")
            land(answered.filter(no % 5 == 0), "answers")
        land(spark.createDataFrame([], TICKS), "ticks")
        run()
    land(spark.range(1).select(instant("2024-02-03 00:00:00").alias("at")), "ticks")
    run()
    return editorial.decided(current_states(stored_states(spark, base)))


STREAM_DECISIONS_SQL = f"""WITH {editorial.EXPECTED_CTE.replace(" AS (", "_all AS (", 1).replace("FROM asked)", "FROM asked_all)")},
met AS (
  SELECT * REPLACE (CASE WHEN lost THEN 'request_failed' ELSE outcome END AS outcome, CASE WHEN lost THEN '{NO_ANSWER}' ELSE message END
    AS message)
  FROM (SELECT *, doc_id // 20 % 11 = 3 OR doc_id // 20 % 13 = 4 AS lost FROM parsed))
{editorial.BATCH_APPLY_SQL[editorial.BATCH_APPLY_SQL.rindex("SELECT article_id AS id"):].replace("FROM parsed", "FROM met")}"""


def _shown(articles: DataFrame) -> DataFrame:
    return articles.select(
        "id", "source_id", "canonical_url", "source_item_external_id", "title", F.md5("content").alias("content_md5"),
        "published_at", "editorial_status", ntz("created_at").alias("created_at"),
    )


INGEST_SQL = f"""
SELECT sha256('news|' || url) AS id, 'feed' || page_id // 10 AS source_id, url AS canonical_url,
  'p' || page_id AS source_item_external_id, ltrim(regexp_extract(html, '<title>([^<]*)</title>', 1)) || chr(160) || '!' AS title,
  md5(html) AS content_md5,
  CASE WHEN page_id // 10 % 3 = 1 THEN '2024-01-01T10:00:00Z' ELSE 'Mon, 01 Jan 2024 10:00:00 GMT' END AS published_at,
  'NEW' AS editorial_status, TIMESTAMP '2024-01-10' AS created_at
FROM pages WHERE NOT ({LOST_ITEM})
"""

_FETCHES = """(SELECT page_id, page_id // 10 AS n, again FROM pages JOIN (VALUES (0), (1)) v(again) ON again = 0 OR page_id // 10 % 3 = 0)"""

STREAM_WARNINGS_SQL = f"""
SELECT DISTINCT 'feed' || n AS source_id, 'r' || again AS run_id, 'feed_parse_warning' AS event, CAST(1 AS BIGINT) AS lost
FROM {_FETCHES} WHERE n % 7 = 3
"""

STREAM_FETCH_LOG_SQL = f"""
SELECT 'feed' || n AS source_id, TIMESTAMP '2024-01-10' AS at, 'r' || again AS run_id, CAST(0 AS BIGINT) AS seq, true AS ok,
  200 AS http_status, CAST(NULL AS VARCHAR) AS error_message,
  CASE WHEN n % 7 <> 3 OR count(*) > 1 THEN 'p' || min(page_id) END AS last_item_external_id,
  CAST(NULL AS VARCHAR) AS last_item_published_at
FROM {_FETCHES} GROUP BY n, again
"""

STREAM_QUARANTINE_SQL = f"""
SELECT 'feed' || page_id // 10 AS source_id, 'r0' AS run_id, page_id % 10 AS pos, 'missing_link' AS defect
FROM pages WHERE NOT ({LOST_ITEM})
"""

QUERIES = {
    "ingest_documents": (ingest_documents, INGEST_SQL),
    "stream_ingest": (stream_ingest, INGEST_SQL),
    "stream_warnings": (stream_warnings, STREAM_WARNINGS_SQL),
    "stream_fetch_log": (stream_fetch_log, STREAM_FETCH_LOG_SQL),
    "stream_quarantine": (stream_quarantine, STREAM_QUARANTINE_SQL),
    "keyed_states": (keyed_states, PUBLISH_TRANSITIONS_SQL),
    "publish_worker": (publish_worker, PUBLISH_WORKER_SQL),
    "stream_source_health": (stream_source_health, feeds.SOURCE_HEALTH_SQL),
    "stream_decisions": (stream_decisions, STREAM_DECISIONS_SQL),
}

"""Continuous ingest of landed fetches, and a publisher that releases one article per tick.

Deduplication never forgets: every micro-batch is checked against the stored ids, not against
bounded streaming state.  Each micro-batch writes its own epoch folder, so a replay after a lost
driver or executor replaces what it wrote before.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedspark.operators.ingest import insert_events
from feedspark.plans.ingest_run import ingest_run
from feedspark.plans.publish_run import publish_once
from feedspark.schemas import ARTICLES, EVENTS, FETCH_ATTEMPTS, FETCH_LOG, QUARANTINE, STATES, WARNINGS
from feedspark.sources.connectors import Deliverer
from feedspark.sources.tables import (
    follow_states,
    stored_articles,
    without_epoch,
    write_epoch,
)
from feedspark.streaming.state_store import changed_states, roll_queue

Clock = Callable[[], Column]


def ingest_batch(
    attempts: DataFrame, epoch: int, root: str, source_config: DataFrame, domains: DataFrame, now: Column
) -> None:
    """Insert what a micro-batch of landed fetches adds to the store under ``root``.

    What it sets aside, its warnings and its fetch log are stored beside it.
    """
    spark = attempts.sparkSession
    known = without_epoch(stored_articles(spark, root), "ingest", epoch)

    steps = itertools.count()

    def stage(rows: DataFrame) -> DataFrame:
        target = f"{root}/staging/ingest-{next(steps)}"
        rows.write.mode("overwrite").parquet(target)
        return spark.read.schema(rows.schema).parquet(target)

    run = ingest_run(attempts, source_config, domains, known.select(*ARTICLES.names), now, stage=stage)
    target = write_epoch(run.articles, root, "articles", "ingest", epoch)
    written = spark.read.schema(ARTICLES).parquet(target)
    write_epoch(written.select(*STATES.names), root, "states", "ingest", epoch)
    write_epoch(insert_events(written, now), root, "events", "ingest", epoch)
    write_epoch(run.quarantine.select(*QUARANTINE.names), root, "quarantine", "ingest", epoch)
    write_epoch(run.warnings.select(*WARNINGS.names), root, "warnings", "ingest", epoch)
    write_epoch(run.fetch_log.select(*FETCH_LOG.names), root, "fetch_log", "ingest", epoch)


def start_ingest(
    spark: SparkSession, landing: str, root: str, checkpoint: str, source_config: DataFrame, domains: DataFrame,
    clock: Clock = F.current_timestamp, *, files_per_batch: int | None = None, once: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Follow the folder of landed fetch attempts (Parquet)."""
    reader = spark.readStream.schema(FETCH_ATTEMPTS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def step(batch: DataFrame, epoch: int) -> None:
        ingest_batch(batch, epoch, root, source_config, domains, clock())

    writer = reader.parquet(landing).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def publish_next(
    queue: DataFrame, epoch: int, root: str, sources: DataFrame, domains: DataFrame, deliver: Deliverer, now: Column
) -> None:
    """Publish the next article of the ``queue`` and log its new state; article content is not read."""
    run = publish_once(queue, sources, domains, deliver, now)
    write_epoch(run.changed.select(*STATES.names), root, "states", "publish", epoch)
    write_epoch(run.events.select(*EVENTS.names), root, "events", "publish", epoch)


def start_publisher(
    ticks: DataFrame | None, root: str, checkpoint: str, sources: DataFrame, domains: DataFrame, deliver: Deliverer,
    clock: Clock = F.current_timestamp, *, interval_seconds: int = 60, files_per_batch: int | None = None,
    once: bool = False,
) -> StreamingQuery:
    """One article per micro-batch, at most one per interval, from a queue that follows the state log.

    A keyed store holds each article's newest state, so a micro-batch reads only what the log gained: what it
    published last is among that, and a micro-batch whose log did not grow does not run.  ``ticks`` (for example Spark's rate
    source) make it run all the same, which is needed where a delivery may come back without an outcome.
    """
    spark = sources.sparkSession
    log = follow_states(spark, root, files_per_batch)
    if ticks is not None:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields]
        log = log.unionByName(ticks.select(*nothing))

    def step(batch: DataFrame, epoch: int) -> None:
        queue = roll_queue(batch.sparkSession, root, epoch, batch)
        publish_next(queue, epoch, root, sources, domains, deliver, clock())

    writer = changed_states(log).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", checkpoint)
    period = f"{max(int(interval_seconds), 1)} seconds"
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=period)).start()

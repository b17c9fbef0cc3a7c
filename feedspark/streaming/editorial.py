"""The editorial step as a stream: requests meet their answers, and one that gets none in time ends as failed.

A landed request carries the states of the articles it asks about, so deciding them reads neither the store nor the
log.  Requests and answers are one keyed stream by batch; an event-time timer per request ends the wait.  Whether an
answer counts follows from its own time alone, not from the order or the micro-batch in which it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from feedspark.operators.decisions import batch_decisions, batch_summary, match_results
from feedspark.operators.state import apply_decisions, decision_events
from feedspark.schemas import EVENTS, RESPONSES, STATES
from feedspark.sources.tables import write_epoch
from feedspark.streaming.state_store import packed, unpacked, use_keyed_store

Clock = Callable[[], Column]

# A landed request: the packed states of its articles (at most a batch of them).
REQUESTS = T.StructType(
    [
        T.StructField("batch_id", T.StringType()),
        T.StructField("asked_at", T.TimestampType()),
        T.StructField("articles", T.ArrayType(T.StringType())),
    ]
)
ANSWERS = T.StructType([*RESPONSES.fields, T.StructField("answered_at", T.TimestampType())])
TICKS = T.StructType([T.StructField("at", T.TimestampType())])

# How long a settled batch, or an answer nobody asked for, is remembered, in limits.
MEMORY = 10


def asked_requests(batches: DataFrame, states: DataFrame, asked_at: Column) -> DataFrame:
    """Requests to land: ``batches`` (batch_id, article_id) with the states of their articles."""
    rows = states.select(F.col("id").alias("article_id"), packed(STATES).alias("row"))
    joined = batches.select("batch_id", "article_id").join(rows, "article_id")
    gathered = joined.groupBy("batch_id").agg(F.sort_array(F.collect_list("row")).alias("articles"))
    return gathered.withColumn("asked_at", asked_at).select(*REQUESTS.names)


class Meeting(StatefulProcessor):
    """Hands on each request once: with its answer, or without one when its time is over."""

    def __init__(self, limit_ms: int) -> None:
        self._limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._asked = handle.getValueState("asked", "at long, row string")
        self._answer = handle.getValueState("answer", "at long, row string")
        self._done = handle.getValueState("done", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        if self._done.exists():
            for _ in rows:
                pass
            return
        asked = self._asked.get() if self._asked.exists() else None
        answer = self._answer.get() if self._answer.exists() else None
        fresh = False
        for r in rows:
            found = (r["at"], r["row"])
            if r["kind"] == "asked" and asked is None:
                asked, fresh = found, True
            elif r["kind"] == "answer" and (answer is None or found < tuple(answer)):
                answer, fresh = found, True
        if asked is None:
            if answer is not None and fresh:
                self._answer.update(tuple(answer))
                self._handle.registerTimer(answer[0] + MEMORY * self._limit)
            return
        deadline = asked[0] + self._limit
        if answer is not None and answer[0] <= deadline:
            yield self._settle(key, asked, answer[1], deadline)
        elif fresh:
            # An answer after the deadline is none; the timer below ends the wait.
            self._asked.update(tuple(asked))
            self._handle.registerTimer(deadline)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self._asked.exists() and not self._done.exists():
            asked = self._asked.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= asked[0] + self._limit:
                yield self._settle(key, asked, None, asked[0] + self._limit)
        elif self._done.exists():
            if expiredTimerInfo.getExpiryTimeInMs() >= self._done.get()[0]:
                self._done.clear()
        else:
            self._answer.clear()

    def _settle(self, key: Any, asked: Any, answer: str | None, deadline: int) -> Row:
        self._asked.clear()
        self._answer.clear()
        forget = deadline + MEMORY * self._limit
        self._done.update((forget,))
        self._handle.registerTimer(forget)
        return Row(batch_id=key[0], asked=asked[1], answer=answer)

    def close(self) -> None:
        pass


def settled_requests(requests: DataFrame, answers: DataFrame, ticks: DataFrame | None, limit_seconds: int, delay: str) -> DataFrame:
    """Streams of requests and answers -> (batch_id, asked, answer), each request once.

    ``delay`` is how late rows may land.  ``ticks`` (at) let time pass when nothing else lands.
    """
    use_keyed_store(requests.sparkSession)
    asked = requests.select(
        "batch_id", F.col("asked_at").alias("at_time"), F.lit("asked").alias("kind"),
        F.to_json("articles").alias("row"),
    )
    answered = answers.select(
        "batch_id", F.col("answered_at").alias("at_time"), F.lit("answer").alias("kind"), packed(RESPONSES).alias("row")
    )
    rows = asked.unionByName(answered)
    if ticks is not None:
        none = F.lit(None).cast("string")
        rows = rows.unionByName(ticks.select(F.lit("").alias("batch_id"), F.col("at").alias("at_time"), F.lit("tick").alias("kind"), none.alias("row")))
    timed = rows.filter("batch_id is not null and at_time is not null").withWatermark("at_time", delay)
    keyed = timed.select("batch_id", "at_time", F.unix_millis("at_time").alias("at"), "kind", "row")
    return keyed.groupBy("batch_id").transformWithState(
        Meeting(1000 * int(limit_seconds)), "batch_id string, asked string, answer string", "Append", "EventTime"
    )


def decide_batch(settled: DataFrame, epoch: int, root: str, domains: DataFrame, now: Column) -> None:
    """Write the states, events and counts of the requests that a micro-batch settled."""
    spark = settled.sparkSession
    staged = f"{root}/staging/editorial"
    settled.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema("batch_id string, asked string, answer string").parquet(staged)
    if rows.isEmpty():
        return
    asked = rows.select("batch_id", F.explode(F.from_json("asked", "array<string>")).alias("row"))
    states = asked.select(*unpacked(F.col("row"), STATES))
    field = {name: F.get_json_object("row", f"$.{name}") for name in ("id", "domain_id")}
    batches = asked.select("batch_id", field["domain_id"].alias("domain_id"), field["id"].alias("article_id"))
    unanswered = {"batch_id": F.col("batch_id"), "ok": F.lit(False)}
    answers = rows.filter("answer is not null").select(*unpacked(F.col("answer"), RESPONSES)).unionByName(
        rows.filter("answer is null").select(
            *[unanswered.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RESPONSES.fields]
        )
    )
    matched = match_results(batches, answers)
    matched.write.mode("overwrite").parquet(f"{root}/staging/matched")
    matched = spark.read.schema(matched.schema).parquet(f"{root}/staging/matched")
    decisions = batch_decisions(matched, domains)
    write_epoch(apply_decisions(states, decisions, now, only_changed=True).select(*STATES.names), root, "states", "editorial", epoch)
    write_epoch(decision_events(decisions, now).select(*EVENTS.names), root, "events", "editorial", epoch)
    write_epoch(batch_summary(matched), root, "batch_counts", "editorial", epoch)


def start_editorial(
    spark: SparkSession, requests: str, answers: str, root: str, checkpoint: str, domains: DataFrame,
    clock: Clock = F.current_timestamp, *, ticks: DataFrame | None = None, limit_seconds: int = 3600,
    delay: str = "10 minutes", interval: str = "1 minute", once: bool = False,
) -> StreamingQuery:
    """Follow the folders of landed ``requests`` and ``answers`` (Parquet) and log what they decide under ``root``."""
    settled = settled_requests(
        spark.readStream.schema(REQUESTS).parquet(requests), spark.readStream.schema(ANSWERS).parquet(answers), ticks,
        limit_seconds, delay,
    )

    def step(batch: DataFrame, epoch: int) -> None:
        decide_batch(batch, epoch, root, domains, clock())

    writer = settled.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()

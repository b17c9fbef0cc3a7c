"""The keyed state store and the streams over it against the batch forms."""

from __future__ import annotations

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from feedspark.catalog.streams import files_in_parts
from feedspark.operators.decisions import batch_decisions, match_results
from feedspark.operators.state import apply_decisions, current_states
from feedspark.schemas import STATES
from feedspark.sources.tables import folder_exists, follow_states, stored_events, stored_states, write_epoch
from feedspark.streaming import editorial
from feedspark.streaming.state_store import changed_states, kept_states, packed, roll_queue, unpacked
from tests.helpers import BASE, articles, domains, responses


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def same(one, two):
    return sorted(map(str, one.select(*STATES.names).collect())) == sorted(map(str, two.select(*STATES.names).collect()))


def test_packed_rows_come_back(spark):
    odd = {"telegram_message_id": 2**53 + 1, "final_text": 'quote " back \\ line\n é 😀', "llm_processed_at": BASE + datetime.timedelta(microseconds=1)}
    rows = articles(spark, [odd, {"id": "b"}]).select(*STATES.names)
    assert same(rows.select(packed(STATES).alias("row")).select(*unpacked(F.col("row"), STATES)), rows)


def follow(spark, root, files):
    query = changed_states(follow_states(spark, root, files)).writeStream.outputMode("update").format("noop")
    query = query.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_store_equals_fold_after_two_hundred_epochs(spark, tmp_path):
    """Whatever the order of epochs; a later run reads only what the log gained."""
    root, rng = str(tmp_path), random.Random(5)
    rows = []
    for epoch in range(200):
        step = rng.choice(["ingest", "editorial", "publish"])
        for k in rng.sample(range(25), 3):
            at = BASE + datetime.timedelta(minutes=rng.randrange(30))
            rows.append((step, epoch, {"id": f"a{k}", "updated_at": at, "editorial_status": rng.choice(["READY", "ERROR"]), "ingest_seq": epoch}))
    log = articles(spark, [r for _, _, r in rows]).select(*STATES.names)
    steps = spark.createDataFrame([(e, s) for s, e in {(s, e) for s, e, _ in rows}], "epoch long, step string")
    # One folder per epoch, as two hundred runs would have left them.
    (log.withColumn("epoch", F.col("ingest_seq")).join(F.broadcast(steps), "epoch")
     .write.partitionBy("step", "epoch").parquet(f"{root}/states"))
    follow(spark, root, 60)
    fold = current_states(stored_states(spark, root))
    assert stored_states(spark, root).select("step", "epoch").distinct().count() == 200
    assert same(kept_states(spark, f"{root}/progress"), fold)

    newest = articles(spark, [{"id": "a1", "updated_at": BASE + datetime.timedelta(days=9), "editorial_status": "PUBLISHED"}])
    write_epoch(newest.select(*STATES.names), root, "states", "publish", 999)
    again = follow(spark, root, 60)
    assert sum(p["numInputRows"] for p in again.recentProgress) == 1
    assert same(kept_states(spark, f"{root}/progress"), current_states(stored_states(spark, root)))


def test_queue_rolls_and_may_be_repeated(spark, tmp_path):
    root = str(tmp_path)
    ready = articles(spark, [{"id": i, "editorial_status": "READY"} for i in ("a", "b", "c")])
    waiting = lambda df: sorted(r.id for r in df.collect())
    assert waiting(roll_queue(spark, root, 0, ready)) == ["a", "b", "c"]
    gone = articles(spark, [{"id": "b", "editorial_status": "PUBLISHED"}, {"id": "d", "editorial_status": "NEW"}])
    for _ in range(2):
        assert waiting(roll_queue(spark, root, 1, gone)) == ["a", "c"]
    assert waiting(roll_queue(spark, root, 2, ready.limit(0))) == ["a", "c"]
    assert not folder_exists(spark, f"{root}/queue/version=0")


# -- requests and answers ---------------------------------------------------------------------------

LIMIT = 3600
READY = "### RESULT\nArticle-ID: {}\nStatus: READY_TO_PUBLISH\nTitle: t\nText:\nbody {}\n### END RESULT"


def minute(n):
    return F.lit(BASE + datetime.timedelta(minutes=n))


class Desk:
    """Lands requests and answers and runs the stream."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        self.known = domains(spark, [{"id": "football"}])
        self.states = articles(spark, [{"id": f"a{k}"} for k in range(6)]).select(*STATES.names)
        for folder, schema in (("requests", editorial.REQUESTS), ("answers", editorial.ANSWERS), ("ticks", editorial.TICKS)):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{folder}")

    def batches(self, *numbers):
        return self.spark.createDataFrame([(f"b{k}", "football", f"a{k}") for k in numbers], "batch_id string, domain_id string, article_id string")

    def ask(self, at, *numbers):
        editorial.asked_requests(self.batches(*numbers), self.states, minute(at)).write.mode("append").parquet(f"{self.root}/requests")

    def answered(self, *numbers, text="first"):
        return responses(self.spark, [{"batch_id": f"b{k}", "output_text": READY.format(f"a{k}", text)} for k in numbers])

    def answer(self, at, *numbers, text="first"):
        rows = self.answered(*numbers, text=text).withColumn("answered_at", minute(at))
        rows.select(*editorial.ANSWERS.names).write.mode("append").parquet(f"{self.root}/answers")

    def run(self, at=None):
        if at is not None:
            self.spark.range(1).select(minute(at).alias("at")).write.mode("append").parquet(f"{self.root}/ticks")
        ticks = self.spark.readStream.schema(editorial.TICKS).parquet(f"{self.root}/ticks")
        editorial.start_editorial(
            self.spark, f"{self.root}/requests", f"{self.root}/answers", self.root, f"{self.root}/progress", self.known,
            clock=lambda: minute(500), ticks=ticks, limit_seconds=LIMIT, delay="5 minutes", once=True,
        ).awaitTermination()

    def statuses(self):
        return {r.id: (r.editorial_status, r.final_text or r.last_error_message) for r in current_states(stored_states(self.spark, self.root)).collect()}


def test_requests_meet_their_answers_once(spark, tmp_path):
    desk = Desk(spark, str(tmp_path))
    desk.answer(1, 0)  # lands before its request
    desk.ask(0, 0, 1, 2, 3, 4)
    desk.answer(2, 1)
    desk.run()
    assert desk.statuses() == {"a0": ("READY", "body first"), "a1": ("READY", "body first")}
    desk.answer(3, 0, 1, text="second")  # repeated: changes nothing
    desk.answer(30, 2)  # in another run, in time
    desk.answer(61, 3)  # too late by its own time, though its request still waits
    desk.ask(1, 0)  # the request lands again
    desk.run()
    assert desk.statuses() == {f"a{k}": ("READY", "body first") for k in range(3)}
    desk.run(at=300)  # time passes: 3 was late, 4 never came
    found = desk.statuses()
    assert {k: v for k, v in found.items() if v[0] == "ERROR"} == {f"a{k}": ("ERROR", "No answer recorded") for k in (3, 4)}
    desk.answer(62, 4)
    desk.run(at=310)
    assert desk.statuses() == found

    # The same as deciding at once, with the answers that came in time.
    failed = responses(spark, [{"batch_id": f"b{k}", "ok": False, "output_text": None} for k in (3, 4)])
    matched = match_results(desk.batches(0, 1, 2, 3, 4), desk.answered(0, 1, 2).unionByName(failed))
    at_once = apply_decisions(desk.states, batch_decisions(matched, desk.known), minute(500), only_changed=True)
    assert same(current_states(stored_states(spark, desk.root)), at_once)
    kinds = [(r.article_id, r.event_type) for r in stored_events(spark, desk.root).collect()]
    assert sorted(kinds) == [(f"a{k}", "LLM_PROCESSED" if k < 3 else "ERROR") for k in range(5)]


def test_packed_request_holds_whole_states(spark):
    states = articles(spark, [{"id": "a0"}, {"id": "a1"}]).select(*STATES.names)
    batches = spark.createDataFrame([("b", "a0"), ("b", "a1")], "batch_id string, article_id string")
    row = editorial.asked_requests(batches, states, minute(0)).first()
    assert [json.loads(x)["id"] for x in row.articles] == ["a0", "a1"]


@pytest.mark.parametrize("count", [1, 6, 40])
def test_a_log_of_many_files_is_followed_in_few_micro_batches(spark, tmp_path, count):
    root = str(tmp_path)
    spark.range(count).repartition(count).select(F.col("id").cast("string").alias("id")).write.parquet(f"{root}/states/step=ingest/epoch=0")
    landed = stored_states(spark, root)
    per_batch = files_in_parts(landed, 3)
    assert per_batch >= 1 and -(-len(landed.inputFiles()) // per_batch) <= 3

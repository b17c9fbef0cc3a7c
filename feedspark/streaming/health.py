"""Source health that runs along with the fetch log instead of rereading it.

One keyed state per source: the newest fetch, the newest success, the counts, and the places of the failures behind the
newest success.  A success that comes later in the log drops the failures before it, so the state is that of the whole log
however the log was split into epochs and in whichever order they came.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from feedspark.schemas import FETCH_LOG
from feedspark.streaming.state_store import use_keyed_store

# What is kept of a source; places are (at, run_id, seq), times whole microseconds.
STATE = (
    "last_fetch_at long, last_success_at long, last_error_at long, errors long, behind long, "
    "last_at long, last_run string, last_seq long, last_ok boolean, http_status int, error_message string, "
    "ok_at long, ok_run string, ok_seq long, item_id string, item_published string"
)
_NAMES = tuple(part.split()[0] for part in STATE.split(", "))
_SMALLEST = -(2**63)


def _place(at: int | None, run: str | None, seq: int | None) -> tuple:
    """Places in order, nulls first."""
    return (_SMALLEST if at is None else at, run is not None, run or "", _SMALLEST if seq is None else seq)


def _later(one: int | None, two: int | None) -> int | None:
    return max((t for t in (one, two) if t is not None), default=None)


class RunningHealth(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("health", STATE)
        # Failures behind the newest success; each is put in and taken out once.
        self._behind = handle.getMapState("behind", "at long, run string, seq long", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self._state.get() if self._state.exists() else None
        s = dict(zip(_NAMES, held, strict=True)) if held is not None else dict.fromkeys(_NAMES)
        s["errors"], s["behind"] = s["errors"] or 0, s["behind"] or 0
        reset = _place(s["ok_at"], s["ok_run"], s["ok_seq"]) if s["last_success_at"] is not None or s["ok_seq"] is not None else None
        newest = _place(s["last_at"], s["last_run"], s["last_seq"]) if held is not None else None
        fresh: dict[tuple, tuple[tuple, int]] = {}
        moved = False
        for r in rows:
            at, run, seq = r["at"], r["run_id"], r["seq"]
            place = _place(at, run, seq)
            s["last_fetch_at"] = _later(s["last_fetch_at"], at)
            if newest is None or place >= newest:
                newest = place
                s.update(last_at=at, last_run=run, last_seq=seq, last_ok=r["ok"], http_status=r["http_status"], error_message=r["error_message"])
            if r["ok"]:
                s["last_success_at"] = _later(s["last_success_at"], at)
                if reset is None or place >= reset:
                    reset, moved = place, True
                    s.update(ok_at=at, ok_run=run, ok_seq=seq, item_id=r["last_item_external_id"], item_published=r["last_item_published_at"])
            elif r["ok"] is not None:
                s["last_error_at"] = _later(s["last_error_at"], at)
                s["errors"] += 1
                # A map key holds no nulls.
                name = (place[0], "=" + run if run is not None else "", place[3])
                fresh[name] = (place, fresh.get(name, (place, 0))[1] + 1)
        if moved:
            for (name, count) in list(self._behind.iterator()):
                run = name[1][1:] if name[1] else None
                if _place(name[0], run, name[2]) < reset:
                    self._behind.removeKey(tuple(name))
                    s["behind"] -= count[0]
        for name, (place, count) in fresh.items():
            if reset is None or place >= reset:
                before = self._behind.getValue(name)[0] if self._behind.containsKey(name) else 0
                self._behind.updateValue(name, (before + count,))
                s["behind"] += count
        self._state.update(tuple(s[n] for n in _NAMES))
        yield Row(source_id=key[0])

    def close(self) -> None:
        pass


def running_health(log: DataFrame) -> DataFrame:
    """The sources whose health a stream of the fetch log changes; the health itself is read by ``kept_health``."""
    use_keyed_store(log.sparkSession)
    rows = log.filter("source_id is not null").select(
        "source_id", F.unix_micros("at").alias("at"), "run_id", "seq", "ok", "http_status", "error_message",
        "last_item_external_id", "last_item_published_at",
    )
    return rows.groupBy("source_id").transformWithState(RunningHealth(), "source_id string", "Update", "None")


def kept_health(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The health of every source from the store of that stream, as ``fold_source_health`` gives it for the whole log."""
    use_keyed_store(spark)
    store = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "health").load()
    s = F.col("value")

    def instant(name: str):
        return F.timestamp_micros(s[name]).alias(name)

    return store.select(
        F.col("key.source_id").alias("source_id"),
        instant("last_fetch_at"),
        instant("last_success_at"),
        instant("last_error_at"),
        s["behind"].alias("errors_since_success"),
        s["errors"].alias("errors"),
        s["http_status"].alias("last_http_status"),
        F.when(~s["last_ok"], s["error_message"]).alias("last_error_message"),
        s["item_id"].alias("last_item_external_id"),
        s["item_published"].alias("last_item_published_at"),
    )


def start_health(
    spark: SparkSession, root: str, checkpoint: str, *, files_per_batch: int | None = None, once: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Follow the fetch log that the ingest stream stores under ``root``."""
    full = T.StructType([*FETCH_LOG.fields, T.StructField("step", T.StringType()), T.StructField("epoch", T.LongType())])
    reader = spark.readStream.schema(full)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    health = running_health(reader.parquet(f"{root}/fetch_log"))
    writer = health.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()

"""Current article states, kept by key in a streaming state store instead of folded from the whole log.

The state log is followed as a stream.  One value per article holds its newest row; a micro-batch reads only the rows
appended since the last one and hands on the articles they change.  Rows are kept as text, timestamps as whole
microseconds, so nothing is lost on the way through Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from feedspark.operators.selection import deliverable
from feedspark.operators.state import step_rank
from feedspark.schemas import STATES
from feedspark.sources.tables import drop_folder, folder_exists

STORE_CONF = {
    # Keyed processors with several values and timers need this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def use_keyed_store(spark: SparkSession) -> None:
    for key, value in STORE_CONF.items():
        spark.conf.set(key, value)


def _in_micros(schema: T.StructType) -> T.StructType:
    """``schema`` with timestamps as whole numbers."""
    return T.StructType(
        [T.StructField(f.name, T.LongType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for f in schema.fields]
    )


def packed(schema: T.StructType) -> Column:
    """The columns of ``schema`` as one text that ``unpacked`` reads back without loss."""
    values = [
        F.unix_micros(f.name).alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in schema.fields
    ]
    return F.to_json(F.struct(*values))


def unpacked(row: Column, schema: T.StructType) -> list[Column]:
    """Select list of the columns of ``schema`` from a packed row."""
    read = F.from_json(row, _in_micros(schema))
    return [
        (F.timestamp_micros(read[f.name]) if isinstance(f.dataType, T.TimestampType) else read[f.name]).alias(f.name)
        for f in schema.fields
    ]


class LatestState(StatefulProcessor):
    """The newest row of each article; rows of one time count by step, then epoch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "updated long, step int, epoch long, row string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        # Each call is a round trip to the store; a missing value comes back as none.
        held = self._last.get()
        best = tuple(held) if held is not None else None
        before = best
        for r in rows:
            found = (r["updated"], r["step"], r["epoch"], r["row"])
            if best is None or found[:3] >= best[:3]:
                best = found
        if best is not None and best != before:
            self._last.update(best)
            yield Row(id=key[0], row=best[3])

    def close(self) -> None:
        pass


def changed_states(log: DataFrame) -> DataFrame:
    """The state rows that a stream of the log (STATES with ``step`` and ``epoch``) makes current."""
    use_keyed_store(log.sparkSession)
    keyed = log.filter(F.col("id").isNotNull()).select(
        "id",
        F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**62))).alias("updated"),
        step_rank().alias("step"),
        F.coalesce("epoch", F.lit(-1)).cast("long").alias("epoch"),
        packed(STATES).alias("row"),
    )
    latest = keyed.groupBy("id").transformWithState(LatestState(), "id string, row string", "Update", "None")
    return latest.select(*unpacked(F.col("row"), STATES))


def kept_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Every article's current state, read from the store of a stream of ``changed_states``; the log is not read."""
    use_keyed_store(spark)
    store = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "last").load()
    return store.select(*unpacked(F.col("value.row"), STATES))


def _version(root: str, number: int) -> str:
    return f"{root}/queue/version={number}"


def roll_queue(spark: SparkSession, root: str, epoch: int, changed: DataFrame) -> DataFrame:
    """The articles that wait for delivery after the micro-batch ``epoch`` changed some states.

    The queue of the micro-batch before, without what has changed, and what waits among the changed.  A repeated
    micro-batch starts from the same version again.  Versions that no repetition can ask for are deleted.
    """
    staged = f"{root}/staging/queue"
    changed.select(*STATES.names).write.mode("overwrite").parquet(staged)
    changed = spark.read.schema(STATES).parquet(staged)
    waiting = deliverable(changed)
    if epoch > 0 and folder_exists(spark, _version(root, epoch - 1)):
        before = spark.read.schema(STATES).parquet(_version(root, epoch - 1))
        waiting = before.join(changed.select("id"), "id", "left_anti").select(*STATES.names).unionByName(waiting)
    waiting.write.mode("overwrite").parquet(_version(root, epoch))
    drop_folder(spark, _version(root, epoch - 2))
    return spark.read.schema(STATES).parquet(_version(root, epoch))

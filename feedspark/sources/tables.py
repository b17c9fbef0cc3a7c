"""Stored tables: additive schema evolution and the write paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.schemas import ARTICLES, EVENTS, FETCH_LOG, QUARANTINE, STATES, WARNINGS


def evolve_articles(stored: DataFrame, now: Column) -> DataFrame:
    """Bring an older article table to the current schema and repair its statuses.

    A missing status becomes NEW; any trace of a delivery makes the article PUBLISHED.
    """
    empty = stored.sparkSession.createDataFrame([], ARTICLES)
    full = stored.unionByName(empty, allowMissingColumns=True)
    extra = [c for c in full.columns if c not in ARTICLES.names]
    delivered = (
        F.coalesce(F.col("publication_status") == "published", F.lit(False))
        | F.col("telegram_message_id").isNotNull()
        | F.col("telegram_published_at").isNotNull()
    )
    repaired = full.withColumns(
        {
            "editorial_status": F.when(delivered, F.lit("PUBLISHED")).otherwise(
                F.coalesce("editorial_status", F.lit("NEW"))
            ),
            "status_updated_at": F.coalesce("status_updated_at", now),
        }
    )
    return repaired.select(*ARTICLES.names, *extra)


def write_epoch(df: DataFrame, root: str, table: str, step: str, epoch: int) -> str:
    """Write what one step added in one run or micro-batch to its own folder.

    A repeated epoch replaces its folder, so a retry after a lost driver leaves nothing twice.
    """
    target = f"{root}/{table}/step={step}/epoch={epoch}"
    df.write.mode("overwrite").parquet(target)
    return target


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder, files = _folder(spark, path)
    return files.exists(folder)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that no reader can ask for any more; a missing one is none."""
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def read_epochs(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """All written folders of a table with their ``step`` and ``epoch``; empty before the first write."""
    full = T.StructType([*schema.fields, T.StructField("step", T.StringType()), T.StructField("epoch", T.LongType())])
    if not folder_exists(spark, f"{root}/{table}"):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(f"{root}/{table}")


def without_epoch(df: DataFrame, step: str, epoch: int) -> DataFrame:
    """Leave out one folder: what a repeated epoch wrote before must not count as known."""
    return df.filter(~((F.col("step") == step) & (F.col("epoch") == epoch)))


def stored_articles(spark: SparkSession, root: str) -> DataFrame:
    """Articles as inserted."""
    return read_epochs(spark, root, "articles", ARTICLES)


def stored_states(spark: SparkSession, root: str) -> DataFrame:
    """Append-only log of article states: one row at insert and one per change."""
    return read_epochs(spark, root, "states", STATES)


def follow_states(spark: SparkSession, root: str, files_per_batch: int | None = None) -> DataFrame:
    """The state log as a stream with ``step`` and ``epoch``."""
    full = T.StructType([*STATES.fields, T.StructField("step", T.StringType()), T.StructField("epoch", T.LongType())])
    reader = spark.readStream.schema(full)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{root}/states")


def stored_events(spark: SparkSession, root: str) -> DataFrame:
    return read_epochs(spark, root, "events", EVENTS)


def stored_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """Items set aside at ingest."""
    return read_epochs(spark, root, "quarantine", QUARANTINE)


def stored_warnings(spark: SparkSession, root: str) -> DataFrame:
    """Damaged documents with the number of lost items."""
    return read_epochs(spark, root, "warnings", WARNINGS)


def stored_fetch_log(spark: SparkSession, root: str) -> DataFrame:
    return read_epochs(spark, root, "fetch_log", FETCH_LOG)


def append_events(events: DataFrame, path: str) -> None:
    events.select(*EVENTS.names).write.mode("append").parquet(path)


def append_log_lines(lines: DataFrame, path: str) -> None:
    """JSON lines, one per record."""
    lines.write.mode("append").json(path)

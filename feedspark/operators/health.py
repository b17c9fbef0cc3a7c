"""Source monitoring from a fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.operators.lookups import lookup


def fold_source_health(log: DataFrame) -> DataFrame:
    """State of each source after its log, read in the order ``(at, run_id, seq)``.

    ``errors_since_success`` counts the failures after the last success (all of them if there was
    none).  That needs the last success first: one mergeable aggregate gives it, a salted join puts
    it next to the failures only, and a second aggregate counts.
    """
    place = F.struct("at", "run_id", "seq")
    ok = F.col("ok")
    last_ok = F.when(ok, place)
    folded = log.groupBy("source_id").agg(
        F.max("at").alias("last_fetch_at"),
        F.max(F.when(ok, F.col("at"))).alias("last_success_at"),
        F.max(F.when(~ok, F.col("at"))).alias("last_error_at"),
        F.count_if(~ok).alias("errors"),
        F.max(last_ok).alias("_last_ok"),
        F.max_by(F.struct("ok", "http_status", "error_message"), place).alias("_last"),
        F.max_by(F.struct("last_item_external_id", "last_item_published_at"), last_ok).alias("_item"),
    )
    failures = log.filter(~ok).select("source_id", "at", "run_id", "seq")
    resets = folded.filter(F.col("_last_ok").isNotNull()).select("source_id", "_last_ok")
    before_reset = (
        lookup(failures, resets, ["source_id"], ["at", "run_id", "seq"])
        .filter(place < F.col("_last_ok"))
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("_forgiven"))
    )
    return folded.join(before_reset, "source_id", "left").select(
        "source_id",
        "last_fetch_at",
        "last_success_at",
        "last_error_at",
        (F.col("errors") - F.coalesce("_forgiven", F.lit(0))).alias("errors_since_success"),
        "errors",
        F.col("_last.http_status").alias("last_http_status"),
        F.when(~F.col("_last.ok"), F.col("_last.error_message")).alias("last_error_message"),
        F.col("_item.last_item_external_id").alias("last_item_external_id"),
        F.col("_item.last_item_published_at").alias("last_item_published_at"),
    )


def record_fetches(sources: DataFrame, health: DataFrame, now: Column) -> DataFrame:
    """Stored sources after a fetch log: a success resets the run of errors, a failure extends it."""
    h = health.alias("h")
    joined = sources.alias("s").join(h, F.col("s.id") == F.col("h.source_id"), "left")
    seen = F.col("h.source_id").isNotNull()
    succeeded = F.col("h.last_success_at").isNotNull()
    before = F.coalesce(F.col("s.consecutive_error_count"), F.lit(0))
    changed = {
        "last_fetch_at": F.coalesce("h.last_fetch_at", "s.last_fetch_at"),
        "last_success_at": F.coalesce("h.last_success_at", "s.last_success_at"),
        "last_error_at": F.coalesce("h.last_error_at", "s.last_error_at"),
        "consecutive_error_count": F.when(succeeded, F.col("h.errors_since_success")).otherwise(
            before + F.coalesce("h.errors_since_success", F.lit(0))
        ),
        "total_error_count": F.coalesce("s.total_error_count", F.lit(0)) + F.coalesce("h.errors", F.lit(0)),
        "last_http_status": F.when(seen, F.col("h.last_http_status")).otherwise(F.col("s.last_http_status")),
        "last_error_message": F.when(seen, F.col("h.last_error_message")).otherwise(F.col("s.last_error_message")),
        "last_item_external_id": F.when(succeeded, F.col("h.last_item_external_id")).otherwise(
            F.col("s.last_item_external_id")
        ),
        "last_item_published_at": F.when(succeeded, F.col("h.last_item_published_at")).otherwise(
            F.col("s.last_item_published_at")
        ),
        "updated_at": F.when(seen, now).otherwise(F.col("s.updated_at")),
    }
    return joined.select(
        *[
            changed.get(c, F.col(f"s.{c}")).cast(sources.schema[c].dataType).alias(c)
            for c in sources.columns
        ]
    )

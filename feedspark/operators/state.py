"""State transitions of stored articles and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.schemas import ARTICLES, CONTENT, EVENTS, STATES, schema

# What a step decided for one article.  ``action`` names a row of ACTIONS below.
DECISIONS = schema(
    "article_id string, action string, reason string, language string, title string, text string, stage string, "
    "message string, message_id bigint, channel string, delivered_at timestamp"
)


def _verbs(now: Column) -> dict[str, dict[str, Column]]:
    """Columns each verb writes; ``updated_at`` is always written."""
    return {
        "mark_rejected": {
            "editorial_status": F.lit("REJECTED"),
            "status_updated_at": now,
            "rejection_reason": F.col("d.reason"),
            "rejected_at": now,
        },
        "mark_ready": {
            "editorial_status": F.lit("READY"),
            "status_updated_at": now,
            "llm_processed_at": now,
            "final_language": F.col("d.language"),
            "final_title": F.col("d.title"),
            "final_text": F.col("d.text"),
        },
        "mark_error": {
            "editorial_status": F.lit("ERROR"),
            "status_updated_at": now,
            "last_error_stage": F.col("d.stage"),
            "last_error_message": F.col("d.message"),
            "last_error_at": now,
        },
        "record_last_error": {
            "last_error_stage": F.col("d.stage"),
            "last_error_message": F.col("d.message"),
            "last_error_at": now,
        },
        "mark_skipped_old": {
            "publication_status": F.lit("skipped_old"),
            "publication_error": F.col("d.message"),
        },
        "mark_publish_failed": {
            "publication_status": F.lit("failed"),
            "publication_error": F.col("d.message"),
        },
        "mark_publish_retryable": {
            "publication_status": F.lit("unpublished"),
            "publication_error": F.col("d.message"),
        },
        "mark_published": {
            "editorial_status": F.lit("PUBLISHED"),
            "status_updated_at": now,
            "publication_status": F.lit("published"),
            "publication_error": F.lit(None).cast("string"),
            "telegram_message_id": F.col("d.message_id"),
            "telegram_channel": F.col("d.channel"),
            "telegram_published_at": F.col("d.delivered_at"),
            "lifecycle_state": F.lit("published"),
        },
    }


# Verbs of each action, and the event it leaves (none where the trail stays silent).
ACTIONS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "reject": (("mark_rejected",), "LLM_PROCESSED"),
    "ready": (("mark_ready",), "LLM_PROCESSED"),
    "error": (("mark_error",), "ERROR"),
    "note_error": (("record_last_error",), None),
    "skip_old": (("mark_skipped_old",), None),
    "published": (("mark_published",), "PUBLISHED"),
    "retry": (("mark_publish_retryable", "record_last_error"), None),
    "abort": (("mark_error", "mark_publish_failed"), "ERROR"),
    "fail": (("mark_publish_failed", "record_last_error"), "ERROR"),
}


def decision_columns(**values: Column) -> list[Column]:
    """Select list of a decisions table; anything not given is null."""
    return [
        (values[f.name] if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in DECISIONS.fields
    ]


def apply_decisions(store: DataFrame, decisions: DataFrame, now: Column, *, only_changed: bool = False) -> DataFrame:
    """Store rows after at most one decision each; other rows pass through unless ``only_changed``.

    One join on the article id.  ``only_changed`` gives just the rows to append to the state log, so
    a step writes what it decided and not what is stored.
    """
    verbs = _verbs(now)
    effects: dict[str, list[tuple[str, Column]]] = {}
    for action, (names, _) in ACTIONS.items():
        for verb in names:
            for column, value in verbs[verb].items():
                effects.setdefault(column, []).append((action, value))
    joined = store.alias("s").join(
        decisions.alias("d"), F.col("s.id") == F.col("d.article_id"), "inner" if only_changed else "left"
    )
    picked = []
    for name in store.columns:
        value = F.col(f"s.{name}")
        if name == "updated_at":
            value = F.when(F.col("d.action").isNotNull(), now).otherwise(value)
        elif name in effects:
            ladder = None
            for action, written in effects[name]:
                hit = F.col("d.action") == action
                ladder = F.when(hit, written) if ladder is None else ladder.when(hit, written)
            value = ladder.otherwise(value)
        picked.append(value.cast(store.schema[name].dataType).alias(name))
    return joined.select(*picked)


def event_rows(
    rows: DataFrame, *, article_id: Column, event_type: Column, details: Column, error: Column, now: Column
) -> DataFrame:
    """Audit rows.  The sequence number is unique per write, not dense."""
    values = {
        "seq": F.monotonically_increasing_id(),
        "article_id": article_id,
        "event_type": event_type,
        "created_at": now,
        "details_json": details,
        "error_message": error,
    }
    return rows.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in EVENTS.fields])


def decision_events(decisions: DataFrame, now: Column) -> DataFrame:
    """One audit row per decision that leaves a trace."""
    kind = None
    for action, (_, event) in ACTIONS.items():
        if event:
            hit = F.col("action") == action
            kind = F.when(hit, F.lit(event)) if kind is None else kind.when(hit, F.lit(event))
    keep_nulls = {"ignoreNullFields": "false"}
    rejected = F.struct(F.lit("REJECT").alias("decision"), F.col("reason").alias("explanation"))
    accepted = F.struct(F.lit("READY_TO_PUBLISH").alias("decision"), F.col("language").alias("final_language"))
    sent = F.struct(
        F.col("message_id").alias("telegram_message_id"), F.col("channel").alias("telegram_channel")
    )
    details = (
        F.when(F.col("action") == "reject", F.to_json(rejected, keep_nulls))
        .when(F.col("action") == "ready", F.to_json(accepted, keep_nulls))
        .when(F.col("action") == "published", F.to_json(sent, keep_nulls))
    )
    return event_rows(
        decisions.withColumn("_kind", kind).filter(F.col("_kind").isNotNull()),
        article_id=F.col("article_id"),
        event_type=F.col("_kind"),
        details=details,
        error=F.when(F.col("_kind") == "ERROR", F.col("message")),
        now=now,
    )


# Steps in the order in which one moment's rows of an article count.
STEPS = ("ingest", "editorial", "publish")


def step_rank() -> Column:
    """Place of ``step`` among the steps; an unknown one comes last."""
    known = [F.when(F.col("step") == name, F.lit(k)) for k, name in enumerate(STEPS)]
    return F.coalesce(*known, F.lit(len(STEPS)))


def latest_events(events: DataFrame) -> DataFrame:
    """Most recent audit row of each article."""
    rest = [c for c in events.columns if c != "article_id"]
    last = F.max_by(F.struct(*rest), F.struct("created_at", "seq")).alias("_last")
    return events.groupBy("article_id").agg(last).select("article_id", "_last.*")


def current_states(states: DataFrame) -> DataFrame:
    """Latest row of each article in the append-only state log; rows of one time count by step, then epoch.

    The log is narrow: selection and publishing work on it alone and never read article content.
    """
    rest = [c for c in STATES.names if c != "id"]
    last = F.max_by(F.struct(*rest), F.struct("updated_at", step_rank(), "epoch")).alias("_s")
    return states.groupBy("id").agg(last).select("id", "_s.*")


def current_articles(articles: DataFrame, states: DataFrame) -> DataFrame:
    """Content of every article with its latest state."""
    return articles.select("id", *CONTENT).join(current_states(states), "id").select(*ARTICLES.names)

"""Expected articles against parsed answers: one decision per article, and the batch counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.functions.text import empty_to_null, or_dash
from feedspark.operators.lookups import lookup
from feedspark.operators.parsing import (
    EMPTY_BATCH,
    NO_BLOCKS,
    first_result,
    parse_blocks,
    parse_single,
    tag_error,
)
from feedspark.operators.state import decision_columns

DEFAULT_LANGUAGE = "ru"

# Stages and messages of failed decisions.
REQUEST_STAGE, PARSE_STAGE, SINGLE_STAGE = "LLM_BATCH_REQUEST", "LLM_BATCH_PARSE", "LLM"
DUPLICATE, MISSING = "duplicate_article_id_in_response", "missing_result_for_article"


def final_language(default: str = DEFAULT_LANGUAGE) -> Column:
    return F.coalesce(empty_to_null(F.col("target_language")), F.lit(default))


def match_results(batches: DataFrame, responses: DataFrame) -> DataFrame:
    """Expected and parsed ids side by side, matched by id and never by order.

    ``outcome`` is one of request_failed, parse_failed, duplicate, error, missing, bad_tag, reject,
    ready for an expected article, and unknown for an id the batch did not ask about.
    """
    asked_rows = batches.select("batch_id", "domain_id", "article_id", F.lit(True).alias("expected"))
    rows = asked_rows.unionByName(parse_blocks(responses), allowMissingColumns=True).repartition("batch_id")
    # One shuffle by batch serves both the match by id and the look over the whole batch, which is
    # bounded by the batch size.
    both = rows.groupBy("batch_id", "article_id").agg(
        F.max("domain_id").alias("domain_id"),
        F.max("expected").alias("expected"),
        F.count("block_no").alias("occurrences"),
        first_result(),
    )
    batch = Window.partitionBy("batch_id")
    judged = both.select("*", "_r.*").withColumns(
        {
            "failure": F.max("failure").over(batch),
            "answered": F.max("occurrences").over(batch) > 0,
            "tag_error": F.when(F.col("decision") == "READY_TO_PUBLISH", tag_error(F.col("text"))),
        }
    ).filter(F.col("article_id").isNotNull())
    asked = F.coalesce("expected", F.lit(False))
    outcome = (
        F.when(~asked, F.lit("unknown"))
        .when(F.col("failure").isin(EMPTY_BATCH, NO_BLOCKS), F.lit("parse_failed"))
        .when(F.col("failure").isNotNull() | ~F.col("answered"), F.lit("request_failed"))
        .when(F.col("occurrences") > 1, F.lit("duplicate"))
        .when(F.col("occurrences") == 0, F.lit("missing"))
        .when(F.col("error").isNotNull(), F.lit("error"))
        .when(F.col("tag_error").isNotNull(), F.lit("bad_tag"))
        .when(F.col("decision") == "REJECT", F.lit("reject"))
        .otherwise(F.lit("ready"))
    )
    message = (
        F.when(outcome.isin("request_failed", "parse_failed"), F.col("failure"))
        .when(outcome == "duplicate", F.lit(DUPLICATE))
        .when(outcome == "missing", F.lit(MISSING))
        .when(outcome == "error", F.col("error"))
        .when(outcome == "bad_tag", F.col("tag_error"))
    )
    return judged.withColumn("outcome", outcome).withColumn("message", message).select(
        "batch_id", "domain_id", "article_id", "outcome", "message", "reason", "title", "text", "occurrences"
    )


def batch_decisions(matched: DataFrame, domains: DataFrame, default_language: str = DEFAULT_LANGUAGE) -> DataFrame:
    """State changes of the expected articles; unknown ids change nothing."""
    languages = domains.select(F.col("id").alias("domain_id"), "target_language")
    rows = lookup(matched.filter(F.col("outcome") != "unknown"), languages, ["domain_id"], ["article_id"], "left")
    return _as_decisions(
        rows,
        F.when(F.col("outcome") == "request_failed", F.lit(REQUEST_STAGE)).otherwise(F.lit(PARSE_STAGE)),
        default_language,
    )


def _as_decisions(rows: DataFrame, stage: Column, default_language: str) -> DataFrame:
    good = F.col("outcome").isin("ready", "reject")
    ready = F.col("outcome") == "ready"
    return rows.select(
        *decision_columns(
            article_id=F.col("article_id"),
            action=F.when(good, F.col("outcome")).otherwise(F.lit("error")),
            reason=F.when(F.col("outcome") == "reject", F.col("reason")),
            language=F.when(ready, final_language(default_language)),
            title=F.when(ready, or_dash(F.col("title"))),
            text=F.when(ready, or_dash(F.col("text"))),
            stage=F.when(~good, stage),
            message=F.when(~good, F.col("message")),
        )
    )


def batch_summary(matched: DataFrame) -> DataFrame:
    """Counts per batch.

    ``error_count`` counts articles.  ``logged_error_count`` adds the repeated ids once more, which
    is the figure the run log shows.  A batch whose request or parse failed as a whole counts only
    errors.
    """
    known = F.col("outcome") != "unknown"
    repeated = F.coalesce(F.col("occurrences") > 1, F.lit(False))
    errors = F.count_if(F.col("outcome").isin("request_failed", "parse_failed", "duplicate", "error", "bad_tag"))
    return matched.groupBy("batch_id").agg(
        F.count_if(known).alias("articles"),
        F.count_if(F.col("outcome").isin("ready", "reject")).alias("ok_count"),
        errors.alias("error_count"),
        (errors + F.count_if(repeated)).alias("logged_error_count"),
        F.count_if(F.col("outcome") == "missing").alias("missing_count"),
        F.count_if(~known).alias("unknown_id_count"),
        F.count_if(repeated).alias("duplicate_id_count"),
    )


def unknown_ids(matched: DataFrame) -> DataFrame:
    """Ids an answer produced although its batch did not ask for them, one row each."""
    return matched.filter(F.col("outcome") == "unknown").select("batch_id", "article_id")


def single_decisions(responses: DataFrame, domains: DataFrame, default_language: str = DEFAULT_LANGUAGE) -> DataFrame:
    """State changes from single-article answers ``(article_id, domain_id, ok, error_message, output_text)``."""
    languages = domains.select(F.col("id").alias("domain_id"), "target_language")
    parsed = parse_single(responses).withColumn(
        "tag_error", F.when(F.col("decision") == "READY_TO_PUBLISH", tag_error(F.col("text")))
    )
    message = F.when(~F.col("ok"), F.col("error_message")).otherwise(F.coalesce("error", "tag_error"))
    outcome = (
        F.when(~F.col("ok") | message.isNotNull(), F.lit("error"))
        .when(F.col("decision") == "REJECT", F.lit("reject"))
        .otherwise(F.lit("ready"))
    )
    judged = parsed.withColumn("outcome", outcome).withColumn("message", message)
    rows = lookup(judged, languages, ["domain_id"], ["article_id"], "left")
    return _as_decisions(rows, F.lit(SINGLE_STAGE), default_language)

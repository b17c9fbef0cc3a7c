"""The run report as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW = "array<struct<section:string,line:int,label:string,value:string>>"


def _rows(section: str, pairs: list[tuple[str, Column]], first: int = 1) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(section).alias("section"),
                F.lit(first + i).alias("line"),
                F.lit(label).alias("label"),
                value.cast("string").alias("value"),
            )
            for i, (label, value) in enumerate(pairs)
        ]
    ).cast(_ROW)


def ingest_report(summary: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Ingest section from the run summary, and publish counts where a run has them."""
    failed = F.coalesce(F.nullif(F.array_join("failed_source_ids", ", "), F.lit("")), F.lit("-"))
    head = summary.select(
        F.inline(
            _rows(
                "ingest",
                [
                    ("Sources processed", F.col("sources_processed")),
                    ("Failed sources", F.col("failed_sources")),
                    ("Failed source ids", failed),
                    ("Fetched articles", F.col("fetched_articles")),
                    ("Inserted articles", F.col("inserted_articles")),
                    ("Duplicate articles", F.col("duplicate_articles")),
                ],
            )
        )
    )
    if stats is None:
        return head
    tail = stats.select(
        F.inline(
            _rows(
                "ingest",
                [
                    ("Skipped old", F.col("skipped_old_articles")),
                    ("Published", F.col("published_articles")),
                    ("Publish failures", F.col("publication_failures")),
                ],
                first=7,
            )
        )
    )
    return head.unionByName(tail)


def usage_report(usage: DataFrame) -> DataFrame:
    """Usage section in one of three forms: not executed, all requests failed, or normal."""
    unavailable = F.lit("unavailable")

    def usd(name: str) -> Column:
        return F.concat(F.lit("$"), F.col(name))

    head = [
        ("Model", F.col("model")),
        ("Requests attempted", F.col("attempted_request_count")),
        ("Successful requests", F.col("successful_request_count")),
        ("Failed requests", F.col("failed_request_count")),
        ("Articles attempted", F.col("attempted_article_count")),
    ]
    responses = [
        ("Completed responses", F.col("completed_response_count")),
        ("Incomplete responses", F.col("incomplete_response_count")),
    ]
    failed = head + responses + [
        ("Input tokens", unavailable),
        ("Output tokens", unavailable),
        ("Total cost USD", unavailable),
    ]
    normal = head + [
        ("Articles processed", F.col("article_count")),
        ("Input tokens", F.col("input_tokens")),
        ("Output tokens", F.col("output_tokens")),
        ("Total tokens", F.col("total_tokens")),
    ] + responses + [
        ("Total cost USD", usd("total_cost_usd")),
        ("Total cost cents", F.col("total_cost_cents")),
        ("Average cost/article", usd("average_cost_per_article_usd")),
    ]
    idle = [("LLM stage not executed", F.lit(None))]
    none_answered = (F.col("successful_request_count") == 0) & (F.col("failed_request_count") > 0)
    form = (
        F.when(F.col("attempted_request_count") == 0, _rows("usage", idle))
        .when(none_answered, _rows("usage", failed))
        .otherwise(_rows("usage", normal))
    )
    return usage.select(F.inline(form))

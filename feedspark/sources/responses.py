"""Recorded scorer answers and API errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import blank_to_null, utrim

_RESPONSE = (
    "model string, status string, incomplete_details struct<reason:string>, "
    "output array<string>, "
    "usage struct<input_tokens:bigint, output_tokens:bigint, total_tokens:bigint, "
    "input_tokens_details:struct<cached_tokens:bigint>, output_tokens_details:struct<reasoning_tokens:bigint>>"
)

# Members are read one by one, so that one of another shape costs nothing but itself.
_MEMBER = "type string, role string, content array<string>"
_PIECE = "type string, text string"


def _or_null_if_blank(c: Column) -> Column:
    return F.when(utrim(c) != "", c)


def parse_responses(responses: DataFrame, body: str = "body", fallback_model: str = "requested_model") -> DataFrame:
    """Text, model, status and token counts of each JSON answer; absent counts are zero.

    An answer without text is unusable: ``error_message`` says so and ``ok`` is false.
    """
    parsed = responses.withColumn("_r", F.from_json(body, _RESPONSE))
    members = F.transform(F.col("_r.output"), lambda o: F.from_json(o, _MEMBER))
    answers = F.filter(members, lambda o: (o["type"] == "message") & (o["role"] == "assistant"))
    contents = F.flatten(F.transform(answers, lambda o: F.coalesce(o["content"], F.array().cast("array<string>"))))
    pieces = F.transform(contents, lambda p: F.from_json(p, _PIECE))
    texts = F.transform(
        F.filter(pieces, lambda p: (p["type"] == "output_text") & (p["text"] != "")), lambda p: p["text"]
    )
    count = lambda name: F.coalesce(F.col(f"_r.usage.{name}"), F.lit(0))
    total = F.coalesce(F.col("_r.usage.total_tokens"), count("input_tokens") + count("output_tokens"))
    text = blank_to_null(F.array_join(texts, "\n"))
    return parsed.select(
        *[c for c in responses.columns if c not in (body, "ok", "error_message")],
        text.alias("output_text"),
        F.coalesce(_or_null_if_blank(F.col("_r.model")), F.col(fallback_model)).alias("model"),
        _or_null_if_blank(F.col("_r.status")).alias("status"),
        _or_null_if_blank(F.col("_r.incomplete_details.reason")).alias("incomplete_reason"),
        count("input_tokens").alias("input_tokens"),
        count("output_tokens").alias("output_tokens"),
        total.alias("total_tokens"),
        count("input_tokens_details.cached_tokens").alias("cached_tokens"),
        count("output_tokens_details.reasoning_tokens").alias("reasoning_tokens"),
        text.isNotNull().alias("ok"),
        F.when(text.isNull(), F.lit("Responses API returned no output_text")).alias("error_message"),
    )


def parse_api_errors(errors: DataFrame, body: str = "body") -> DataFrame:
    """Safe ``type``, ``code`` and ``message`` of an error body; anything malformed is null."""
    parsed = errors.withColumn("_v", F.try_parse_json(body))

    def field(name: str, *kinds: str) -> Column:
        path = f"$.error.{name}"
        kind = F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
        return F.when(kind.isin(*kinds), F.try_variant_get("_v", path, "string"))

    return parsed.select(
        *[c for c in errors.columns if c != body],
        field("type", "STRING").alias("error_type"),
        field("code", "STRING", "BIGINT").alias("error_code"),
        field("message", "STRING").alias("error_message"),
    )

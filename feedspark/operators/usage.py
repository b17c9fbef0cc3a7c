"""Token usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.money import COST_TYPE, token_cost, usd_cents, usd_text
from feedspark.functions.text import empty_to_null
from feedspark.operators.lookups import lookup

TOKENS = ("input_tokens", "output_tokens", "total_tokens", "cached_tokens", "reasoning_tokens")


def match_pricing(models: DataFrame, pricing: DataFrame) -> DataFrame:
    """Price of each model: the longest key that is the model or is followed by a dash in it.

    Every dash boundary of a model name gives one candidate key, so this is an equi-join on the
    distinct models instead of a comparison of every model with every key.
    """
    parts = F.split("model", "-", -1)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "-")
    )
    named = models.select("model").filter(F.coalesce("model", F.lit("")) != "").distinct()
    candidates = named.select("model", F.explode(prefixes).alias("model_key")).join(pricing, "model_key")
    best = F.max_by(F.struct("model_key", "input_price", "output_price"), F.length("model_key"))
    return candidates.groupBy("model").agg(best.alias("_b")).select("model", "_b.*")


def price_usage(responses: DataFrame, pricing: DataFrame) -> DataFrame:
    """Each response with its price key and costs; all input tokens are charged, cached or not."""
    priced = lookup(responses, match_pricing(responses, pricing), ["model"], ["batch_id"], "left")
    answered = F.col("ok")
    cost_in = F.when(answered, token_cost(F.col("input_tokens"), F.col("input_price")))
    cost_out = F.when(answered, token_cost(F.col("output_tokens"), F.col("output_price")))
    free = F.lit(0).cast(COST_TYPE)
    return priced.withColumns(
        {
            "input_cost_usd": F.coalesce(cost_in, free),
            "output_cost_usd": F.coalesce(cost_out, free),
            "usage_missing": answered & (F.col("total_tokens") == 0),
            "pricing_missing": answered & F.col("model_key").isNull(),
        }
    ).withColumn("total_cost_usd", (F.col("input_cost_usd") + F.col("output_cost_usd")).cast(COST_TYPE))


def usage_by_batch(priced: DataFrame) -> DataFrame:
    """Usage line of each answered request."""
    return priced.filter("ok").select(
        "batch_id",
        "model",
        "model_key",
        "status",
        *TOKENS,
        usd_text(F.col("input_cost_usd")).alias("input_cost_usd"),
        usd_text(F.col("output_cost_usd")).alias("output_cost_usd"),
        usd_text(F.col("total_cost_usd")).alias("total_cost_usd"),
        "usage_missing",
        "pricing_missing",
    )


def _single_or_multiple(c: Column) -> Column:
    return F.when(F.min(c) != F.max(c), F.lit("multiple")).otherwise(F.max(c))


def summarize_usage(priced: DataFrame) -> DataFrame:
    """One row of run totals; a run without requests gives zeros."""
    answered = F.col("ok")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(answered, F.col(c))), F.lit(0))

    totals = priced.agg(
        F.coalesce(
            empty_to_null(_single_or_multiple(F.when(answered, F.col("model")))),
            _single_or_multiple(F.col("requested_model")),
        ).alias("model"),
        F.count(F.lit(1)).alias("attempted_request_count"),
        F.count_if(answered).alias("successful_request_count"),
        F.count_if(~answered).alias("failed_request_count"),
        F.coalesce(F.sum("articles"), F.lit(0)).cast("bigint").alias("attempted_article_count"),
        total("articles").cast("bigint").alias("article_count"),
        F.count_if(answered & (F.col("status") == "completed")).alias("completed_response_count"),
        F.count_if(answered & (F.col("status") == "incomplete")).alias("incomplete_response_count"),
        *[total(c).cast("bigint").alias(c) for c in TOKENS],
        F.coalesce(F.sum("input_cost_usd"), F.lit(0)).cast(COST_TYPE).alias("input_cost"),
        F.coalesce(F.sum("output_cost_usd"), F.lit(0)).cast(COST_TYPE).alias("output_cost"),
    )
    cost = (F.col("input_cost") + F.col("output_cost")).cast(COST_TYPE)
    average = F.when(F.col("article_count") > 0, cost / F.col("article_count").cast("decimal(19,0)")).otherwise(
        F.lit(0)
    )
    return totals.select(
        *[c for c in totals.columns if c not in ("input_cost", "output_cost")],
        usd_text(F.col("input_cost")).alias("input_cost_usd"),
        usd_text(F.col("output_cost")).alias("output_cost_usd"),
        usd_text(cost).alias("total_cost_usd"),
        usd_cents(cost).alias("total_cost_cents"),
        usd_text(average).alias("average_cost_per_article_usd"),
    )

"""Declarative configuration as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.functions.text import utrim

CONFIG = (
    "ingestion struct<max_article_age_hours:int>, "
    "publishing struct<max_articles_per_run:int, interval_seconds:int>, "
    "llm struct<enabled:boolean, default_target_language:string, max_articles_per_run:int, batch_size:int, "
    "pricing:struct<models:map<string,struct<input_price_per_million_usd:decimal(18,6),"
    "output_price_per_million_usd:decimal(18,6)>>>>, "
    "domains array<struct<id:string, name:string, telegram:struct<channel_id:string>, "
    "llm:struct<enabled:boolean, target_language:string, pipeline_prompt:string>, "
    "sources:array<struct<id:string, type:string, name:string, url:string, enabled:boolean, "
    "config:map<string,string>>>>>"
)


def as_int(c: Column) -> Column:
    """Whole number or null."""
    return utrim(c).try_cast("int")


def as_bool(c: Column) -> Column:
    """True only for the accepted spellings; absence is false."""
    # The spellings that count as true.
    return F.coalesce(F.lower(utrim(c)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def scan_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG).option("multiLine", True).json(path)


def run_settings(config: DataFrame) -> DataFrame:
    """One row of run-wide settings with their defaults."""

    def default(name: str, value: object) -> Column:
        return F.coalesce(F.col(name), F.lit(value)).alias(name.rsplit(".", 1)[-1])

    return config.select(
        default("ingestion.max_article_age_hours", 24),
        F.coalesce(F.col("publishing.max_articles_per_run"), F.lit(2)).alias("max_published_per_run"),
        default("publishing.interval_seconds", 60),
        default("llm.default_target_language", "ru"),
        F.coalesce(F.col("llm.max_articles_per_run"), F.lit(100)).alias("max_articles_per_run"),
        default("llm.batch_size", 20),
    )


def domains(config: DataFrame) -> DataFrame:
    """Domains in configured order.  Scoring needs the global flag, a domain block and its flag."""
    globally = F.coalesce(F.col("llm.enabled"), F.lit(True))
    block = F.col("d.llm")
    return config.select("llm", F.posexplode("domains").alias("domain_rank", "d")).select(
        "domain_rank",
        "d.id",
        "d.name",
        F.col("d.telegram.channel_id").alias("channel_id"),
        (globally & block.isNotNull() & F.coalesce(block["enabled"], F.lit(True))).alias("llm_enabled"),
        block["target_language"].alias("target_language"),
        block["pipeline_prompt"].alias("prompt_file"),
    )


def source_config(config: DataFrame) -> DataFrame:
    """Sources in configured order."""
    return (
        config.select(F.posexplode("domains").alias("domain_rank", "d"))
        .select("domain_rank", F.col("d.id").alias("domain_id"), F.posexplode("d.sources").alias("source_rank", "s"))
        .select(
            "domain_id",
            "domain_rank",
            "source_rank",
            "s.id",
            "s.type",
            "s.name",
            "s.url",
            F.coalesce("s.enabled", F.lit(True)).alias("enabled"),
            F.coalesce("s.config", F.create_map().cast("map<string,string>")).alias("config"),
        )
    )


def pricing(config: DataFrame) -> DataFrame:
    return config.select(F.explode("llm.pricing.models").alias("model_key", "p")).select(
        "model_key",
        F.coalesce("p.input_price_per_million_usd", F.lit(0).cast("decimal(18,6)")).alias("input_price"),
        F.coalesce("p.output_price_per_million_usd", F.lit(0).cast("decimal(18,6)")).alias("output_price"),
    )


def feed_settings(sources: DataFrame) -> DataFrame:
    """Per-source feed options read leniently from the free-form config map."""
    option = F.col("config")
    return sources.select(
        F.col("id").alias("source_id"),
        as_int(option["rss_max_age_hours"]).alias("rss_max_age_hours"),
        as_bool(option["rss_sort_by_published_desc"]).alias("rss_sort_by_published_desc"),
        as_int(option["rss_max_items"]).alias("rss_max_items"),
        as_bool(option["rss_drop_if_no_date"]).alias("rss_drop_if_no_date"),
        F.greatest(F.coalesce(as_int(option["retry_attempts"]), F.lit(1)), F.lit(1)).alias("retry_attempts"),
    )

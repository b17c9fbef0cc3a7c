"""Prompt files as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """``(prompt_file, prompt)`` for every text file of the folder."""
    return spark.read.text(folder, wholetext=True).select(
        F.col("_metadata.file_name").alias("prompt_file"), F.col("value").alias("prompt")
    )


def domain_prompts(domains: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompt of each scored domain; a domain whose file is absent keeps a null prompt."""
    return (
        domains.filter("llm_enabled")
        .join(prompts, "prompt_file", "left")
        .select(F.col("id").alias("domain_id"), "prompt_file", "prompt")
    )


def missing_prompts(domains: DataFrame, prompts: DataFrame) -> DataFrame:
    return domains.filter("llm_enabled").join(prompts, "prompt_file", "left_anti").select(
        F.col("id").alias("domain_id"), "prompt_file"
    )

"""Small tables for the operator tests."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from feedspark.schemas import ARTICLES, ENTRIES, FETCH_ATTEMPTS, OUTCOMES, RESPONSES, SOURCE_CONFIG

BASE = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def rows(spark: SparkSession, schema, records: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in records], schema)


def articles(spark: SparkSession, records: list[dict]) -> DataFrame:
    filled = []
    for n, record in enumerate(records):
        base = {
            "id": f"a{n}", "domain_id": "football", "source_id": "s1", "canonical_url": f"https://example.com/{n}",
            "source_item_external_id": f"x{n}", "title": f"t{n}", "content": f"c{n}",
            "published_at": "2026-01-01T00:00:00Z", "lifecycle_state": "normalized",
            "publication_status": "unpublished", "editorial_status": "NEW",
            "created_at": BASE + datetime.timedelta(minutes=n), "updated_at": BASE, "ingest_seq": n,
        }
        filled.append({**base, **record})
    return rows(spark, ARTICLES, filled)


def entries(spark: SparkSession, records: list[dict]) -> DataFrame:
    return rows(spark, ENTRIES, [{"source_id": "s1", "run_id": "r", "pos": n, **r} for n, r in enumerate(records)])


def source_config(spark: SparkSession, records: list[dict]) -> DataFrame:
    base = {
        "domain_id": "football", "domain_rank": 0, "source_rank": 0, "type": "rss", "name": "Source",
        "url": "https://example.com/rss", "enabled": True, "config": {},
    }
    return rows(spark, SOURCE_CONFIG, [{**base, **r} for r in records])


def attempts(spark: SparkSession, records: list[dict]) -> DataFrame:
    return rows(spark, FETCH_ATTEMPTS, [{"source_id": "s1", "run_id": "r", "attempt": 1, **r} for r in records])


def responses(spark: SparkSession, records: list[dict]) -> DataFrame:
    base = {
        "batch_id": "b1", "requested_model": "larch", "articles": 1, "ok": True, "model": "larch", "status": "completed",
        "input_tokens": 0, "output_tokens": 0, "total_tokens": 0, "cached_tokens": 0, "reasoning_tokens": 0,
    }
    return rows(spark, RESPONSES, [{**base, **r} for r in records])


def outcomes(spark: SparkSession, records: list[dict]) -> DataFrame:
    return rows(spark, OUTCOMES, [{"ok": True, "attempted_at": BASE, **r} for r in records])


def domains(spark: SparkSession, records: list[dict]) -> DataFrame:
    ddl = (
        "domain_rank int, id string, name string, channel_id string, llm_enabled boolean, target_language string, "
        "prompt_file string"
    )
    base = {"domain_rank": 0, "name": "D", "channel_id": "ch", "llm_enabled": True, "prompt_file": "p.txt"}
    names = [part.split()[0] for part in ddl.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in records], ddl)


def sources(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n, f"Name {n}") for n in names], "id string, name string")

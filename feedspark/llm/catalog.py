"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm import (
    embeddings, minhash, mixing, packed_ids, pieces, preferences, quality, runs, secrets, shards, substrings,
    toxicity, whitening,
)
from feedspark.llm.common import prepare, table

SHARDS = 40


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs)


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.place_in_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packed_ids.read_ids(packed_ids.write_ids(docs, vocabulary("word_bpe_49k.json")))


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).drop("removed")


def preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return preferences.format_preferences(preferences.pair_up(preferences.gather(turns)))


def encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    shown = F.array_join(
        F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.withColumn("spans", shown).drop("found")


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return runs.digest_runs(runs.periodic_runs(runs.with_planted_repeats(docs)))


def whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_mcd_outliers": (quality_rules, None),
    "op2_pivotal_mixing": (mix, None),
    "op3_preference_format": (preference_format, preferences.SQL),
    "op4_minimax_shards": (shard, None),
    "op5_suffix_array_pieces": (encode_pieces, None),
    "op6_binary_code_dedup": (embedding_dedup, None),
    "op7_packed_ids": (pack_tokens, None),
    "op8_merged_bwt_dedup": (substring_dedup, None),
    "op9_secret_scan": (secret_scan, None),
    "op10_odd_sketch_dedup": (near_dedup, None),
    "op11_basic_factor_runs": (periodic_runs, None),
    "op12_chebyshev_whitening": (whiten, None),
    "op13_boosted_toxicity": (toxic, None),
}


def _prepared(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return build(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _prepared(build) for name, (build, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

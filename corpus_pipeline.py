"""The training-data pipeline: stages in order, each over all its predecessor kept.

Defined results of the stages.  A null or empty text fails the first stage.  Repeated rows stay repeated, also where near copies
are left out: what is kept there are ids.  Rows without an id, language or source are kept like others.  An empty
table gives no row.  Extra columns are carried along whatever their names, but for the last stage, which returns ids and texts only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.llm import minhash, mixing, pieces, quality, secrets
from feedspark.llm.catalog import vocabulary
from feedspark.llm.common import free_name, prepare
from feedspark.session import set_aside

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def sheltered(docs: DataFrame, read: tuple[str, ...]) -> DataFrame:
    """``docs`` with the columns that a stage only carries along under names that clash with no result of it."""
    names = [c if c in read else free_name([*docs.columns, *read], f"_carried{k}") for k, c in enumerate(docs.columns)]
    return docs.toDF(*names)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers in their language and source."""
    prepare(spark)
    rows = sheltered(docs, ("doc_id", "text", "lang", "source"))
    return quality.judge(rows, rows.columns).filter("kept").select(*rows.columns).toDF(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id stay."""
    prepare(spark)
    kept = minhash.near_duplicates(docs).filter("kept and doc_id is not null").select("doc_id").distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    return chosen.unionByName(docs.filter("doc_id is null"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced in the text; the number of characters follows it."""
    import public_tokenizers

    prepare(spark)
    hidden = secrets.redact_secrets(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    prepare(spark)
    rows = sheltered(docs, ("doc_id", "text", "source"))
    mixed = mixing.mix_sources(rows, rows.columns).filter("copies > 0")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.withColumn("_copy", times).select(*rows.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it."""
    prepare(spark)
    return pieces.encode_decode(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_quality),
    ("MinHash near-dedup", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

# Its stages cannot be expressed in SQL; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = set_aside(docs)
    return docs

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.session import REQUIRED_CONF

# The characters that separate words.
BREAK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_SEED = 20_240_607
_BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK + "+"), "")


def prepare(spark: SparkSession) -> None:
    """Settings that the operators rely on.

    Texts may be long, so a Python worker gets fewer of them at a time, and it has to find this
    package where the driver found it.
    """
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    root, found = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in found.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, found]))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df_columns: Iterable[str], wanted: str) -> str:
    """``wanted``, or a longer name that clashes with no column whatever its case."""
    taken = {c.lower() for c in df_columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def file_uri(path: str) -> str:
    """A Hadoop path as a URI that Arrow file systems read (``file:/x`` becomes ``file:///x``)."""
    return re.sub(r"^file:/+", "file:///", path)


class RollingHash:
    """64-bit hashes of any byte range of a buffer, all ranges vectorised.

    A polynomial over a random value per byte, modulo 2**64, with a final mix.  Powers are kept for
    the longest buffer seen so far.
    """

    def __init__(self) -> None:
        self._value = np.random.default_rng(_SEED).integers(0, 2**64, 256, dtype=np.uint64)
        self._power = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n <= len(self._power):
            return
        n = max(n, 2 * len(self._power))
        with np.errstate(over="ignore"):
            for name, base in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums to be handed to ``ranges``; one entry more than bytes."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self._value[data] * self._power[: len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (prefix[end] - prefix[start]) * self._inverse[start]
            return mix64(raw + (end - start).astype(np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

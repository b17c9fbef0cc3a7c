"""MinHash near-dedup with odd sketches.

A document is the set of its five-word shingles.  Texts with the same words are one class and are
compared once.  Each class gets ``BANDS`` x ``ROWS`` minimum hashes.  Classes that agree in all rows of a
band are candidates.

A candidate is verified by odd sketches.  The sample of a set are its shingles with the smallest hashes: all of them in a set of up to
``SAMPLE``, and below half, a quarter, ... of the range in larger ones.  Each shingle of the sample flips one bit of a
bitmap.  In the XOR of two bitmaps only shingles of one side remain, at most one bit for each, so the
number of its ones is a lower bound of the symmetric difference of the samples, and close to it.  A pair at the
threshold differs in a seventh of its shingles.  A whole sample with more ones is below it for certain; for a
part of the set it must be more by ``SURE`` standard deviations.  Pairs that pass are confirmed on the full sets.

Groups of near copies are not expanded into pairs.  First every class is confirmed against the ``HEADS`` heads
of its bands with which it shares most bands, which joins a group of m copies with few comparisons each; this
is repeated with other heads for rows whose head is of another group.  Only then are candidates from different
groups that still share a band compared in full, so no link between two groups is lost.

A pair at the threshold shares no band with probability (1 - 0.75**4)**32 < 0.00001.

Defined results.  A null text, an empty text and one without words have an empty set, link with nothing and are
kept.  A text of fewer than five words is one shingle.  Rows that share a doc_id are reported one by one and
count as one document, which has the links of all their texts; a null doc_id is never linked.  An empty table gives no row.  Extra columns
are ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import RollingHash, mix64
from feedspark.llm.components import components
from feedspark.session import set_aside

SHINGLE = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
THRESHOLD = 0.75
SKETCH_BITS = 2048
SKETCH_WORDS = SKETCH_BITS // 64
# Sets up to this size are sampled whole; of a larger one about half to all of it is.
SAMPLE = 512
SURE = 5.0
STAR_ROUNDS = 4
HEADS = 3

_rng = np.random.default_rng(5)
_FACTOR = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)


def normal_words(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case; bytes.split knows just the six separators."""
    return (text or "").encode().lower().split()


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingle_set(words: list[bytes], hasher: RollingHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    return np.unique(hasher.ranges(hasher.prefix(data), starts[: len(words) - k + 1], ends[k - 1 :]))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of all hash functions, in chunks so that long texts need little memory."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(shingles), 2048):
            part = shingles[k : k + 2048, None] * _FACTOR + _SHIFT
            np.minimum(out, part.min(axis=0), out=out)
    return out


def level_of(n: int) -> int:
    """How often the range of hashes is halved to leave about ``SAMPLE`` of ``n`` shingles."""
    return max(0, math.ceil(math.log2(max(n, 1) / SAMPLE)))


def odd_sketch(shingles: np.ndarray, level: int) -> np.ndarray:
    """Parity bitmap of the shingles whose mixed hash starts with ``level`` zero bits, as ``SKETCH_WORDS`` signed numbers."""
    mixed = mix64(shingles ^ np.uint64(0xD6E8FEB86659FD93))
    if level:
        mixed = mixed[mixed >> np.uint64(64 - level) == 0]
    bit = (mixed % np.uint64(SKETCH_BITS)).astype(np.int64)
    parity = (np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view("<i8")


def near_enough(a: str, b: str) -> Column:
    """Whether the odd sketches of two classes (structs ``a`` and ``b`` of n, level, sketch, coarse) allow the threshold.

    ``coarse`` is the sketch one level up.  Sets at the threshold differ in size by a third at most, so levels that
    are further apart rule it out.
    """
    x, y = F.col(a), F.col(b)
    u = F.when(x["level"] >= y["level"], x["sketch"]).otherwise(x["coarse"])
    v = F.when(y["level"] >= x["level"], y["sketch"]).otherwise(y["coarse"])
    unequal = F.zip_with(u, v, lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    ones = F.aggregate(unequal, F.lit(0), lambda n, more: n + more)
    level = F.greatest(x["level"], y["level"])
    most = (x["n"] + y["n"]) * ((1 - THRESHOLD) / (1 + THRESHOLD)) / F.pow(F.lit(2.0), level)
    allowed = most + F.when(level > 0, SURE * F.sqrt(most)).otherwise(1e-6)
    sizes = (x["n"] >= THRESHOLD * y["n"]) & (y["n"] >= THRESHOLD * x["n"])
    return sizes & (F.abs(x["level"] - y["level"]) <= 1) & (ones <= allowed)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a digest of the word sequence, band keys and the odd sketches at its level and one up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()
        for batch in batches:
            counts, digests, bands, sketches, coarse = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = normal_words(text)
                shingles = shingle_set(words, hasher)
                counts.append(len(shingles))
                if not words:
                    digests.append(None)
                    bands.append([])
                    sketches.append([])
                    coarse.append([])
                    continue
                digests.append(digest_of(words))
                minima = signature(shingles)
                with np.errstate(over="ignore"):
                    key = np.zeros(BANDS, np.uint64)
                    for r in range(ROWS):
                        key = mix64(key * np.uint64(31) + minima.reshape(BANDS, ROWS)[:, r])
                    key = mix64(key + np.arange(BANDS, dtype=np.uint64))
                bands.append(key.view(np.int64))
                level = level_of(len(shingles))
                sketches.append(odd_sketch(shingles, level))
                coarse.append(odd_sketch(shingles, level + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())),
                    pa.array(coarse, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch", "coarse"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch array<long>, coarse array<long>"
    return narrow.mapInArrow(run, schema)


def _sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """id and packed sorted shingle hashes of the classes ``asked`` for (id, digest, doc_id of one text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()
        for batch in batches:
            words = [normal_words(t) for t in batch.column(1).to_pylist()]
            digests = [digest_of(w) for w in words]
            packed = [shingle_set(w, hasher).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(asked.select("doc_id"), "doc_id", "left_semi")
    # An id may come with several texts; the digest tells them apart, and repeated rows are one.
    found = chosen.mapInArrow(run, "digest binary, shingles binary").join(asked.select("digest", "id"), "digest")
    return found.groupBy("digest").agg(F.first("id").alias("id"), F.first("shingles").alias("shingles")).select("id", "shingles")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (a, b and other long columns) whose full sets reach the threshold."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= 75 * (len(u) + len(v) - both))
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    second = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(second, "b").join(first, "a").select(*names, "x", "y")
    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def link_classes(docs: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (id, component) of ``classes`` (id, digest, doc_id, bands, s) that the heads join, and all links (a, b) between groups.

    Heads, candidates and what is left open are narrow tables that are written in between, so that each plan is small and nothing
    is planned twice: with each of its stages the driver writes out a plan anew, and each broadcast in it costs it some megabytes.
    """
    every = classes.select("id", "doc_id", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
    placed = set_aside(every.join(shared, "key").withColumn("component", F.col("id")))
    labels = set_aside(placed.select("id", "doc_id").distinct().withColumn("component", F.col("id")))
    sketches = classes.select("id", "s")
    sets = set_aside(_sets(docs, classes.join(labels, "id", "left_semi").select("id", "digest", "doc_id")))

    for turn in range(STAR_ROUNDS + 1):
        # In each band one row is the head: first the smallest doc_id, then another one by chance in each round.
        # A band whose rows are in one group already stays so and leaves.
        lot = F.col("doc_id") if turn == 0 else F.xxhash64("id", F.lit(turn))
        heads = set_aside(mixed_bands(placed, F.min(F.struct(lot.alias("lot"), "id", "component")).alias("h")))
        if turn == STAR_ROUNDS:
            break
        asked = (
            placed.join(heads, "key").filter(F.col("component") != F.col("h.component"))
            .groupBy("id", F.col("h.id").alias("a"))
            .agg(F.count(F.lit(1)).alias("bands"), F.min("component").alias("cb"), F.min("h.component").alias("ca"))
        )
        # The heads that share most bands are the most similar ones; a row has at most BANDS of them.
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("bands")).alias("bands"), "a", "ca"))), 1, HEADS)
        pairs = (
            asked.groupBy("id", "cb").agg(best.alias("best"))
            .select(F.col("id").alias("b"), "cb", F.explode("best").alias("h")).select("h.a", "b", "h.ca", "cb")
        )
        near = set_aside(
            pairs.join(sketches.toDF("a", "sa"), "a").join(sketches.toDF("b", "sb"), "b")
            .filter(near_enough("sa", "sb")).select("a", "b", "ca", "cb")
        )
        if near.isEmpty():
            break
        links = set_aside(confirm(near, sets))
        if links.isEmpty():
            break
        # Groups found so far are single nodes: only what this round joins is walked.
        moved = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        labels = set_aside(
            labels.join(moved.toDF("component", "_to"), "component", "left")
            .select("id", "doc_id", F.coalesce("_to", "component").alias("component"))
        )
        still = placed.join(heads.select("key"), "key", "left_semi").select("id", "key")
        placed = set_aside(still.join(labels, "id"))

    # Heads and places belong together here: the loop ends before it changes the places.
    narrow = set_aside(placed.join(heads.select("key"), "key", "left_semi").select("key", "id", "component"))
    open_rows = narrow.join(classes.select("id", "bands", "s"), "id")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    # The sketches decide inside the join, and a pair comes up in the first of its common bands only.
    cross = set_aside(
        x.join(
            y,
            (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))
            & (F.col("x.component") != F.col("y.component")) & near_enough("x.s", "y.s")
            & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")),
        ).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    )
    return labels.select("id", "component"), cross if cross.isEmpty() else confirm(cross, sets)


def mixed_bands(placed: DataFrame, *more: Column) -> DataFrame:
    """Band keys whose rows are in more than one group."""
    low, high = F.min("component").alias("_lo"), F.max("component").alias("_hi")
    return placed.groupBy("key").agg(low, high, *more).filter("_lo < _hi").drop("_lo", "_hi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept."""
    rows = set_aside(describe(docs))
    good = rows.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    sketch = F.struct(
        F.col("n_shingles").alias("n"),
        F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_shingles") / SAMPLE))).cast("int").alias("level"), "sketch", "coarse",
    )
    # A class is a word sequence.  Its number stays the same, as the classes are written once.
    distinct = good.groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first(sketch).alias("s")
    )
    classes = set_aside(distinct.withColumn("id", F.monotonically_increasing_id()))
    named = set_aside(good.select("doc_id", "digest").distinct().join(classes.select("digest", "id"), "digest").select("doc_id", "id"))
    # Texts that share a doc_id tie their classes together.
    tied = named.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("_z")).filter("a < _z")
    same = named.join(tied, "doc_id").select("a", F.col("id").alias("b")).filter("a <> b")
    groups, links = link_classes(docs, classes)
    more = set_aside(links.union(same))
    if not more.isEmpty():
        stars = groups.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
        groups = components(stars.union(more))
    grouped = set_aside(named.join(groups, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component")))
    smallest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # All classes of a doc_id are in one component.
    of_doc = grouped.groupBy("doc_id").agg(F.first("component").alias("component")).join(smallest, "component").drop("component")
    return (
        rows.select("doc_id", "n_shingles")
        .join(of_doc, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )

"""Embedding near-dedup with randomised-rotation binary codes.

A unit vector is padded to at least ``CODE_BITS`` dimensions, rotated at random and kept as one sign per
dimension, with the stored correction factor f = <rotated vector, its signs> / sqrt(bits).  For another
unit vector q, rotated alike and kept as one signed byte per dimension, <q, signs> / (sqrt(bits) * f) is an unbiased
estimate of the cosine.  Its error has the spread sqrt((1 - f**2) / f**2 * (1 - cosine**2) / (bits - 1)), so a pair
whose estimate lies ``SURE`` spreads below the threshold is dropped.  Every other pair is recomputed exactly
in double precision, so no link is reported that is none.

Pairs are looked for in tables of short sign keys from further rotations.  Key length and number of
tables follow from the number of vectors and from the chance ``MISS`` of missing a pair that lies right at
the threshold.  Inside a key, pairs whose signs differ in far more places than the threshold's angle allows are not
made.  Equal vectors of one label are one class, with a number of its own, before anything is compared.

Defined results.  A null vector, a null or non-finite component, a zero or empty vector and a null label
link with nothing.  Vectors of different lengths do not link.  Rows that share a vec_id are vectors of their own
and reported one by one; a null vec_id links with nothing.  An empty table gives no row.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.llm.components import components
from feedspark.session import set_aside

THRESHOLD = 0.93
CODE_BITS = 256
WORDS = CODE_BITS // 64
# Standard deviations by which an estimate must miss the threshold before a pair is dropped.
SURE = 5.0
# Chance of missing a pair right at the threshold.
MISS = 1e-4
SEED = 11


def plan_tables(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits per key and number of tables for ``n`` vectors."""
    bits = min(24, max(8, math.ceil(math.log2(max(n, 2))) - 5))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def code_bits(dim: int) -> int:
    """Bits of a code: a rotation of that many dimensions loses nothing of the vector."""
    return max(CODE_BITS, 64 * math.ceil(dim / 64))


def rotation(dim: int, rows: int, seed: int) -> np.ndarray:
    """``dim`` by ``rows``: columns of random rotations, stacked as far as needed."""
    rng = np.random.default_rng([seed, dim])
    size = max(dim, min(rows, code_bits(dim)))
    blocks = []
    while sum(b.shape[1] for b in blocks) < rows:
        q, r = np.linalg.qr(rng.standard_normal((size, size)))
        blocks.append((q * np.sign(np.diag(r)))[:dim])
    return np.concatenate(blocks, axis=1)[:, :rows]


class Codes(NamedTuple):
    """What is stored of unit vectors, one row each."""

    signs: np.ndarray
    factor: np.ndarray
    rounded: np.ndarray
    scale: np.ndarray


def encode_vectors(vectors: np.ndarray) -> Codes:
    """Packed signs, correction factors, and the rotated vectors as signed bytes times a scale."""
    bits = code_bits(vectors.shape[1])
    turned = vectors @ rotation(vectors.shape[1], bits, SEED)
    factor = np.abs(turned).sum(axis=1) / (math.sqrt(bits) * np.linalg.norm(turned, axis=1))
    scale = np.abs(turned).max(axis=1) / 127
    rounded = np.rint(turned / scale[:, None]).astype(np.int8)
    return Codes(np.packbits(turned > 0, axis=1, bitorder="little"), factor, rounded, scale)


def table_keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Keys (n, tables) of unit vectors."""
    signs = (vectors @ rotation(vectors.shape[1], bits * tables, SEED + 1) > 0).reshape(len(vectors), tables, bits)
    return signs.astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def estimate(signs: np.ndarray, factor: np.ndarray, rounded: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the cosines of rows: one side's signs against the other side's rounded vectors."""
    bits = rounded.shape[1]
    plus = np.unpackbits(signs, axis=1, bitorder="little").astype(np.int32)
    inner = np.einsum("ij,ij->i", 2 * plus - 1, rounded.astype(np.int32)) * scale
    return inner / (math.sqrt(bits) * factor)


def error_bound(factor: np.ndarray, scale: np.ndarray, bits: int, threshold: float) -> np.ndarray:
    """By how much an estimate may fall short of a cosine at the threshold or above."""
    codes = (1 - factor**2) * (1 - threshold**2) / (bits - 1)
    rounding = scale**2 / 12
    return SURE * np.sqrt(codes + rounding) / factor


def _similar_signs(a: str, b: str, threshold: float) -> Column:
    """Whether the share of unequal signs leaves the angle of the threshold possible."""
    unequal = sum((F.bit_count(F.col(f"{a}.c{k}").bitwiseXOR(F.col(f"{b}.c{k}"))) for k in range(WORDS)), F.lit(0))
    share = math.acos(threshold) / math.pi
    return unequal <= CODE_BITS * (share + SURE * math.sqrt(share * (1 - share) / CODE_BITS))


def usable() -> Column:
    vector = F.col("embedding")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.col("label").isNotNull() & F.col("vec_id").isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))
        & F.exists(vector, lambda x: x != 0)
    )


def _unit_groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of a batch (.., embedding), one length at a time."""
    rows = batch.column("embedding")
    lengths = np.diff(rows.offsets.to_numpy())
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        flat = rows.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        flat = flat / np.abs(flat).max(axis=1, keepdims=True)
        yield at, flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _matrix(column: pa.Array, at: np.ndarray, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.take(pa.array(at)).to_pylist()), dtype).reshape(len(at), -1)


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, a < b) of ``classes`` that share a label and a table key and have similar signs."""
    bits, tables = plan_tables(classes.count(), threshold)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column("id").to_numpy(), np.asarray(batch.column("label").to_pylist(), object)
            for at, unit in _unit_groups(batch):
                n, dim = unit.shape
                words = encode_vectors(unit).signs[:, : 8 * WORDS].copy().view("<i8")
                keys = table_keys(unit, bits, tables)
                for k in range(0, tables, 8):
                    t = np.arange(k, min(k + 8, tables))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(ids[at], len(t))), pa.array(np.repeat(labels[at], len(t)), pa.string()),
                            pa.array(np.full(n * len(t), dim, np.int32)), pa.array(np.tile(t, n).astype(np.int32)),
                            pa.array(keys[:, t].ravel()), *[pa.array(np.repeat(words[:, w], len(t))) for w in range(WORDS)],
                        ],
                        names=["id", "label", "dim", "t", "key", *[f"c{w}" for w in range(WORDS)]],
                    )

    schema = "id long, label string, dim int, t int, key long, " + ", ".join(f"c{k} long" for k in range(WORDS))
    keyed = set_aside(classes.select("id", "label", "embedding").mapInArrow(keys_of, schema))
    x, y = keyed.alias("x"), keyed.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("label", "dim", "t", "key")]
    return (
        x.join(y, [*same, F.col("x.id") < F.col("y.id"), _similar_signs("x", "y", threshold)])
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .distinct()
    )


def doubtful(pairs: DataFrame, codes: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` whose estimated cosine does not rule the threshold out; they need exact recomputation."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rounded, left = batch.column("rounded"), np.zeros(len(batch), bool)
            lengths = pc.binary_length(rounded).to_numpy()
            factor, scale = batch.column("factor").to_numpy(), batch.column("scale").to_numpy()
            for bits in np.unique(lengths):
                at = np.flatnonzero(lengths == bits)
                signs, other = _matrix(batch.column("signs"), at, np.uint8), _matrix(rounded, at, np.int8)
                guess = estimate(signs, factor[at], other, scale[at])
                left[at] = guess + error_bound(factor[at], scale[at], int(bits), threshold) >= threshold
            yield batch.select(["a", "b"]).filter(pa.array(left))

    first = codes.select(F.col("id").alias("a"), "signs", "factor")
    second = codes.select(F.col("id").alias("b"), "rounded", "scale")
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "signs", "factor", "rounded", "scale")
    return joined.mapInArrow(decide, "a long, b long")


def links_between(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact links (a, b, a < b) among ``classes`` (id, label, embedding) with unequal ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for at, unit in _unit_groups(batch):
                code = encode_vectors(unit)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at]), pa.array([r.tobytes() for r in code.signs], pa.binary()), pa.array(code.factor),
                        pa.array([r.tobytes() for r in code.rounded], pa.binary()), pa.array(code.scale),
                    ],
                    names=["id", "signs", "factor", "rounded", "scale"],
                )

    codes = set_aside(
        classes.select("id", "embedding").mapInArrow(encode, "id long, signs binary, factor double, rounded binary, scale double")
    )
    near = doubtful(candidates(classes, threshold), codes, threshold)
    vector = F.col("embedding").cast("array<double>")
    largest = F.array_max(F.transform(vector, F.abs))
    scaled = F.transform(vector, lambda v: v / largest)
    unit = classes.select("id", scaled.alias("v"))
    first, second = unit.select(F.col("id").alias("a"), F.col("v").alias("va")), unit.select(F.col("id").alias("b"), F.col("v").alias("vb"))

    def dot(p: str, q: str) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, w: u * w), F.lit(0.0), lambda s, v: s + v)

    both = near.join(first, "a").join(second, "b")
    cosine = dot("va", "vb") / (F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb")))
    return both.filter(cosine >= threshold).select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    keyed = rows.withColumn("_ok", usable())
    good = keyed.filter("_ok")
    # Numbers of rows hold once they are written; the smallest vec_id would not tell classes apart.
    classes = set_aside(
        good.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("members"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    links = set_aside(links_between(classes, threshold))
    both = links.union(links.select("b", "a"))
    size = classes.select(F.col("id").alias("b"), "members")
    linked = both.join(size, "b").groupBy(F.col("a").alias("id")).agg(F.sum("members").alias("_others"))
    found = set_aside(components(links).join(classes.select("id", "first"), "id"))
    smallest = found.groupBy("component").agg(F.min("first").alias("_smallest"))
    reached = found.join(smallest, "component").select("id", "_smallest")
    described = (
        classes.join(linked, "id", "left").join(reached, "id", "left")
        .select(
            "label", "embedding",
            (F.coalesce("_others", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("_smallest", "first").alias("component_id"),
        )
    )
    matched = good.join(described, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = keyed.filter(~F.col("_ok")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return matched.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

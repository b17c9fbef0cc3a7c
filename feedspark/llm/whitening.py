"""Embedding whitening by Chebyshev-filtered subspace iteration.

Vectors become whole numbers, floor(256 c), and each distinct vector is fitted once.  With V the covariance of
these, the leading eigenvectors are sought without ever forming V: what is needed is V Q for a narrow
block Q, and one pass over the vectors gives it as the sum of (x - mean) ((x - mean) . Q), centred before
multiplying.  Each task adds up its own vectors and hands on one row per dimension.

A round filters the block by a Chebyshev polynomial of V, one pass per degree of its three-term recurrence.
The polynomial stays small from 0 to the smallest Ritz value of the block, the unwanted spectrum, and
grows fast above it.  Then the block is made orthonormal (QR) and one pass gives its Rayleigh-Ritz values and
vectors.  Rounds go on until the residuals |V q - theta q| of the wanted components are certified: at most
``CERTIFY`` of the largest eigenvalue, or at the limit of double precision, where ``PATIENCE`` rounds bring no
better ones.  The degree follows from how far the wanted values lie above the rest.

Only the block, dimensions x ``BLOCK`` x components numbers, is on the driver.

Defined results.  A null vector, one with a null or non-finite entry and an empty one are dropped.  Where lengths
differ, vectors of the most frequent length are whitened (of equally frequent ones the longest) and others are dropped.
Repeated rows and rows without an id are projected one by one.  Components without variance are left out, so a
table of one distinct vector, like an empty one, gives no row.  Tied eigenvalues give any basis of their space.  Extra
columns are ignored.  A deviation beyond 64 bits is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.session import set_aside

SCALE = 256
COMPONENTS = 4
# Vectors in the block per wanted component.
BLOCK = 8
CERTIFY = 1e-14
PATIENCE = 2
# Components with less than this share of the largest eigenvalue have no variance but rounding.
NO_VARIANCE = 1e-12
# A round shrinks the unwanted part by this factor, unless its polynomial gets too steep to keep the block independent.
SHRINK, STEEPEST = 1e6, 1e9
LOWEST_DEGREE, HIGHEST_DEGREE = 4, 40
SEED = 29


@dataclass(frozen=True)
class Whitening:
    """What a fit found: ``n`` distinct vectors with sums ``total``, and its components as columns."""

    n: int
    total: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def as_whole_numbers(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``, the rows whose vector has finite entries only."""
    entry = F.col("embedding").cast("array<double>")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(entry, lambda c: F.floor(c * SCALE).cast("long"))
    good = vectors.filter(F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def summed(x: DataFrame, width: int, of_rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``of_rows`` gives a matrix of ``width`` columns for some rows of ``x``; their sum over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                part = of_rows(matrix(batch.column(0)).astype(np.float64))
                held = part if held is None else held + part
        if held is not None:
            rows = pa.FixedSizeListArray.from_arrays(pa.array(held.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), rows], names=["j", "part"])

    parts = x.select("x").mapInArrow(run, "j int, part array<double>")
    columns = [F.sum(F.col("part")[k]).alias(f"c{k}") for k in range(width)]
    # As many rows as the matrix has, whatever the number of vectors.
    return np.array([r[1:] for r in sorted(parts.groupBy("j").agg(*columns).collect())], np.float64)


def whole_sums(x: DataFrame) -> tuple[int, tuple[int, ...]]:
    """How many vectors there are, and their exact sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held = 0, None
        for batch in batches:
            if batch.num_rows:
                part = matrix(batch.column(0)).sum(axis=0)
                n, held = n + batch.num_rows, part if held is None else held + part
        if held is not None:
            numbers = np.concatenate([[n], held])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(numbers), dtype=np.int32)), pa.array(numbers)], names=["j", "s"])

    rows = sorted(x.select("x").mapInArrow(run, "j int, s long").groupBy("j").agg(F.sum("s")).collect())
    return (rows[0][1], tuple(r[1] for r in rows[1:])) if rows else (0, ())


def degree_for(theta: np.ndarray, wanted: int, bound: float) -> int:
    """Degree that shrinks the unwanted part by ``SHRINK`` against the last wanted value."""

    def growth(value: float) -> float:
        t = max(2 * value / bound - 1, 1.0)
        return math.log(t + math.sqrt(t * t - 1))

    last, first = growth(theta[wanted - 1]), growth(theta[0])
    degree = math.ceil(math.log(SHRINK) / last) if last > 0 else HIGHEST_DEGREE
    if first > last:
        degree = min(degree, int(math.log(STEEPEST) / (first - last)))
    return min(max(degree, LOWEST_DEGREE), HIGHEST_DEGREE)


def chebyshev(times_v: Callable[[np.ndarray], np.ndarray], block: np.ndarray, bound: float, top: float, degree: int) -> np.ndarray:
    """The block filtered by the Chebyshev polynomial of [0, ``bound``], scaled to be about 1 at ``top``."""
    half = bound / 2
    first = scale = half / (top - half)
    before, now = block, (times_v(block) - half * block) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (times_v(now) - half * now) * (2 * after / half) - before * (scale * after)
        scale = after
    return now


def leading_components(times_v: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues, falling, and their unit eigenvectors as columns."""
    width = min(dim, BLOCK * wanted)
    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, width)))[0]
    best, waited = None, 0
    while True:
        image = times_v(block)
        small = block.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        top = max(theta[0], 0.0)
        left = np.linalg.norm(image[:, :wanted] - block[:, :wanted] * theta[:wanted], axis=0).max()
        if best is None or left < best[0] / 2:
            waited = 0
        else:
            waited += 1
        if best is None or left < best[0]:
            best = (left, theta[:wanted], block[:, :wanted])
        # A block as wide as the space holds every eigenvector already.
        if best[0] <= CERTIFY * top or waited >= PATIENCE or width == dim:
            return best[1], best[2]
        bound = max(theta[-1], 1e-6 * top)
        filtered = chebyshev(times_v, block, bound, top, degree_for(theta, wanted, bound))
        block = np.linalg.qr(filtered / np.linalg.norm(filtered, axis=0))[0]


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors ``x``; nothing without rows."""
    n, total = whole_sums(x)
    if not n:
        return None
    mean = np.array([s / n for s in total])

    def times_v(block: np.ndarray) -> np.ndarray:
        def part(rows: np.ndarray) -> np.ndarray:
            rows = rows - mean
            return rows.T @ (rows @ block)

        return summed(x, block.shape[1], part) / n

    trace = summed(x, 1, lambda rows: ((rows - mean) ** 2).sum(axis=0)[:, None]).sum() / n
    values, vectors = leading_components(times_v, len(mean), min(components, len(mean)))
    real = values > NO_VARIANCE * max(values[0], 0.0)
    return Whitening(n, total, vectors[:, real], values[real], float(trace))


def identity_error(x: DataFrame, found: Whitening) -> float:
    """Largest entry by which the covariance of the whitened vectors differs from the identity."""
    mean = np.array([s / found.n for s in found.total])
    to_white = found.vectors / np.sqrt(found.values)
    width = len(found.values)
    centre = summed(x, 1, lambda rows: ((rows - mean) @ to_white).sum(axis=0)[:, None])[:, 0] / found.n

    def part(rows: np.ndarray) -> np.ndarray:
        white = (rows - mean) @ to_white - centre
        return white.T @ white

    return float(np.abs(summed(x, width, part) / found.n - np.eye(width)).max())


def project(x: DataFrame, found: Whitening) -> DataFrame:
    """Each row of ``x`` (vec_id, x) on each component: vec_id, component, deviation, whitened."""
    n, total = found.n, found.total
    mean = np.array([s / n for s in total])
    to_white = found.vectors / np.sqrt(found.values)
    width = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(total, object)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(1))
            apart = max(abs(n * int(rows.max())) + max(map(abs, total)), abs(n * int(rows.min())) + max(map(abs, total)))
            if len(total) * apart**2 < 2**63:
                deviation = ((n * rows - whole.astype(np.int64)) ** 2).sum(axis=1)
            else:
                deviation = ((n * rows.astype(object) - whole) ** 2).sum(axis=1)
            white = (rows - mean) @ to_white
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), width))),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(rows))),
                    pa.array(np.repeat(deviation, width), pa.int64()),
                    pa.array(white.ravel()),
                ],
                names=["vec_id", "component", "deviation", "whitened"],
            )

    return x.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, deviation long, whitened double")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding) and component.

    vec_id, component, n, deviation, whitened, explained, identity_error.
    """
    x = as_whole_numbers(vectors)
    length = F.size("x")
    usual = x.groupBy(length.alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    found = None
    if usual is not None:
        x = x.filter(length == usual["size"])
        distinct = set_aside(x.select("x").distinct())
        found = fit(distinct, components)
    if found is None or not len(found.values):
        empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], empty)
    explained: Column = F.element_at(F.array(*[F.lit(float(e / found.trace)) for e in found.values]), F.col("component"))
    return project(x, found).select(
        "vec_id", "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(identity_error(distinct, found)).alias("identity_error"),
    )

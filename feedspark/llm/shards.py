"""Sharding by minimax contiguous partition of atomic groups.

Groups of equal texts stay together.  They are ordered by the SHA-256 of their text, so a document's
shard follows from its text and a few cut points, and no join is needed to place it.  The smallest
capacity at which a greedy pass needs no more than the given number of shards is found by binary
search; the cuts of that pass are the result.

The search never sees all groups.  It knows the cumulative size at the borders of hash-prefix
buckets (65,536 numbers), which bounds where a cut can fall: a pass that may cut anywhere shows that
a capacity is too small, a pass that cuts at borders only shows that one is large enough.  Buckets in
which a cut may still fall are split by one more byte, until both passes agree to the byte.

A group larger than an even share of what is left would starve its neighbours, so such groups (fewer
than the number of shards) get a shard each and the rest is divided over the remaining shards.

Defined results.  A null text counts no bytes, has no checksum (null) and its rows are one group, as are all empty texts.
Rows are placed one by one, so repeated rows are kept and get slots of their own.  Within a shard
slots follow doc_id (null first), then size and checksum; equal rows are interchangeable.  An empty
table gives no row.  A single row of any length is one group at least.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.operators.ranking import ordered_rank
from feedspark.session import set_aside

ROW_BYTES = 16
LAW = "bytes"


@dataclass(frozen=True)
class Buckets:
    """Consecutive buckets of the ordered groups: first prefix of each, cumulative size, whether one group."""

    first: list[bytes]
    ends: list[int]
    single: list[bool]

    def next_cut(self, at: int, capacity: int) -> tuple[int, int, int]:
        """Bounds of the farthest cut after ``at``, and the bucket in which it falls."""
        goal = at + capacity
        b = bisect.bisect_right(self.ends, goal)
        if b == len(self.ends):
            return self.ends[-1], self.ends[-1], b
        border = self.ends[b - 1] if b else 0
        return border, border if self.single[b] else goal, b

    def passes(self, capacity: int, shards: int, *, hopeful: bool, start: int = 0) -> list[int] | None:
        """Cuts of a greedy pass, or None if it needs more shards."""
        at, cuts, total = start, [], self.ends[-1]
        for _ in range(shards):
            low, high, _ = self.next_cut(at, capacity)
            at = high if hopeful else max(low, at)
            cuts.append(at)
            if at >= total:
                return cuts
        return None


def search(buckets: Buckets, low: int, high: int, shards: int) -> tuple[int, int]:
    """Narrow (low, high]: below ``low`` included no pass succeeds, at ``high`` one does."""
    a, b = low, high
    while b - a > 1:
        mid = (a + b) // 2
        if buckets.passes(mid, shards, hopeful=True) is None:
            a = mid
        else:
            b = mid
    low, a, b = a, a, high
    while b - a > 1:
        mid = (a + b) // 2
        if buckets.passes(mid, shards, hopeful=False) is None:
            a = mid
        else:
            b = mid
    return low, b


def _unclear(buckets: Buckets, low: int, high: int, shards: int) -> list[tuple[int, int]]:
    """Runs of buckets in which a cut of some capacity in (low, high] may fall."""
    near = far = 0
    runs: list[tuple[int, int]] = []
    total = buckets.ends[-1]
    for _ in range(shards):
        first = bisect.bisect_right(buckets.ends, near + low)
        near = max(near, buckets.next_cut(near, low)[0])
        _, far, last = buckets.next_cut(far, high)
        last = min(last, len(buckets.ends) - 1)
        if first <= last:
            if runs and first <= runs[-1][1] + 1:
                runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
            else:
                runs.append((first, last))
        if near >= total:
            break
    return runs


def _summary(groups: DataFrame, width: int) -> list[tuple[bytes, int, int]]:
    found = (
        groups.groupBy(F.substring("digest", 1, width).alias("p"))
        .agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        .collect()  # at most 256 rows per bucket asked for, and 65,536 at first
    )
    return sorted((bytes(r.p), r.bytes, r.n) for r in found)


def _assemble(parts: Sequence[tuple[bytes, int, bool]]) -> Buckets:
    sizes = np.cumsum([p[1] for p in parts]).tolist()
    return Buckets([p[0] for p in parts], sizes, [p[2] for p in parts])


def cut_points(groups: DataFrame, shards: int, largest: int) -> list[bytes]:
    """Prefixes at which a new shard begins, for ``groups`` (digest, bytes) and their largest size."""
    parts = [(p, size, n == 1) for p, size, n in _summary(groups, 2)]
    if not parts:
        return []
    width = 2
    buckets = _assemble(parts)
    low, high = max(largest, -(-buckets.ends[-1] // shards)) - 1, buckets.ends[-1]
    while True:
        low, high = search(buckets, low, high, shards)
        runs = [] if high - low == 1 else _unclear(buckets, low, high, shards)
        wanted = {k for a, b in runs for k in range(a, b + 1) if not parts[k][2]}
        if not wanted or width == 32:
            break
        width += 1
        spans = [
            (F.col("digest") >= F.lit(parts[a][0])) & (F.substring("digest", 1, len(parts[b][0])) <= F.lit(parts[b][0]))
            for a, b in runs
        ]
        inside = spans[0]
        for s in spans[1:]:
            inside = inside | s
        finer: dict[bytes, list[tuple[bytes, int, bool]]] = {}
        for p, size, n in _summary(groups.filter(inside), width):
            finer.setdefault(p[: width - 1], []).append((p, size, n == 1))
        parts = [x for k, part in enumerate(parts) for x in (finer[part[0]] if k in wanted else [part])]
        buckets = _assemble(parts)
    return even_cuts(buckets, high, shards)


def even_cuts(buckets: Buckets, capacity: int, shards: int) -> list[bytes]:
    """Cuts at known borders: none above ``capacity``, each as near to an even share as the rest allows.

    The plain greedy pass fills the first shards to the brim and leaves the last one what remains.
    A cut nearer to the even share is taken if a greedy pass still fits the rest in what is left.
    """
    total, at, cuts = buckets.ends[-1], 0, []
    for k in range(1, shards):
        brim = buckets.next_cut(at, capacity)[2]
        if brim >= len(buckets.ends):
            even = bisect.bisect_right(buckets.ends, at + (total - at) // (shards - k + 1))
            brim = len(buckets.ends) - 1
        else:
            even = bisect.bisect_right(buckets.ends, at + (total - at) // (shards - k + 1))
        low, high = min(even, brim), brim
        while low < high:  # the first border from the even share on after which the rest fits
            mid = (low + high) // 2
            begin = buckets.ends[mid - 1] if mid else 0
            if begin >= at and buckets.passes(capacity, shards - k, start=begin, hopeful=False) is not None:
                high = mid
            else:
                low = mid + 1
        at = max(at, buckets.ends[low - 1] if low else 0)
        cuts.append(buckets.first[low])
    return cuts


def _dominant(groups: DataFrame, shards: int) -> tuple[list[bytes], int]:
    """Groups above an even share of what is left (fewer than ``shards``), and the largest other group."""
    total = groups.agg(F.sum("bytes")).first()[0]
    top = groups.orderBy(F.desc("bytes"), "digest").limit(shards).collect()  # as many rows as shards
    alone: list[bytes] = []
    while len(alone) < min(shards - 1, len(top)):
        row = top[len(alone)]
        if row.bytes * (shards - len(alone)) <= total:
            break
        alone.append(bytes(row.digest))
        total -= row.bytes
    return alone, top[len(alone)].bytes if len(alone) < len(top) else 0


def with_sizes(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the size, checksum and digest of each row's text."""
    text = F.col("text").cast("string")
    return docs.select(
        *keep,
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(F.encode(text, "utf-8"), 256)), F.lit(b"")).alias("digest"),
    )


def shard_of(alone: Sequence[bytes], cuts: Sequence[bytes]) -> Column:
    """The shard of a digest: dominant groups first, then the contiguous ranges."""
    digest = F.col("digest")
    place = F.lit(len(alone))
    for c in cuts:
        place = place + (digest >= F.lit(bytearray(c))).cast("int")
    out = None
    for k, d in enumerate(alone):
        hit = digest == F.lit(bytearray(d))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return (place if out is None else out.otherwise(place)).cast("int")


def place_in_shards(docs: DataFrame, shards: int, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of each row, its size, checksum, law, shard and slot within the shard."""
    rows = set_aside(with_sizes(docs, keep))
    groups = set_aside(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    if groups.isEmpty():
        alone, cuts = [], []
    else:
        alone, largest = _dominant(groups, shards)
        others = groups.filter(~F.col("digest").isin([bytearray(a) for a in alone])) if alone else groups
        cuts = cut_points(others, shards - len(alone), largest)
    placed = rows.withColumn("shard", shard_of(alone, cuts)).drop("digest")
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    ranked = ordered_rank(placed, order, within=["shard"], name="slot")
    return ranked.withColumn("slot", F.col("slot") - 1).withColumn("law", F.lit(LAW))

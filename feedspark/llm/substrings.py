"""Exact substring dedup: every byte covered by a 100-byte string that also starts earlier.

1. Each 100-byte window is assigned to its anchor, the 32-byte string in it with the smallest hash.  Equal
   windows have equal anchors at equal places.  A run of windows with one anchor is a cell; a cell is known
   by its anchor's hash and a hash of all its bytes.  Anchors that occur once are dropped: their windows
   are unique.  Of equal cells all at a later place than the first are removed; they never need their text again.
2. What is left are different cells with a common anchor, mostly the edges of shared passages.  Their
   bytes are collected per anchor in buckets of bounded size.  A bucket is cut into shards; each shard
   gets a Burrows-Wheeler transform of its own, and the transforms are merged by refining their
   interleave: after round h the merged order is right for the first h symbols, because sorting the symbols of the
   present order stably prepends one symbol to every suffix.  A symbol is the five bytes before a suffix, so 20 rounds
   reach 100 bytes.  Borders between suffixes whose first bytes differ are carried along, so after the last round
   the stretches without a border are the repeated intervals, and no suffix of the bucket was sorted anew.
3. An anchor with more than ``HOT_CELLS`` different cells would make a bucket too large.  Its windows are
   compared one by one through a mergeable minimum over two 64-bit hashes.

Defined results.  A null or empty text has 0 bytes and keeps none.  Texts under 100 bytes keep all.  A row without
doc_id is judged by no other row and keeps all.  Rows that share a doc_id are at the same place: what starts at
the same byte of two of them is not earlier in either, so a repeated row repeats its result, and only windows
with a smaller (doc_id, start) elsewhere remove.  Different texts under one doc_id are each cut by their own
bytes.  An empty table gives no row.  Extra columns are
ignored.  Long texts are read in overlapping chunks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.common import RollingHash, mix64, shuffle_width
from feedspark.session import set_aside

LENGTH = 100
ANCHOR = 32
SPAN = LENGTH - ANCHOR + 1
CHUNK = 1 << 22
PLACE = np.uint64(24)
HOT_CELLS = 2048
BUCKET_BYTES = 1 << 18
SHARD_BYTES = 1 << 15
STEP = 5  # bytes that one round of a merge prepends
PACKED = 7  # codes of nine bits in 63 bits

CELLS = "kind int, route long, cell long, doc_id long, key long, lo long, n int"


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def cells_of(data: np.ndarray, hasher: RollingHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes, cell hashes, first window and number of windows of each cell of a text."""
    parts = []
    for begin in range(0, max(len(data) - LENGTH + 1, 0), CHUNK):
        part = data[begin : begin + CHUNK + LENGTH - 1]
        prefix = hasher.prefix(part)
        at = np.arange(len(part) - ANCHOR + 1)
        hashes = hasher.ranges(prefix, at, at + ANCHOR)
        keys = (hashes >> PLACE << PLACE) | at.astype(np.uint64)
        place = (sliding_min(keys, SPAN) & np.uint64((1 << 24) - 1)).astype(np.int64)
        lo = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        n = np.diff(np.append(lo, len(place)))
        anchor = place[lo]
        with np.errstate(over="ignore"):
            shape = ((anchor - lo) * 256 + n).astype(np.uint64)
            cell = mix64(hasher.ranges(prefix, lo, lo + n + LENGTH - 1) ^ mix64(shape))
        parts.append((hashes[anchor], cell, lo + begin, n))
    if not parts:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _cell_batch(kind, route, cell, doc, key, lo, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(route), kind, np.int32)), pa.array(route), pa.array(cell), pa.array(doc, pa.int64()),
            pa.array(key, pa.int64()), pa.array(lo, pa.int64()), pa.array(n.astype(np.int32)),
        ],
        names=["kind", "route", "cell", "doc_id", "key", "lo", "n"],
    )


def _later(new: np.ndarray, doc: np.ndarray, lo: np.ndarray, before: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, tuple[int, int]]:
    """Which rows of sorted groups lie after the first place of their group, and the last group's first place.

    ``before`` is the first place of the group that the rows begin in, if its start came earlier.
    """
    at = np.cumsum(new)
    begins = np.flatnonzero(new)
    first_doc, first_lo = np.append(before[0], doc[begins])[at], np.append(before[1], lo[begins])[at]
    return (doc != first_doc) | (lo != first_lo), (first_doc[-1], first_lo[-1])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of each text (kind 0).  Of equal cells in a batch only the first place is one; later ones are removals (1)."""
    hasher = RollingHash()
    for batch in batches:
        found, docs, keys = [], [], []
        for doc_id, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            buffer = text.as_buffer()
            if buffer is not None and buffer.size >= LENGTH:
                found.append(cells_of(np.frombuffer(buffer, np.uint8), hasher))
                docs.append(np.full(len(found[-1][0]), doc_id, np.int64))
                keys.append(np.full(len(found[-1][0]), key, np.int64))
        if not found:
            continue
        anchor, cell, lo, n = (np.concatenate(p) for p in zip(*found, strict=True))
        doc, key = np.concatenate(docs), np.concatenate(keys)
        order = np.lexsort((lo, doc, cell, anchor))
        anchor, cell, lo, n, doc, key = (x[order] for x in (anchor.view(np.int64), cell.view(np.int64), lo, n, doc, key))
        new = np.ones(len(doc), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])
        again, _ = _later(new, doc, lo)
        first = ~again
        yield _cell_batch(0, *(x[first] for x in (anchor, cell, doc, key, lo, n)))
        if again.any():
            yield _cell_batch(1, mix64(doc[again].astype(np.uint64)).view(np.int64), *(x[again] for x in (cell, doc, key, lo, n)))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From cells sorted by anchor, cell and place: removals (1), and cells that share an anchor with others (0)."""
    held: tuple | None = None  # the first cell of an anchor, until another cell of it is seen
    last_anchor = last_cell = None
    first = (0, 0)  # the first place of the last cell
    for batch in batches:
        kind, anchor, cell, doc, key, lo, n = (batch.column(k).to_numpy() for k in range(7))
        done = kind == 1
        if done.any():
            yield _cell_batch(1, *(x[done] for x in (anchor, cell, doc, key, lo, n)))
            anchor, cell, doc, key, lo, n = (x[~done] for x in (anchor, cell, doc, key, lo, n))
        if not len(anchor):
            continue
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_anchor[0] = anchor[0] != last_anchor
        new_cell = new_anchor.copy()
        new_cell[1:] |= cell[1:] != cell[:-1]
        new_cell[0] |= cell[0] != last_cell
        last_anchor, last_cell = anchor[-1], cell[-1]
        again, first = _later(new_cell, doc, lo, first)
        if again.any():
            yield _cell_batch(1, *(x[again] for x in (anchor, cell, doc, key, lo, n)))
        f = np.flatnonzero(~again)  # other texts at the first place stay beside the first one
        if not len(f):
            continue
        follows = ~new_anchor[f]
        shared = follows.copy()
        shared[:-1] |= follows[1:]
        if held is not None and follows[0]:
            yield _cell_batch(0, *(np.asarray([x]) for x in held))
        g = f[shared]
        if len(g):
            yield _cell_batch(0, *(x[g] for x in (anchor, cell, doc, key, lo, n)))
        k = f[-1]
        held = None if shared[-1] else (anchor[k], cell[k], doc[k], key[k], lo[k], n[k])


def packed(codes: np.ndarray, shifts: range) -> np.ndarray:
    """The codes at these distances from each place as one number, nine bits each; what follows an end is 0 like the end.

    Distances go round the ends of ``codes``.
    """
    out, inside = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
    for shift in shifts:
        code = np.roll(codes, -shift)
        inside &= code > 0
        out = out << 9 | np.where(inside, code, 0)
    return out


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` codes; the ends of strings (0) are unique and smallest."""
    have = min(depth, PACKED)
    key = packed(codes, range(have))
    order = np.argsort(key, kind="stable")  # equal codes up to an end: in the order of the ends
    ordered = key[order]
    new = ordered & 511 == 0
    new[1:] |= ordered[1:] != ordered[:-1]
    while True:
        rank = np.empty(len(codes), np.int64)
        rank[order] = np.cumsum(new)
        if have >= depth or new[1:].all():
            return order
        second = np.zeros(len(rank), np.int64)
        second[: max(len(rank) - have, 0)] = rank[have:]
        key = rank * (len(rank) + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        have *= 2


def transform(strings: list[bytes], step: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform of a shard, and its suffix places.

    A symbol is the ``step`` codes in front of a suffix (0 is the end of a string, bytes count from 1).
    """
    text = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    codes = text.astype(np.uint16) + 1
    codes[np.cumsum([len(s) + 1 for s in strings]) - 1] = 0
    order = suffix_order(codes, LENGTH)
    return packed(codes, range(-step, 0))[order], order


def repeated_intervals(shards: list[list[bytes]], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places in the joined text of all shards, and which share their first ``depth`` bytes, in merged order."""
    step = math.gcd(depth, STEP)
    built = [transform(s, step) for s in shards]
    sizes = [len(b) for b, _ in built]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(np.arange(len(built), dtype=np.uint16), sizes)  # stable sorts of 16 bits are radix sorts
    kinds, all_symbols = np.unique(np.concatenate([b for b, _ in built]), return_inverse=True)
    all_symbols = all_symbols.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32)
    ended = kinds & 511 == 0
    symbols = np.empty_like(all_symbols)
    group = np.zeros(offsets[-1], np.int32)
    for _ in range(depth // step):
        # Each shard is consumed in its own order, whatever the interleave.
        symbols[np.argsort(source, kind="stable")] = all_symbols
        order = np.argsort(symbols, kind="stable")
        source, ordered, before = source[order], symbols[order], group[order]
        border = ended[ordered]
        border[0] = True
        border[1:] |= (ordered[1:] != ordered[:-1]) | (before[1:] != before[:-1])
        group = np.cumsum(border, dtype=np.int32)
        if group[-1] == len(group):
            break
    places = np.empty(offsets[-1], np.int64)
    places[np.argsort(source, kind="stable")] = np.concatenate([p + o for (_, p), o in zip(built, offsets, strict=False)])
    return places, group


def _bucket_removals(strings: list[bytes], docs: np.ndarray, los: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) pairs of a bucket whose 100 bytes occur at an earlier place of the bucket."""
    shards: list[list[bytes]] = [[]]
    size = 0
    for s in strings:
        if size + len(s) > SHARD_BYTES and shards[-1]:
            shards.append([])
            size = 0
        shards[-1].append(s)
        size += len(s) + 1
    places, group = repeated_intervals(shards)
    same = np.concatenate([[False], group[1:] == group[:-1], [False]])
    repeated = same[1:] | same[:-1]
    places, group = places[repeated], group[repeated]
    starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
    string = np.searchsorted(starts, places, side="right") - 1
    offset = places - starts[string]
    whole = offset <= np.asarray([len(s) for s in strings])[string] - LENGTH
    string, offset, group = string[whole], offset[whole], group[whole]
    order = np.lexsort((los[string] + offset, docs[string], group))
    string, offset, group = string[order], offset[order], group[order]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    again = _later(new, docs[string], los[string] + offset)[0] if len(group) else new
    return string[again], offset[again]


def _runs(string: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a string as (string, first, number)."""
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    begin = np.ones(len(string), bool)
    begin[1:] = (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(begin)
    return string[at], offset[at], np.diff(np.append(at, len(string)))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells with their bytes, sorted by anchor -> removals (doc_id, key, lo, n)."""

    def flush(rows: list[tuple[int, int, int, int, bytes]]) -> pa.RecordBatch:
        docs, keys, los = (np.asarray([r[k] for r in rows]) for k in (1, 2, 3))
        string, first, n = _runs(*_bucket_removals([r[4] for r in rows], docs, los))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(docs[string], pa.int64()), pa.array(keys[string], pa.int64()),
                pa.array(los[string] + first, pa.int64()), pa.array(n.astype(np.int32)),
            ],
            names=["doc_id", "key", "lo", "n"],
        )

    rows: list[tuple[int, int, int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if size >= BUCKET_BYTES and row[0] != rows[-1][0]:
                yield flush(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield flush(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the cells as doc_id, start and two hashes."""
    hasher = RollingHash()
    for batch in batches:
        for _, doc, key, lo, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            bytes_ = np.frombuffer(data, np.uint8)
            at = np.arange(len(bytes_) - LENGTH + 1)
            with np.errstate(over="ignore"):
                flipped = hasher.ranges(hasher.prefix(bytes_ ^ np.uint8(0x5A)), at, at + LENGTH)
            plain = hasher.ranges(hasher.prefix(bytes_), at, at + LENGTH)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), doc, np.int64)), pa.array(np.full(len(at), key, np.int64)), pa.array(at + lo),
                    pa.array(plain.view(np.int64)), pa.array(flipped.view(np.int64)),
                ],
                names=["doc_id", "key", "lo", "h1", "h2"],
            )


def _cut(data: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, str, list[tuple[int, int]]]:
    """Bytes and maximal runs removed, the digest of what stays, and the runs."""
    spans: list[list[int]] = []
    for lo, n in sorted(ranges):
        end = lo + n - 1 + LENGTH
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([lo, end])
    digest, at, gone = hashlib.sha256(), 0, 0
    for a, b in spans:
        digest.update(data[at:a])
        gone, at = gone + b - a, b
    digest.update(data[at:])
    return gone, len(spans), digest.hexdigest(), [(a, b) for a, b in spans]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        texts, ranges = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        out = []
        for text, found in zip(texts, ranges, strict=True):
            data = text or b""
            out.append((len(data), *_cut(data, [(r["lo"], r["n"]) for r in found or []])))
        size, gone, n, digest, spans = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(n, pa.int64()),
                pa.array(digest, pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(span)),
            ],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"],
        )


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256 and the removed runs."""
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.col("text").cast("string"), "utf-8").alias("data")
    )
    fresh = rows.filter(F.col("doc_id").isNotNull() & (F.octet_length("data") >= LENGTH))
    # A row is told from others by its doc_id alone, and if texts share one, by a hash of its text too (``key``).
    digest = F.xxhash64("data")
    ids = fresh.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), (F.min(digest) != F.max(digest)).alias("_other")).filter("_n > 1")
    some = ids.agg(F.count(F.lit(1)).alias("repeated"), F.coalesce(F.bool_or("_other"), F.lit(False)).alias("other")).first()
    key = (digest if some.other else F.lit(0).cast("long")).alias("key")
    rows, fresh = rows.select("doc_id", "data", key), fresh.select("doc_id", "data", key)
    if some.repeated:
        fresh = fresh.dropDuplicates(["doc_id", "key"])
    cells = fresh.mapInArrow(_extract, CELLS)
    compared = set_aside(
        cells.repartition(width, "kind", "route").sortWithinPartitions("kind", "route", "cell", "doc_id", "lo")
        .mapInArrow(_compare, CELLS)
    )
    shared = compared.filter("kind = 0")
    crowded = shared.groupBy("route").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_CELLS).select("route", F.lit(True).alias("hot"))
    flagged = shared.join(crowded, "route", "left").select("doc_id", "key", F.struct("route", "lo", "n", F.coalesce("hot", F.lit(False)).alias("hot")).alias("c"))
    asked = flagged.groupBy("doc_id", "key").agg(F.collect_list("c").alias("cells"))  # within one document
    texts = fresh.join(asked.hint("merge"), ["doc_id", "key"]).withColumn("c", F.explode("cells"))
    cut = set_aside(
        texts.select(
            F.col("c.route").alias("route"), "doc_id", "key", F.col("c.lo").alias("lo"), F.col("c.hot").alias("hot"),
            F.substring("data", F.col("c.lo").cast("int") + 1, F.col("c.n") + (LENGTH - 1)).alias("bytes"),
        )
    )
    merged = (
        cut.filter("not hot").drop("hot").repartition(width, "route").sortWithinPartitions("route", "doc_id", "lo")
        .mapInArrow(_merge, "doc_id long, key long, lo long, n int")
    )
    removals = compared.filter("kind = 1").select("doc_id", "key", "lo", "n").unionByName(merged)
    if not crowded.isEmpty():
        windows = set_aside(
            cut.filter("hot").drop("hot").mapInArrow(_windows, "doc_id long, key long, lo long, h1 long, h2 long")
        )
        place = F.struct("doc_id", "lo")
        least = windows.groupBy("h1", "h2").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        again = windows.join(least, ["h1", "h2"]).filter(place > F.col("_first"))
        removals = removals.unionByName(again.select("doc_id", "key", "lo", F.lit(1).alias("n")))
    gathered = removals.groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "n")).alias("ranges"))  # within one document
    # What is removed grows with the input: it is never broadcast to the texts.
    return (
        rows.join(gathered.hint("merge"), ["doc_id", "key"], "left").select("doc_id", "data", "ranges")
        .mapInArrow(
            _finish,
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>",
        )
    )

"""Token-id output: fixed-width bit packing with block offsets.

A file holds, in this order:

* ``FSPB``, then blocks of ``BLOCK`` ids (the last one may be shorter).  An id takes ``width`` bits,
  least significant bit first; a block starts at a byte.
* the block offsets (uint64), the documents' ids (int64), whether they are null (uint8) and their
  first token positions in the file (uint64, one more than documents),
* a trailer: width, block size (uint32 each), ids, documents, blocks, place of the offsets (uint64 each), ``FSPB``.

Blocks are found by their offsets and unpacked as a whole with numpy, so any range of ids is read
without the ones before it.

Defined results.  A null or empty text has only the end id.  Null document ids come first; rows that
share a document id are ordered by their ids.  An empty table gives no file and no row.  Extra
columns of the input are ignored, whatever their names.  A text of any length is one document.
"""

from __future__ import annotations

import functools
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedspark.llm.common import file_uri, shuffle_width
from feedspark.session import set_aside, use_checkpoint_dir

MAGIC = b"FSPB"
BLOCK = 4096
TRAILER = struct.Struct("<IIQQQQ4s")
# Distinct words, and distinct parts of words, whose ids a worker keeps at most.
WORD_MEMORY = 600_000
# Marks that end a plain word; an apostrophe is none of them, as it starts a part of its own.
TAIL = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"


def width_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):  # the same bits, without going through single ones
        return ids.astype(f"<u{width // 8}", copy=False).tobytes()
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


class PackedWriter:
    """Writes blocks as they fill; the index follows at the end."""

    def __init__(self, sink, width: int) -> None:
        self.sink, self.width = sink, width
        self.at = sink.write(MAGIC)
        self.pending: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.blocks: list[int] = []
        self.doc_ids: list[int | None] = []
        self.starts: list[int] = [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.pending.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        self.starts.append(self.ids)
        if self.waiting >= 16 * BLOCK:
            self._flush(whole_only=True)

    def _flush(self, *, whole_only: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        end = len(ids) // BLOCK * BLOCK if whole_only else len(ids)
        for k in range(0, end, BLOCK):
            self.blocks.append(self.at)
            self.at += self.sink.write(pack(ids[k : min(k + BLOCK, end)], self.width))
        self.pending, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> None:
        self._flush(whole_only=False)
        index = self.at
        self.sink.write(np.asarray(self.blocks, "<u8").tobytes())
        self.sink.write(np.asarray([d or 0 for d in self.doc_ids], "<i8").tobytes())
        self.sink.write(np.asarray([d is None for d in self.doc_ids], "u1").tobytes())
        self.sink.write(np.asarray(self.starts, "<u8").tobytes())
        self.sink.write(
            TRAILER.pack(self.width, BLOCK, self.ids, len(self.doc_ids), len(self.blocks), index, MAGIC)
        )


class PackedReader:
    """Random access to a file's ids and to its list of documents."""

    def __init__(self, source) -> None:
        self.source, size = source, source.size()
        source.seek(size - TRAILER.size)
        self.width, self.block, self.n_ids, self.n_docs, n_blocks, index, magic = TRAILER.unpack(
            source.read(TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a file of packed ids")
        source.seek(index)
        self.offsets = np.frombuffer(source.read(8 * n_blocks), "<u8")
        self.doc_ids = np.frombuffer(source.read(8 * self.n_docs), "<i8")
        self.null_ids = np.frombuffer(source.read(self.n_docs), "u1").astype(bool)
        self.starts = np.frombuffer(source.read(8 * (self.n_docs + 1)), "<u8").astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the file; only the blocks that hold them are read."""
        parts = []
        for k in range(start // self.block, -(-end // self.block) if end > start else 0):
            first = k * self.block
            n = min(self.block, self.n_ids - first)
            self.source.seek(int(self.offsets[k]))
            found = unpack(self.source.read(-(-n * self.width // 8)), n, self.width)
            parts.append(found[max(0, start - first) : end - first])
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


class WordEncoder:
    """Ids of whole texts, with each distinct word and part of a word encoded once.

    The tokenizer drops white space and none of its steps looks across it, so a text's ids are
    those of its words in a row.  A word of plain Latin letters and a tail of marks splits into the
    two parts that the tokenizer's own pattern finds; any other word goes through the whole
    tokenizer.  Both memories stop taking words when full: the frequent ones come first.
    """

    def __init__(self, tokenizer_path: str, dtype: str = "<u4") -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.dtype = dtype
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.parts = Tokenizer(self.tokenizer.model)
        self.parts.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[bytes, bytes] = {}
        self.known_parts: dict[str, bytes] = {}

    @staticmethod
    def split(word: str) -> tuple[str, ...] | None:
        """The parts of a plain word in lower case, or None if only the tokenizer can tell."""
        core = word.rstrip(TAIL)
        if not core.isalpha():
            return None
        tail, core = word[len(core) :], core.lower()
        if max(core) >= "\u0250":
            return None
        return (core, tail) if tail else (core,)

    def _encode(self, tokenizer, items: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(items, add_special_tokens=False)
        return [np.asarray(e.ids, self.dtype).tobytes() for e in found]

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts = [w.decode() for w in words]
        split = [self.split(t) for t in texts]
        parts = self.known_parts
        new = list(dict.fromkeys(p for s in split if s for p in s if p not in parts))
        if new:
            fresh = dict(zip(new, self._encode(self.parts, new), strict=True))
            if len(parts) + len(new) <= WORD_MEMORY:
                parts.update(fresh)
            else:
                parts = _Either(fresh, parts)
        out = {w: b"".join([parts[p] for p in s]) for w, s in zip(words, split, strict=True) if s}
        rest = [(w, t) for w, t, s in zip(words, texts, split, strict=True) if not s]
        if rest:
            out.update(zip([w for w, _ in rest], self._encode(self.tokenizer, [t for _, t in rest]), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian numbers of ``dtype`` in a row."""
        split = [(t or "").encode().split() for t in texts]
        new = list(dict.fromkeys(w for words in split for w in words if w not in self.known))
        fresh: dict[bytes, bytes] = {}
        for k in range(0, len(new), 20_000):
            fresh.update(self._words(new[k : k + 20_000]))
        if len(self.known) + len(fresh) <= WORD_MEMORY:
            self.known.update(fresh)
            fresh = self.known
        else:
            fresh = _Either(fresh, self.known)
        return [b"".join(map(fresh.__getitem__, words)) for words in split]


class _Either(dict):
    """A small dictionary backed by a large one, without copying it."""

    def __init__(self, small: dict, large: dict) -> None:
        super().__init__(small)
        self.large = large

    def __missing__(self, key):
        return self.large[key]


@functools.cache
def encoder_of(tokenizer_path: str, dtype: str) -> WordEncoder:
    """One encoder per Python worker, shared by the tasks that it runs."""
    return WordEncoder(tokenizer_path, dtype)


def write_ids(
    docs: DataFrame, tokenizer_path: str, *, end_id: int = 1, folder: str | None = None, files: int | None = None
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write files of packed ids in ascending document order.

    Each task writes one file of a range of document ids to the shared folder, under a name of its
    own that is then renamed, so a repeated task replaces it with equal bytes.  Returns one row per
    file: file, path, n_docs, n_ids, start (ids in all files before).
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    n = files or shuffle_width(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = width_for(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1))
    stored = f"<u{2 if width <= 16 else 4}"
    if folder is None:
        use_checkpoint_dir(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/packed-{uuid.uuid4().hex}"
    folder = file_uri(folder)
    # At most one border per file: a bounded summary of the document ids.
    borders = np.unique(narrow.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n))) if n > 1 else []
    borders = np.asarray(borders, np.float64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer_path, stored), np.asarray([end_id], stored).tobytes()
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for k in range(0, len(batch), 256):
                ids = doc_ids.slice(k, 256)
                found = [e + end for e in encoder.encode(texts.slice(k, 256).to_pylist())]
                keys = np.asarray([-np.inf if i is None else i for i in ids.to_pylist()], np.float64)
                file = np.searchsorted(borders, keys, side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file), ids, pa.array(found, pa.binary())], names=["file", "doc_id", "ids"]
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row
            for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("file", "doc_id", "ids")), strict=True)
        )
        fs, root = pafs.FileSystem.from_uri(folder)
        for file, group in itertools.groupby(rows, lambda r: r[0]):
            fs.create_dir(root, recursive=True)
            path = f"{root}/ids-{file:06d}.bin"
            own = f"{path}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(own) as sink:
                writer = PackedWriter(sink, width)
                for _, doc_id, ids in group:
                    writer.add(doc_id, np.frombuffer(ids, stored))
                writer.close()
            fs.move(own, path)
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "file": file, "path": f"{folder}/ids-{file:06d}.bin",
                        "n_docs": len(writer.doc_ids), "n_ids": writer.ids,
                    }
                ],
                schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    encoded = narrow.mapInArrow(encode, "file int, doc_id long, ids binary")
    ordered = encoded.repartitionById(n, "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "ids")
    written = set_aside(ordered.mapInArrow(write, "file int, path string, n_docs long, n_ids long"))
    # One row per file, so this window is as small as the list of files.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_ids(files: DataFrame) -> DataFrame:
    """Read files of packed ids back: doc_id, start, n_tokens and the unsigned crc32 of the 32-bit ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(path) as source:
                    reader = PackedReader(source)
                    for k in range(0, reader.n_docs, 512):
                        end = min(k + 512, reader.n_docs)
                        starts = reader.starts[k : end + 1]
                        ids = reader.ids(int(starts[0]), int(starts[-1])).astype("<u4")
                        cut = starts - starts[0]
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in itertools.pairwise(cut)]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(reader.doc_ids[k:end], pa.int64(), mask=reader.null_ids[k:end]),
                                pa.array(starts[:-1] + row["start"], pa.int64()),
                                pa.array(np.diff(starts), pa.int64()),
                                pa.array(crc, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    width = shuffle_width(files.sparkSession)
    return files.repartitionById(width, "file").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )

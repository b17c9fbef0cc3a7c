"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch are joined to one text and its suffixes are sorted to the length of the longest piece.  Each
piece of the vocabulary is looked up by binary search: the suffixes that begin with it are one range.  All
occurrences are edges (start, end, piece); sorted by their end they are relaxed from left to right.

The model is a byte-pair one, so an edge may extend a prefix only if the pair of its last piece and the new one
is what merging would make of their joined text.  A row of pieces is the model's result exactly if each
neighbouring pair is, so for each place one edge survives and the path is the model's own encoding.
Characters outside the vocabulary are edges of their own and become byte pieces.

Two characters that stand side by side in no piece are never merged across.  Texts are cut at such places
(in front of white space and at line breaks if the vocabulary allows it, then inside words), so each part is encoded
once and remembered, up to ``WORD_MEMORY`` parts per Python worker.

Defined results.  A null or empty text has no ids and decodes to an empty text.  The escape character U+2581 decodes
to a space, as in the model itself.  Rows are independent: repeated rows repeat their result, an empty table gives no
row, extra columns are ignored, and texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
WORD_MEMORY = 600_000
PAIR_MEMORY = 1_000_000
# Bytes of joined words that are indexed at once.
INDEXED = 1 << 18
# No byte of UTF-8 text: sorts behind every suffix that begins with a piece.
AFTER = b"\xff"


class PieceModel:
    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        normal = [
            i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        self.ids = {names[i]: i for i in normal}
        # Merging prefers the piece with the higher score, so the rank of a piece is its negated score.
        self.rank = {names[i]: -model.get_score(i) for i in normal}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.text = [b""] * n
        for i in normal:
            self.text[i] = names[i].encode()
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])
        self.pieces = np.asarray(sorted(p.encode() for p in self.ids))
        self.piece_text = [*(p.decode() for p in self.pieces.tolist()), ""]
        self.begin = len(self.piece_text) - 1
        self.piece_ids = [[self.ids[p]] for p in self.piece_text[:-1]] + [[]]
        self.alphabet = {p for p in self.ids if len(p) == 1}
        self.outside: dict[str, int] = {}
        self.longest = int(self.pieces.dtype.itemsize)
        self.crossing = any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.known: dict[str, bytes] = {}
        self.known_parts: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def parts(self, word: str) -> list[str]:
        """The word cut between characters that stand side by side in no piece: nothing merges across."""
        out, begin, inside = [], 0, self.inside
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inside:
                out.append(word[begin:i])
                begin = i
        return [*out, word[begin:]]

    def merge(self, text: str) -> list[str]:
        """The model's merging of a short text: always the best pair, the leftmost among equals."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces may stand side by side; ``self.begin`` on the left is the start of a word."""
        if len(self.pairs) >= PAIR_MEMORY:
            self.pairs.clear()
        x, y = self.piece_text[left], self.piece_text[right]
        found = self.merge(x + y) == ([x, y] if x else [y])
        self.pairs[left << 24 | right] = found
        return found

    def strange(self, char: str) -> int:
        """A number for a character outside the vocabulary, so that it can be an edge."""
        found = self.outside.get(char)
        if found is None:
            found = self.outside[char] = len(self.piece_text)
            self.piece_text.append(char)
            self.piece_ids.append([self.bytes[b] for b in char.encode()])
        return found

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of every occurrence in the joined words, sorted by end and start (byte places)."""
        joined = b"".join(w.encode() + AFTER for w in words)
        text = np.frombuffer(joined + AFTER * self.longest, np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(text, self.longest)[: len(joined)]
        suffixes = np.ascontiguousarray(windows).view(f"S{self.longest}").ravel()
        order = np.argsort(suffixes, kind="stable")
        ordered = suffixes[order]
        low = np.searchsorted(ordered, self.pieces, "left")
        high = np.searchsorted(ordered, np.asarray([p + AFTER for p in self.pieces.tolist()]), "left")
        # A suffix cut right behind the piece begins with it, too, and sorts at the upper border.
        closed = np.asarray([p.ljust(self.longest, AFTER) for p in self.pieces.tolist()])
        high = np.maximum(high, np.searchsorted(ordered, closed, "right"))
        count = high - low
        piece = np.repeat(np.arange(len(count)), count)
        start = order[np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
        end = start + np.char.str_len(self.pieces)[piece]
        extra = [
            (at, at + len(c.encode()), self.strange(c))
            for w, at in zip(words, self.begins(words).tolist(), strict=True)
            if not self.alphabet.issuperset(w)
            for c, at in zip(w, np.cumsum([at, *(len(c.encode()) for c in w[:-1])]).tolist(), strict=True)
            if c not in self.alphabet
        ]
        if extra:
            start, end, piece = (np.concatenate([x, y]) for x, y in zip((start, end, piece), zip(*extra), strict=True))
        by_end = np.lexsort((start, end))
        return start[by_end], end[by_end], piece[by_end]

    @staticmethod
    def begins(words: list[str]) -> np.ndarray:
        """Where each word starts in the joined bytes."""
        return np.cumsum([0, *(len(w.encode()) + 1 for w in words[:-1])])

    def relax(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian 32-bit numbers."""
        begins = self.begins(words).tolist()
        size = begins[-1] + len(words[-1].encode()) + 1
        last, before = [-1] * size, [-1] * size  # the piece that ends at a place, and where it begins
        for at in begins:
            last[at] = self.begin
        known, fits = self.pairs, self.fits
        for start, end, piece in zip(*(x.tolist() for x in self.edges(words)), strict=True):
            if last[end] < 0 and last[start] >= 0:
                fit = known.get(last[start] << 24 | piece)
                if fits(last[start], piece) if fit is None else fit:
                    last[end], before[end] = piece, start
        out = []
        for at, word in zip(begins, words, strict=True):
            place, path = at + len(word.encode()), []
            while place != at:
                path.append(last[place])
                place = before[place]
            ids = [i for piece in reversed(path) for i in self.piece_ids[piece]]
            out.append(np.asarray(ids, "<i4").tobytes())
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.crossing:
            return self.relax([SPACE + t.replace(" ", SPACE) for t in texts if t]) if all(texts) else [
                self.encode([t])[0] if t else b"" for t in texts
            ]
        split = [UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = list(dict.fromkeys(u for units in split for u in units if u not in self.known))
        cut = [self.parts(u) for u in new]
        known_parts = self.known_parts
        missing = list(dict.fromkeys(p for c in cut for p in c if p not in known_parts))
        found: dict[str, bytes] = {}
        part: list[str] = []
        size = 0
        for k, p in enumerate(missing):
            part.append(p)
            size += len(p)
            if size >= INDEXED or k == len(missing) - 1:
                found.update(zip(part, self.relax(part), strict=True))
                part, size = [], 0
        if len(known_parts) + len(found) <= WORD_MEMORY:
            known_parts.update(found)
        fresh = {
            u: b"".join([found[p] if p in found else known_parts[p] for p in c]) for u, c in zip(new, cut, strict=True)
        }
        if len(self.known) + len(fresh) <= WORD_MEMORY:
            self.known.update(fresh)
            return [b"".join([self.known[u] for u in units]) for units in split]
        known = self.known
        return [b"".join([fresh[u] if u in fresh else known[u] for u in units]) for units in split]

    def decode(self, ids: list[int]) -> str:
        """Pieces side by side; the space put before the text is taken away again."""
        text = b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@functools.cache
def model_of(model_path: str) -> PieceModel:
    """One model per Python worker, shared by the tasks that it runs."""
    gc.disable()  # its memories hold no cycles
    return PieceModel(model_path)


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, the ids of each text, their number, the decoded text's length and whether it equals the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                texts = batch.column(1).to_pylist()
                found = [np.frombuffer(b, "<i4") for b in model.encode(texts)]
                decoded = [model.decode(ids.tolist()) for ids in found]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in found])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array([len(i) for i in found], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))),
                        pa.array([len(d) for d in decoded], pa.int64()),
                        pa.array([d == (t or "") for d, t in zip(decoded, texts, strict=True)]),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded_chars", "restored"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_chars long, restored boolean")

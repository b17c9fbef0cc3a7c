"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

Ordinary words cost few tokens: a vocabulary learnt from text covers four characters or so per token.
Random strings cost one token for one or two characters.  A run of key-like characters is first cut at the
base spans in it, and each rest of at least ``MIN_LENGTH`` characters is judged.  It is ``random`` as a whole
if it has fewer than ``MAX_RATIO`` characters per token.  If not, as names and paths around a key dilute the
ratio, the same is asked of each part between ``=``, ``/``, ``.`` and ``-``, and of the stretches of pieces
(letters and digits) with most tokens over their characters, so that a key with dividers in it is found as well.

What is reported mixes letters with digits or both cases.  Known digests (hexadecimal of a usual digest
length), UUIDs and identifiers (pieces that are all words or numbers) are not reported; the text beside a
digest or UUID is judged without it.

Defined results.  A null or empty text has no span.  Positions are code points, the end exclusive.
Rows are independent: repeated rows repeat their result, an empty table gives no row, extra columns
are ignored whatever their names, and a text of any length is scanned whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 20
MAX_RATIO = 2.0
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
# Characters of hexadecimal MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
IDENTIFIER = re.compile(r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]+)(?:[_./=+-]+(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]+))*[_./=+-]*\Z")
PART = re.compile(r"[^=/.-]+")
PIECE = re.compile(UUID.pattern.removesuffix(r"\Z") + "(?![A-Za-z0-9])|[A-Za-z0-9]+")
MIXED = re.compile(r"(?=.*[A-Za-z])(?=.*[0-9])|(?=.*[a-z])(?=.*[A-Z])")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the base patterns, by start and then by kind."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # A run of 32 starts at the run's beginning, as the character before it is no part of it.
    found += [(*m.span(), "hex") for m in HEX_LONG.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


class TokenEfficiency:
    """Characters per token under a byte-level vocabulary of ranks."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: str) -> float:
        return len(run) / max(1, self.tokens(run))

    def tokens(self, run: str) -> int:
        return len(self.encoding.encode_ordinary(run))


def is_excluded(run: str) -> bool:
    """Known digests and identifiers."""
    if DIGEST.match(run) and len(run) in DIGEST_LENGTHS:
        return True
    return bool(UUID.match(run) or IDENTIFIER.match(run))


def uncovered(start: int, end: int, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """What is left of a stretch without the base spans, which are sorted by start."""
    for a, b, _ in base:
        if a >= end:
            break
        if b > start:
            if a > start:
                yield start, a
            start = b
    if start < end:
        yield start, end


def best_stretches(pieces: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """All maximal stretches with a positive sum, of pieces (start, end, score), in one pass (Ruzzo and Tompa)."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total = 0.0
    for start, end, score in pieces:
        before, total = total, total + score
        if score <= 0:
            continue
        new = (start, end, before, total)
        # Sums before what was passed over are no smaller than a later candidate's, so each is looked at once.
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k -= 1
            if k < 0 or found[k][3] >= new[3]:
                break
            new = (found[k][0], end, found[k][2], total)
            del found[k:]
        found.append(new)
    return [(a, b) for a, b, _, _ in found]


def random_in(run: str, scorer: TokenEfficiency) -> list[tuple[int, int]]:
    """The random stretches of a run without base spans."""

    def random(a: int, b: int) -> bool:
        part = run[a:b]
        return b - a >= MIN_LENGTH and bool(MIXED.match(part)) and not is_excluded(part)

    first, last = len(run) - len(run.lstrip("./=-")), len(run.rstrip("./=-"))
    if last - first < MIN_LENGTH:
        return []
    pieces = [m.span() for m in PIECE.finditer(run)]
    known = [(a, b) for a, b in pieces if DIGEST.match(run[a:b]) and b - a in DIGEST_LENGTHS or UUID.match(run[a:b])]
    if not known and random(first, last) and scorer.ratio(run[first:last]) < MAX_RATIO:
        return [(first, last)]
    found = []
    edges = [0, *(x for span in known for x in span), len(run)]
    for low, high in zip(edges[::2], edges[1::2], strict=True):
        parts = ((low + m.start(), low + m.end()) for m in PART.finditer(run[low:high]))
        found += [(a, b) for a, b in parts if random(a, b) and scorer.ratio(run[a:b]) < MAX_RATIO]
        scored = [(a, b, MAX_RATIO * scorer.tokens(run[a:b]) - (b - a)) for a, b in pieces if low <= a and b <= high]
        found += [(a, b) for a, b in best_stretches(scored) if random(a, b)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def random_spans(text: str, base: list[tuple[int, int, str]], scorer: TokenEfficiency) -> list[tuple[int, int, str]]:
    out, k, merged = [], 0, []
    for a, b, kind in base:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), kind)
        else:
            merged.append((a, b, kind))
    for m in RUN.finditer(text):
        while k < len(merged) and merged[k][1] <= m.start():
            k += 1
        last = k
        while last < len(merged) and merged[last][0] < m.end():
            last += 1
        for start, end in uncovered(*m.span(), merged[k:last]):
            out += [(start + a, start + b, "random") for a, b in random_in(text[start:end], scorer)]
    return out


def scan_secrets(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Scan ``docs`` (doc_id, text): counts, a digest of the base spans, and all spans as structs."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
            ("base_sha256", pa.string()), ("found", pa.list_(span)),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TokenEfficiency(ranks_path, pattern)
        for batch in batches:
            rows = []
            for doc_id, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = given or ""
                base = base_spans(text)
                spans = base + random_spans(text, base, scorer)
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                row = {f"n_{k}": sum(s[2] == k for s in base) for k in KINDS[:3]}
                row["doc_id"] = doc_id
                row["base_sha256"] = hashlib.sha256(spans_text(base).encode()).hexdigest()
                row["found"] = [{"kind": k, "start": a, "end": b} for a, b, k in spans]
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<kind: string, start: long, end: long>>"
    return narrow.mapInArrow(scan, out)


def redact_secrets(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``docs`` with all columns; each covered stretch of ``text`` is replaced by ``[SECRET]``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = TokenEfficiency(ranks_path, pattern)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + random_spans(text or "", base, scorer))
                texts.append(redact(text, spans) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """Replace each maximal covered stretch by ``mark``."""
    out, at, k = [], 0, 0
    while k < len(spans):
        start, end = spans[k][:2]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], mark]
        at, k = end, k + 1
    return "".join([*out, text[at:]])

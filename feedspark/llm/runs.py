"""Periodic runs of words, by a dictionary of basic factors.

The basic factors of a text are its stretches of 2**k words.  Level k names the factor at each place by a number,
and level k + 1 names pairs of them, so equal numbers mean equal stretches whatever their length.  A place
whose factor occurs once is left out of all higher levels.

At level k the next occurrence of each factor is looked up.  One that lies at most L = 2**k words ahead fits with it into a
stretch of 2 L words; such occurrences form arithmetic progressions whose step is a period.  Only steps above
L / 2 are taken there, so each period belongs to one level and no run comes up twice.  Neighbouring places
with the same step d are one run: from the first of them to L + d words behind the last.  It cannot be
extended, for the place before or behind would have the same step, and d is its smallest period, as a smaller one
would give an earlier occurrence.  Every run of at least three periods is found this way: at its own level
it holds L + d words or more.

Each text is worked on alone, with a few numbers per word and O(n log n) steps, so nothing is shuffled and a lost task
costs only its texts.

Defined results.  A null or empty text has no words and no runs.  Repeated rows and rows without an id are reported one by
one.  Bytes that are no UTF-8 are kept as they are.  An empty table gives no row.  Of other columns only those asked for are
kept.  Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import bind
from feedspark.llm.common import free_name, words_of

# A run has at least this many words and this many periods.
FEWEST_WORDS = 24
FEWEST_PERIODS = 3

RUN = "array<struct<start:long,length:long,period:long>>"


def word_numbers(words: Sequence[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def find_runs(numbers: np.ndarray, shortest: int = FEWEST_WORDS) -> np.ndarray:
    """Rows (start, length, period) of the runs of three periods or more, by start, then period."""
    n = len(numbers)
    name, place, found = numbers, np.arange(n), [np.empty((0, 3), np.int64)]
    length = 1
    # The next level's smallest step is length // 2 + 1.
    while len(place) and FEWEST_PERIODS * (length // 2 + 1) <= n:
        order = np.argsort(name, kind="stable")
        name, at = name[order], place[order]
        again = name[1:] == name[:-1]
        step = at[1:] - at[:-1]
        hit = again & (step <= length) & (2 * step > length)
        found.append(progressions(at[:-1][hit], step[hit], length))

        twice = np.zeros(len(at), bool)
        twice[1:] |= again
        twice[:-1] |= again
        fresh = np.cumsum(np.append(0, ~again))
        at_place = np.full(n + length, -1)
        at_place[at[twice]] = fresh[twice]
        first = np.sort(at[twice])
        second = at_place[first + length]
        first, second = first[second >= 0], second[second >= 0]
        name, place, length = at_place[first] * (n + 1) + second, first, 2 * length
    runs = np.concatenate(found)
    runs = runs[(runs[:, 1] >= shortest) & (runs[:, 1] >= FEWEST_PERIODS * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def progressions(place: np.ndarray, step: np.ndarray, length: int) -> np.ndarray:
    """Neighbouring places with one step, joined to runs."""
    if not len(place):
        return np.empty((0, 3), np.int64)
    order = np.argsort(place)
    place, step = place[order], step[order]
    opens = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (step[1:] != step[:-1])])
    start, d = place[opens], step[opens]
    last = place[np.append(np.flatnonzero(opens)[1:], len(place)) - 1]
    return np.column_stack([start, last - start + d + length, d])


def repeated_places(runs: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) > 0


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), *, shortest: int = FEWEST_WORDS) -> DataFrame:
    """``keep``, the ``runs`` of each ``text``, and its words without repeated periods, ``collapsed`` by one space."""
    text = free_name(keep, "text")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, rows, collapsed = [0], [np.empty((0, 3), np.int64)], []
            for value in batch.column(len(keep)):
                # bytes.split knows just the six separators.
                words = (value.as_py() or b"").split()
                runs = find_runs(word_numbers(words), shortest)
                if len(runs):
                    drop = repeated_places(runs, len(words))
                    words = [w for w, gone in zip(words, drop, strict=True) if not gone]
                counts.append(len(runs))
                rows.append(runs)
                collapsed.append(b" ".join(words))
            flat = np.concatenate(rows)
            fields = [pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)]
            listed = pa.ListArray.from_arrays(
                pa.array(np.cumsum(counts), pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            )
            kept = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, listed, pa.array(collapsed, pa.binary())], names=[*keep, "runs", "collapsed"]
            )

    narrow = docs.select(*keep, F.col("text").cast("string").cast("binary").alias(text))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return narrow.mapInArrow(search, f"{kept}, runs {RUN}, collapsed binary")


def strongest(runs: Column) -> Column:
    """The run with most periods; of equal ones the first in the list."""
    return F.aggregate(
        runs,
        F.get(runs, 0),
        lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best),
    )


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """The texts of the query: those whose id's checksum ends in 0 repeat a stretch of words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        unit = F.slice(words, (a + 1).cast("int"), p.cast("int"))
        tail = F.flatten(F.array_repeat(unit, F.ceil((n - a) / p).cast("int")))
        planted = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int")))
        return F.when(n > 0, F.array_join(planted, " "))

    return docs.withColumn("text", F.when(h % 10 == 0, bind(words_of(F.col("text")), repeat)).otherwise(F.col("text")))


def digest_runs(found: DataFrame) -> DataFrame:
    """Counts, the strongest run and digests of what ``periodic_runs`` gives."""
    listed = F.transform("runs", lambda r: F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda t: F.concat(t, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

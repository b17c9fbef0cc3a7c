"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows of the learning part are dealt into three folds by a checksum of their id.  The first gives
the learned lexicon: words and word beginnings that come up in clearly more toxic than clean texts, by a lower confidence bound
of the log odds of document counts.  The second trains boosted trees on the features below.  The third
calibrates: predictions go to ``BINS`` bins, pooled to a rising step curve, so a score is a share of toxic texts.
Trees never see the texts that their lexicon was taken from, and the curve sees neither's.

Features of a text (all words, first to last):

* density and number of words that are in ``INSULTS`` or in the learned lexicon, and the greatest number in any
  ``WINDOW`` words, so one abusive passage of a long text counts;
* share of words in the lexicon that stand within ``NEAR`` words of a second-person pronoun, and their density;
* shares of capitals among letters and of words in capitals;
* shares of exclamation and question marks, and of words that end in several of them;
* shares of words with digits or marks inside letters or with a letter three times in a row, and of words
  that are in the lexicon only after such disguise is taken off;
* logarithm of the number of words.

At most about ``MOST_LABELLED`` labelled rows are learned from: with more, a share of them is chosen by a hash of their id.
Every text is scored.  Label, language, source and id are no features.

Defined results.  A null text counts as empty and is scored.  Repeated rows and rows without an id are scored one by
one; a row without an id is neither held out nor learned from.  A label other than 0 or 1 is not used; ids labelled twice
count by their greatest label.  Without both classes among the learned labels every score is the share of toxic labels
(0 without labels).  An empty table gives no row.  Extra columns are ignored.  Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.session import set_aside

# Common insults and second-person pronouns of the four languages.
INSULTS = frozenset(
    "idiot idiots moron morons imbecile stupid dumb fool loser losers pathetic worthless disgusting trash garbage scum clown "
    "ugly jerk bastard freak creep pig "
    "trottel dummkopf blödmann abschaum versager widerlich wertlos erbärmlich hässlich schwachkopf "
    "crétin imbécile abruti ordure minable dégoûtant pathétique salaud débile "
    "estúpido imbécil basura escoria payaso patético asqueroso inútil perdedor tonto".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú usted ustedes ti vosotros".split()
)

MOST_LABELLED = 200_000
THRESHOLD = 0.3
NEAR, WINDOW = 5, 25
# Lengths of word beginnings in the learned lexicon.
STEMS = (4, 5, 6)
# A lexicon entry is in at least so many toxic texts, and surely (by ``SURE`` deviations) e**ODDS times as often as in clean ones.
FEWEST_TOXIC, SURE, ODDS = 4, 2.5, 1.0
# The surest entries; a bound of what goes to every task.
MOST_ENTRIES = 20_000
TREES, DEPTH, STEP = 20, 3, 0.3
BINS = 200
SEED = 3

FEATURES = (
    "insult_share", "lexicon_share", "hits", "peak", "near_person_share", "person_share", "capital_share", "shouted_share",
    "mark_share", "ended_share", "disguised_share", "unmasked_share", "length",
)

_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_MARKS_INSIDE = re.compile(r"[^\W\d_][\d@$!|*._\-+]+[^\W\d_]")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_REPEAT = re.compile(r"(.)\1+")
_NO_LETTERS = re.compile(r"[\W_]+")
# Signs that stand for letters.
_LEET = str.maketrans("013457@$!|", "oieastasil")


# What a word is marked with, and a bound of the letters counted in one word.
HIT, INSULT, PERSON, SHOUTED, ENDED, DISGUISED, REVEALED = (1 << k for k in range(7))
MOST_LETTERS = 2**27 - 1
# Words that a Python worker remembers.
REMEMBERED = 300_000


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    stems: frozenset[str]

    def holds(self, word: str) -> bool:
        return word in self.words or any(word[:k] in self.stems for k in STEMS if len(word) >= k)


@dataclass(frozen=True)
class Scorer:
    """A fitted classifier; ``trees`` is missing where there was nothing to learn."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    # Score of each bin of raw predictions.
    curve: tuple[float, ...]


def bare(word: bytes) -> str:
    """A word in lower case without marks at its ends."""
    return _EDGES.sub("", word.decode("utf-8", "replace").lower())


def unmasked(word: str) -> list[str]:
    """What a disguised word may stand for; nothing if it wears no disguise."""
    plain = _REPEAT.sub(r"\1", word) if _TRIPLE.search(word) else word
    if not _MARKS_INSIDE.search(word):
        return [plain, _TRIPLE.sub(r"\1\1", word)] if plain != word else []
    return [_NO_LETTERS.sub("", plain.translate(_LEET)), _NO_LETTERS.sub("", plain)]


def entries(word: str) -> list[str]:
    """The word and its beginnings, marked by a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


class Marked(dict):
    """Word -> its marks in the low bits, its capitals and letters above them.  Words seen are remembered, within a bound."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self._lexicon = lexicon

    def __missing__(self, raw: bytes) -> int:
        text, word = raw.decode("utf-8", "replace"), bare(raw)
        insult = word in INSULTS
        hit = insult or self._lexicon.holds(word)
        disguised = revealed = False
        if len(word) > 2 and not word.isalpha() or _TRIPLE.search(word):
            maybe = unmasked(word)
            disguised = bool(maybe)
            revealed = not hit and any(m in INSULTS or self._lexicon.holds(m) for m in maybe)
        marks = (hit or revealed) * HIT + insult * INSULT + (word in SECOND_PERSON) * PERSON
        marks += (len(word) > 1 and text.isupper()) * SHOUTED + (text[-2:] in ("!!", "??", "!?", "?!")) * ENDED
        marks += disguised * DISGUISED + revealed * REVEALED
        capitals, letters = (min(sum(map(f, text)), MOST_LETTERS) for f in (str.isupper, str.isalpha))
        code = marks | capitals << 8 | letters << 35
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = code
        return code


def features(text: bytes, marked: Marked) -> list[float]:
    # bytes.split knows just the six separators.
    words = text.split()
    code = np.fromiter(map(marked.__getitem__, words), np.int64, len(words))
    n = max(len(words), 1)

    def share(mark: int) -> float:
        return np.count_nonzero(code & mark) / n

    at = np.flatnonzero(code & HIT)
    peak = near = 0
    if len(at):
        peak = int((np.searchsorted(at, at + WINDOW) - np.arange(len(at))).max())
        who = np.concatenate([[-(10**9)], np.flatnonzero(code & PERSON), [10**12]])
        after = np.searchsorted(who, at)
        near = int((np.minimum(who[after] - at, at - who[after - 1]) <= NEAR).sum())
    capitals, letters = int((code >> 8 & MOST_LETTERS).sum()), int((code >> 35).sum())
    asked = text.count(b"!") + text.count(b"?")
    return [
        share(INSULT), len(at) / n, float(len(at)), float(peak), near / n, share(PERSON), capitals / max(letters, 1),
        share(SHOUTED), asked / max(len(text), 1), share(ENDED), share(DISGUISED), share(REVEALED), math.log1p(len(words)),
    ]


def with_features(rows: DataFrame, lexicon: Lexicon, keep: Sequence[str]) -> DataFrame:
    """``keep`` and the features of each ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = Marked(lexicon)
        for batch in batches:
            found = [features(t.as_py() or b"", marked) for t in batch.column(len(keep))]
            kept = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.float64()))], names=[*keep, "features"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    narrow = rows.select(*keep, F.col("text").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"{kept}, features array<double>")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Entries that are clearly more frequent in toxic ``rows`` (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit() -> pa.RecordBatch:
            names = list(held[0].keys() | held[1].keys())
            both = [pa.array([held[y][e] for e in names], pa.int64()) for y in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *both], names=["entry", "clean", "toxic"])

        held: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = set(map(bare, set((text.as_py() or b"").split())))
                held[toxic].update({e for w in found if w for e in entries(w)})
            if len(held[0]) + len(held[1]) > REMEMBERED:
                yield emit()
                held = (Counter(), Counter())
        yield emit()

    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = F.sum("clean") + 0.5, F.sum("toxic") + 0.5
    odds = F.log(toxic / (size.get(1, 0) + 1)) - F.log(clean / (size.get(0, 0) + 1))
    surely = odds - SURE * F.sqrt(1 / toxic + 1 / clean)
    texts = rows.select(F.col("text").cast("binary"), "toxic")
    counted = texts.mapInArrow(count, "entry string, clean long, toxic long")
    best = (
        counted.groupBy("entry").agg(F.sum("toxic").alias("n"), surely.alias("surely"))
        .filter((F.col("n") >= FEWEST_TOXIC) & (F.col("surely") >= ODDS))
        .orderBy(F.desc("surely"), "entry").limit(MOST_ENTRIES)
    )
    names = [r["entry"] for r in best.select("entry").collect()]
    return Lexicon(
        frozenset(e for e in names if not e.endswith("*")) | INSULTS, frozenset(e[:-1] for e in names if e.endswith("*"))
    )


def checksum(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(checksum(doc_id) % 4 == 2, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """text, toxic and fold of the labelled rows that may be learned from.

    Their labels, at most about ``most`` rows of two numbers, are broadcast, so no text is shuffled.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    if total > most:
        share = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < int(1_000_000 * most / total)
        known = known.filter(share)
    fold = F.floor(checksum(F.col("doc_id")) / 4) % 5
    named = F.when(fold < 2, F.lit("lexicon")).when(fold < 4, F.lit("trees")).otherwise(F.lit("curve"))
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    return joined.select(F.coalesce("text", F.lit("")).alias("text"), "toxic", named.alias("fold"))


def rising(share: Sequence[float], weight: Sequence[float]) -> list[float]:
    """The rising step curve closest to the shares: neighbours out of order are pooled."""
    blocks: list[list[float]] = []
    for value, mass in zip(share, weight, strict=True):
        blocks.append([value, mass, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, m, k = blocks.pop()
            u = blocks[-1]
            blocks[-1] = [(u[0] * u[1] + v * m) / (u[1] + m), u[1] + m, u[2] + k]
    return [v for v, _, k in blocks for _ in range(int(k))]


def calibrate(predicted: DataFrame) -> tuple[float, ...]:
    """Score per bin of ``predicted`` (bin, toxic); bins without rows lie on the line between their neighbours."""
    counted = predicted.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    # At most BINS rows.
    rows = sorted((r["bin"], r["n"], r["toxic"]) for r in counted.collect())
    if not rows:
        return tuple((k + 0.5) / BINS for k in range(BINS))
    curve = rising([t / n for _, n, t in rows], [float(n) for _, n, _ in rows])
    return tuple(np.interp(np.arange(BINS), [b for b, _, _ in rows], curve).tolist())


def predictions(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """``rows`` with the trees' probability in ``raw`` and its bin."""
    scored = trees.transform(rows.withColumn("vector", array_to_vector("features")))
    raw = F.get(vector_to_array("probability"), 1)
    kept = scored.withColumn("raw", raw).drop("vector", "rawPrediction", "probability", "prediction")
    return kept.withColumn("bin", F.least(F.floor(F.col("raw") * BINS), F.lit(BINS - 1)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Learn from the labelled rows that are not held out."""
    rows = learning_rows(docs, labels)
    counts = {(r["fold"], r["toxic"]): r["n"] for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic = sum(n for (_, y), n in counts.items() if y)
    share = toxic / max(sum(counts.values()), 1)
    lexicon = learn_lexicon(rows.filter("fold = 'lexicon'"))
    if not (counts.get(("trees", 0)) and counts.get(("trees", 1))):
        return Scorer(lexicon, None, (share,) * BINS)
    described = set_aside(with_features(rows.filter("fold <> 'lexicon'"), lexicon, ["toxic", "fold"]))
    vectors = described.filter("fold = 'trees'").select("toxic", array_to_vector("features").alias("vector"))
    learner = GBTClassifier(
        featuresCol="vector", labelCol="toxic", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=2,
        seed=SEED, featureSubsetStrategy="all",
    )
    trees = learner.fit(vectors)
    return Scorer(lexicon, trees, calibrate(predictions(trees, described.filter("fold = 'curve'"))))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if scorer.trees is None:
        scored = rows.select("doc_id", F.lit(float(scorer.curve[0])).alias("score"))
    else:
        curve = F.array(*[F.lit(float(v)) for v in scorer.curve])
        # Between two bins a raw prediction takes its share of both, so scores keep the order of predictions.
        place = F.greatest(F.lit(0.0), F.least(F.col("raw") * BINS - 0.5, F.lit(BINS - 1.0)))
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.lit(BINS - 1))
        value = F.get(curve, low) + (F.get(curve, high) - F.get(curve, low)) * (place - low)
        scored = predictions(scorer.trees, with_features(rows, scorer.lexicon, ["doc_id"])).select("doc_id", value.alias("score"))
    bounded = F.greatest(F.lit(0.0), F.least(F.col("score"), F.lit(1.0)))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), bounded.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))

"""Periodic runs, whitening and toxicity against plain Python and numpy on small tables with every awkward row."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedspark.llm import common, runs, toxicity, whitening


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def runs_by_hand(x, shortest=24):
    """Every stretch that keeps a period and cannot be extended, its period being the smallest."""
    out = set()
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            length, stretch = j - i + q, x[i : j + q]
            smallest = not any(stretch[p:] == stretch[:-p] for p in range(1, q))
            if length >= max(shortest, 3 * q) and smallest:
                out.add((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=4), st.sampled_from([3, 7, 24]))
def test_runs_equal_search_of_all_periods(parts, shortest):
    x = [c for unit, times in parts for c in unit * times]
    found = runs.find_runs(np.array(x, np.int64), shortest)
    assert [tuple(map(int, r)) for r in found] == runs_by_hand(x, shortest)


def test_a_run_of_a_million_words_and_one_of_a_long_period():
    assert runs.find_runs(np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]
    unit = np.random.default_rng(1).permutation(70_000)
    assert runs.find_runs(np.concatenate([[-1], np.tile(unit, 3), [-2]])).tolist() == [[1, 210_000, 70_000]]


def run_texts():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 5))) for _ in range(60)]
    out = [None, "", " \n\t", "word", "again " * 23, "again " * 24, "again " * 300, "a b " * 12 + "a", "x" * 4000]
    for _ in range(60):
        unit = rng.choices(vocabulary, k=rng.randint(1, 15))
        out.append(" \n".join(rng.choices(vocabulary, k=rng.randint(0, 40)) + unit * rng.randint(1, 6) + unit[:3] + rng.choices(vocabulary, k=9)))
    return out


def test_query_of_periodic_runs(spark):
    common.prepare(spark)
    texts = run_texts()
    rows = [(k, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[6], (None, "again " * 30, "x", 1)], "doc_id long, text string, runs string, Best int").repartition(3)
    got = runs.digest_runs(runs.periodic_runs(runs.with_planted_repeats(docs))).collect()
    assert len(got) == len(texts) + 2
    planted = 0
    for row in got:
        w = words(texts[row.doc_id]) if row.doc_id is not None else ["again"] * 30
        n, h = len(w), zlib.crc32(str(row.doc_id).encode()) if row.doc_id is not None else 1
        if h % 10 == 0 and n:
            g, planted = h // 10, planted + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        want = runs_by_hand(w)
        gone = {i for s, length, q in want for i in range(s + q, s + length)}
        assert row.n_runs == len(want)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in want).encode()).hexdigest()
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        best = max(want, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if want else None)
    assert planted > 2
    assert runs.periodic_runs(docs.limit(0)).isEmpty()
    shown = runs.periodic_runs(docs.filter("doc_id = 6"), ["doc_id"])
    assert shown.first().runs[0].asDict() == {"start": 0, "length": 300, "period": 1}


# -- whitening ------------------------------------------------------------------------------------


def whitened_by_hand(vectors, components=4):
    x = np.floor(256 * np.asarray(vectors, np.float64)).astype(np.int64)
    distinct = np.unique(x, axis=0)
    n, total = len(distinct), distinct.sum(axis=0)
    centred = distinct - total / n
    values, base = np.linalg.eigh(centred.T @ centred / n)
    values, base = values[::-1][:components], base[:, ::-1][:, :components]
    return n, ((n * x - total) ** 2).sum(axis=1), (x - total / n) @ base / np.sqrt(values), values / (centred**2).sum() * n


@pytest.mark.parametrize("dim", [3, 9, 48])
def test_whitening_equals_full_eigenvectors(spark, dim):
    common.prepare(spark)
    rng = np.random.default_rng(dim)
    good = (rng.standard_normal((150, dim)) * np.linspace(2, 0.7, dim)).astype(np.float32).tolist()
    good += good[:7]
    rows = [(k, v, "a", 1) for k, v in enumerate(good)]
    bad = [
        (900, None, "a", 1), (901, [None] + good[0][1:], "a", 1), (902, [math.nan] + good[0][1:], "a", 1),
        (903, [math.inf] + good[0][1:], "a", 1), (904, [], "a", 1), (905, good[0] + [1.0], "a", 1),
    ]
    schema = "vec_id long, embedding array<float>, n string, Component int"
    table = spark.createDataFrame([*rows, *bad, (None, good[3], "a", 1), rows[5]], schema).repartition(3)
    got = whitening.whiten(table).collect()
    width = min(4, dim)
    n, deviation, white, explained = whitened_by_hand(good, width)
    assert n == 150 and len(got) == (len(good) + 2) * width
    sides = {}
    for r in got:
        k = 3 if r.vec_id is None else r.vec_id
        assert (r.n, r.deviation) == (n, deviation[k])
        want = white[k, r.component - 1]
        side = sides.setdefault(r.component, 1 if r.whitened * want >= 0 else -1)
        assert abs(r.whitened - side * want) < 1e-9
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert sorted(sides) == list(range(1, width + 1))


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).isEmpty()
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [math.nan])], schema)).isEmpty()
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).isEmpty()
    line = [(k, [float(k), 2.0 * k, 0.0, 1.0, 5.0]) for k in range(30)]
    found = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert {r.component for r in found} == {1} and abs(found[0].explained - 1) < 1e-9


@pytest.mark.parametrize(
    "values",
    [[5.0, 1.0] + [0.0] * 62, [1.0] * 64, [1e6] + np.linspace(1, 2, 63).tolist(), [9.0, 8, 7, 6.5] + [6.4] * 60],
)
def test_filtered_iteration_ends_with_small_residuals(values):
    turn = np.linalg.qr(np.random.default_rng(2).standard_normal((64, 64)))[0]
    v = (turn * values) @ turn.T
    theta, q = whitening.leading_components(lambda block: v @ block, 64, 4)
    assert np.allclose(theta, sorted(values)[::-1][:4], atol=1e-12 * max(values))
    assert np.linalg.norm(v @ q - q * theta, axis=0).max() < 1e-13 * max(values) * 64
    assert np.allclose(q.T @ q, np.eye(4), atol=1e-12)


def test_deviation_beyond_exact_doubles(spark):
    rows = [(k, [2e3 * k + 0.5, float(k % 3)]) for k in range(40)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    total = [sum(c) for c in zip(*x, strict=True)]
    assert got == {k: sum((40 * c - s) ** 2 for c, s in zip(v, total, strict=True)) for k, v in enumerate(x)}


# -- toxicity -------------------------------------------------------------------------------------


def test_disguise_comes_off():
    assert "idiot" in toxicity.unmasked("id!ot")
    assert "idiot" in toxicity.unmasked("i.d.i.o.t")
    assert "moron" in toxicity.unmasked("moooron")
    assert "loser" in toxicity.unmasked("l0s3r")
    assert toxicity.unmasked("plain") == []


def test_features_see_the_whole_text():
    known = toxicity.Lexicon(toxicity.INSULTS, frozenset({"zork"}))
    text = b"calm word " * 40_000 + b"You zorkling, you IDIOT!! l0s3r"
    at = dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity.Marked(known)), strict=True))
    assert at["hits"] == 3 and at["peak"] == 3 and at["unmasked_share"] > 0 and at["near_person_share"] > 0
    assert toxicity.features(b"", toxicity.Marked(known)) == [0.0] * 13


def toxic_table(spark, n=900):
    rng = random.Random(3)
    common_words = ["".join(rng.choices("bcdfghaeiou", k=rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        w = rng.choices(common_words, k=rng.randint(15, 80))
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), "zwirk" + rng.choice(["el", "ung", "asto", "ible"]) if k % 8 else rng.choice(["idiot", "l0s3r", "Scum!!"]))
        rows.append((k, " ".join(w), "x", 0.5, 7))
        labels.append((k, 1, int(toxic)))
    awkward = [(n, None, "x", 0.5, 7), (n + 1, "", "x", 0.5, 7), (n + 2, "!" * 9000, "x", 0.5, 7), (None, "you idiot", "x", 0.5, 7), rows[0]]
    labels += [(n, None, 1), (n + 1, None, None), (n + 2, 1, 7), (None, 1, 1), (0, 1, 1)]
    docs = spark.createDataFrame(rows + awkward, "doc_id long, text string, toxic string, score double, features int").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def test_toxicity_on_held_out_rows(spark):
    common.prepare(spark)
    docs, labels, n = toxic_table(spark)
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == n + 5
    held = [r for r in got if r.held_out and r.doc_id < n]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    toxic = [r for r in held if r.doc_id % 4 == 0]
    clean = [r for r in held if r.doc_id % 4]
    assert sum(r.predicted for r in toxic) > 0.9 * len(toxic) and sum(r.predicted for r in clean) < 0.05 * len(clean)
    assert toxicity.score_toxicity(docs.limit(0), labels).isEmpty()


def test_toxicity_without_enough_labels(spark):
    docs, labels, n = toxic_table(spark, 40)
    none = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(none) == n + 5 and {r.score for r in none} == {0.0}
    one = toxicity.score_toxicity(docs, labels.filter("toxic = 1")).collect()
    assert {r.score for r in one} == {1.0}


def test_held_out_labels_change_nothing(spark):
    docs, labels, _ = toxic_table(spark, 300)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.learning_rows(docs, lab).collect())) for lab in (labels, turned))
    assert one == two


@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 9)), min_size=1, max_size=30))
def test_rising_curve_keeps_mass_and_order(pairs):
    share, weight = [p for p, _ in pairs], [float(w) for _, w in pairs]
    curve = toxicity.rising(share, weight)
    assert len(curve) == len(share) and all(a <= b + 1e-12 for a, b in zip(curve, curve[1:], strict=False))
    assert math.isclose(sum(c * w for c, w in zip(curve, weight, strict=True)), sum(s * w for s, w in zip(share, weight, strict=True)), abs_tol=1e-9)

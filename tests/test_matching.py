"""Greedy matching against inserting one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from feedspark.operators import matching
from feedspark.operators.ingest import settle_inserts
from feedspark.schemas import ARTICLES

ITEM = "left string, source string, right string, _place struct<k0:long>"


def one_by_one(items):
    lefts, rights, taken = set(), set(), []
    for left, source, right, place in sorted(items, key=lambda x: x[3]):
        named = right is not None
        if left in lefts or (named and (source, right) in rights):
            continue
        taken.append(place[0])
        lefts.add(left)
        if named:
            rights.add((source, right))
    return taken


def matched(spark, items):
    found = matching.greedy_matching(spark.createDataFrame(items, ITEM), ["left"], ["source", "right"])
    return sorted(r._place.k0 for r in found.collect())


@pytest.mark.parametrize("seed", range(4))
def test_equals_one_by_one(spark, seed):
    rng = random.Random(seed)
    ids, pairs = rng.choice([(3, 3), (30, 12), (60, 60)])
    items = {(f"a{rng.randrange(ids)}", f"s{rng.randrange(2)}", rng.choice([None, *(f"x{k}" for k in range(pairs))])) for _ in range(90)}
    places = rng.sample(range(1000), len(items))
    rows = [(*item, (p,)) for item, p in zip(sorted(items, key=str), places, strict=True)]
    assert matched(spark, rows) == one_by_one(rows)


def chain(n):
    """(a0, x0) (a1, x0) (a1, x1) (a2, x1) ...: each item clashes with the one before and the one behind."""
    return [(f"a{(k + 1) // 2}", "s", f"x{k // 2}", (k,)) for k in range(n)]


def test_a_chain_ends_in_few_rounds(spark, monkeypatch):
    written = []
    keep = matching.set_aside
    monkeypatch.setattr(matching, "set_aside", lambda df: written.append(1) or keep(df))
    rows = chain(10_000)
    assert matched(spark, rows) == one_by_one(rows) == list(range(0, 10_000, 2))
    # One write per doubling, and a few more.
    assert len(written) < 14 + 8


def test_hot_keys_and_nothing(spark):
    crowd = [("a0", "s", f"x{k}", (k,)) for k in range(300)] + [(f"b{k}", "s", "x0", (1000 + k,)) for k in range(300)]
    assert matched(spark, crowd) == [0]
    assert matched(spark, []) == []
    assert matched(spark, [("a", "s", None, (1,)), ("a", "s", None, (2,)), ("b", "s", None, (3,))]) == [1, 3]


def test_inserts_over_a_chain_of_clashes(spark):
    rows = [(a, "s", x, "r", 0, 0, 0, p[0], p[0]) for a, _, x, p in chain(400)]
    names = "id string, source_id string, source_item_external_id string, run_id string, domain_rank int, source_rank int, sort_key long, pos long, content long"
    articles = spark.createDataFrame(rows, names)
    taken, lost = settle_inserts(articles, spark.createDataFrame([], ARTICLES))
    assert sorted(r.pos for r in taken.collect()) == list(range(0, 400, 2))
    # Every second item clashes: the url it names is inserted later under another external id.
    assert lost.filter(F.col("defect") == "external_id_conflict").count() == 200

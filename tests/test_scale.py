"""Plans and results where tables are not small and one key holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as registry
from feedspark.operators import lookups
from feedspark.operators.lookups import lookup, present_in, small_side
from feedspark.operators.ranking import first_per_key, ordered_rank, take_ordered, top_n_per_group

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture()
def hot(spark):
    """Most rows share one key."""
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", rng.choice([None, rng.randint(0, 20)]), n)
            for n in range(2000)]
    return spark.createDataFrame(data, "k string, v int, n bigint").repartition(6)


def test_ordered_rank_equals_a_window(hot):
    for group in (["k"], []):
        order = [F.col("v").desc_nulls_last(), F.col("n").asc()]
        want = hot.withColumn("w", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        got = ordered_rank(hot, order, within=group, parts=7)
        assert got.join(want.select("n", "w"), "n").filter("rn <> w").count() == 0 and got.count() == 2000


def test_take_ordered_beyond_top_k(hot, monkeypatch):
    monkeypatch.setattr("feedspark.operators.ranking.TOP_K_ROWS", 10)
    got = [r.n for r in take_ordered(hot, [F.col("n").asc()], 25).collect()]
    assert sorted(got) == list(range(25))


def test_first_per_key_keeps_exactly_one_row_even_for_full_ties(hot):
    twice = hot.unionByName(hot)
    got = {r.k: r.n for r in first_per_key(twice, ["k"], ["n"]).collect()}
    want = {r.k: r.n for r in hot.groupBy("k").agg(F.min("n").alias("n")).collect()}
    assert got == want and first_per_key(twice, ["k"], ["n"]).count() == len(want)


def test_group_cap_drops_rows_before_the_shuffle(hot):
    capped = top_n_per_group(hot, ["k"], [F.col("n").asc()], F.lit(3), 3)
    assert "WindowGroupLimit" in plan_of(capped)
    assert capped.groupBy("k").count().filter("count <> 3").count() == 0


def test_lookup_without_a_small_table_is_salted(spark, hot, monkeypatch):
    names = spark.createDataFrame([(f"k{n}", n) for n in range(4)] + [("hot", 99)], "k string, name int")
    want = sorted(map(tuple, hot.join(names, "k", "left").select("n", "name").collect()))
    monkeypatch.setattr(lookups, "small_side", lambda df, rows=0: None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup(hot, names, ["k"], ["n"], "left")
        assert "_salt" in plan_of(joined)
        assert sorted(map(tuple, joined.select("n", "name").collect())) == want
        assert present_in(hot, names, ["k"]).count() == hot.join(names, "k", "left_semi").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_side_is_small_only_after_counting(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        assert small_side(spark.range(11), 10) is None
        assert small_side(spark.range(10), 10).count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", ["article_dedup", "publish_eligible", "batch_apply", "pricing_match", "scoring_candidates"])
def test_plans_have_no_cross_join_and_no_python(spark, name):
    plan = plan_of(registry.queries()[name](spark, SF))
    for word in ("CartesianProduct", "NestedLoop", "Python"):
        assert word not in plan


def test_publish_selection_reads_no_content(spark):
    plan = plan_of(registry.queries()["publish_eligible"](spark, SF))
    assert "text:string" not in plan.split("== Physical Plan ==")[1]


def test_entry(spark):
    assert registry.entry(spark).count() == 200

"""Running source health against the fold of the whole log."""

from __future__ import annotations

import datetime
import random

import pytest

from feedspark.operators.health import fold_source_health
from feedspark.schemas import FETCH_LOG
from feedspark.sources.tables import stored_fetch_log, write_epoch
from feedspark.streaming.health import kept_health, start_health
from tests.helpers import BASE, rows


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_fold_for_any_split(spark, tmp_path, seed):
    rng, root = random.Random(seed), str(tmp_path)
    log = []
    for n in range(160):
        ok = rng.random() < 0.25
        log.append({
            "source_id": f"s{rng.randrange(5)}", "at": BASE + datetime.timedelta(minutes=rng.randrange(40)), "run_id": rng.choice(["r0", "r1", None]),
            "seq": n, "ok": ok and n % 5 != 4, "http_status": 200 if ok else rng.choice([404, None]), "error_message": None if ok else f"e{n}",
            "last_item_external_id": f"x{n}" if ok and n % 3 else None,
        })
    rng.shuffle(log)
    for epoch in range(4):
        write_epoch(rows(spark, FETCH_LOG, log[epoch * 40 : epoch * 40 + 40]).coalesce(1), root, "fetch_log", "ingest", epoch)
        if epoch % 2:
            start_health(spark, root, f"{root}/progress", files_per_batch=1, once=True).awaitTermination()
    whole = fold_source_health(stored_fetch_log(spark, root))
    kept = kept_health(spark, f"{root}/progress").select(*whole.columns)
    assert sorted(map(str, kept.collect())) == sorted(map(str, whole.collect()))
    assert kept.filter("errors_since_success > 0").count() > 0

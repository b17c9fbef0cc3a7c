from __future__ import annotations

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from feedspark.session import local_session

    # Tiny inputs spend their time compiling; tools/check.py runs the same operators with code generation.
    tiny = {"spark.sql.shuffle.partitions": "4", "spark.sql.codegen.wholeStage": "false"}
    session = local_session(4, "feedspark-tests", **tiny)
    yield session
    session.stop()


@pytest.fixture()
def now(spark):
    from pyspark.sql import functions as F

    return F.lit("2026-01-10 00:00:00").cast("timestamp")

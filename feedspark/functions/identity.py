"""Stable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article_id(domain_id: Column, canonical_url: Column) -> Column:
    """Deterministic id of an article: SHA-256 over ``domain|url``."""
    return F.sha2(F.concat(domain_id, F.lit("|"), canonical_url), 256)


def spread(buckets: int, *cols: Column) -> Column:
    """A deterministic salt in ``[0, buckets)`` taken from row-unique columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")

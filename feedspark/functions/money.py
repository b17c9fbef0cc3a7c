"""Exact token cost in decimals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# tokens decimal(19,0) x per-token price decimal(18,12) is decimal(38,12): nothing is rounded.
COST_TYPE = "decimal(38,12)"


def token_cost(tokens: Column, price_per_million: Column) -> Column:
    """Cost in USD; no tokens, no price or a non-positive value costs nothing."""
    per_token = (price_per_million.cast("decimal(18,6)") * F.lit(Decimal("0.000001"))).cast("decimal(18,12)")
    charged = (tokens > 0) & (price_per_million > 0)
    return F.when(charged, (tokens.cast("decimal(19,0)") * per_token).cast(COST_TYPE)).otherwise(
        F.lit(0).cast(COST_TYPE)
    )


def usd_text(amount: Column) -> Column:
    """Six decimals, half-up."""
    return F.round(amount, 6).cast("decimal(38,6)").cast("string")


def usd_cents(amount: Column) -> Column:
    """Whole cents, half-up."""
    return F.round(amount * F.lit(Decimal("100")), 0).cast("bigint")

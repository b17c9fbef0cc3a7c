"""Masking of secrets in text and in nested values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedspark.functions.text import bind

# The secret shapes and their replacements, applied in this order.
_ENV = (r"(?iU)\b(TELEGRAM_BOT_TOKEN|OPENAI_API_KEY)[\s\x1c-\x1f]*=[\s\x1c-\x1f]*([^\s\x1c-\x1f\"',]+)", "$1=***")
_BOT_URL = (r"(?U)(/bot)([^/\s\x1c-\x1f]+)", "$1***")
_BOT_TOKEN = (r"(?U)\b\d{6,}:[A-Za-z0-9_-]{20,}\b", "***")
_API_KEY = (r"(?U)\bsk-[A-Za-z0-9_-]{10,}\b", "***")
_BEARER = (r"(?iU)\bBearer[\s\x1c-\x1f]+[A-Za-z0-9._=-]+\b", "Bearer ***")


def redact_text(c: Column) -> Column:
    """Mask secrets.  Most text holds none, so each pass runs only where a piece it needs occurs.

    A mask consists of stars, so it cannot complete such a piece: the pieces are looked up in the
    original text.
    """

    def masked(x: Column) -> Column:
        text, low = x["text"], x["low"]
        passes = (
            (F.contains(low, F.lit("_token")) | F.contains(low, F.lit("_key")), _ENV),
            (F.contains(text, F.lit("/bot")), _BOT_URL),
            (F.contains(text, F.lit(":")) & F.rlike(text, F.lit(r"(?U)\d{6}:")), _BOT_TOKEN),
            (F.contains(text, F.lit("sk-")), _API_KEY),
            (F.contains(low, F.lit("bearer")), _BEARER),
        )
        done = text
        for possible, (pattern, replacement) in passes:
            done = _replace_if(possible, done, pattern, replacement)
        return done

    return bind(F.struct(c.alias("text"), F.lower(c).alias("low")), masked)


def _replace_if(possible: Column, text: Column, pattern: str, replacement: str) -> Column:
    return bind(text, lambda t: F.when(possible, F.regexp_replace(t, pattern, replacement)).otherwise(t))


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    return False


def redact_value(c: Column, kind: T.DataType) -> Column:
    """Mask every string inside a value; map keys and other types stay as they are."""
    if not _holds_text(kind):
        return c
    if isinstance(kind, T.StringType):
        return redact_text(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_value(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: redact_value(v, kind.valueType))
    rebuilt = F.struct(*[redact_value(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    return F.when(c.isNotNull(), rebuilt)


def redact(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mask the named columns, or every column that can hold text."""
    wanted = set(df.columns if columns is None else columns)
    return df.select(
        *[
            redact_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if f.name in wanted else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )

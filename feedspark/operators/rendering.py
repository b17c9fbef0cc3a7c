"""Post text: fallback message, body, and the source footer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.dates import display_instant
from feedspark.functions.text import (
    WS,
    bind,
    blank_to_null,
    empty_to_null,
    html_escape,
    is_blank,
    lines_of,
    urtrim,
    utrim,
)

# Footer labels, promotional phrases and the hashtag shape of a post.
FOOTER_DOMAINS = ("ai",)
DEFAULT_SOURCE = "AI News"
_FIELD_MARKERS = ("Source:", "Original:")
_PROMO_ANYWHERE = "подробнее"
_PROMO_STARTS = ("читайте", "подроб")
HASHTAG = r"#([a-z][a-z0-9_]{0,63})"
_TAIL_TAGS = rf"(?U)(?:{WS}+#[a-z][a-z0-9_]{{0,63}})+{WS}*$"


def fallback_message(
    title: Column, source_name: Column, published_at: Column, url: Column, parse_mode: str = "HTML"
) -> Column:
    """Title (or url), source, date and url separated by blank lines."""
    shown = [F.coalesce(blank_to_null(title), url), source_name, display_instant(published_at), url]
    if parse_mode == "HTML":
        shown = [html_escape(c) for c in shown]
    return F.concat_ws("\n\n", *shown)


def _is_tag_line(line: Column) -> Column:
    return F.startswith(utrim(line), F.lit("#"))


def _clean_line(line: Column) -> Column:
    """Cut at the first footer label; whitespace-only lines become empty."""
    for marker in _FIELD_MARKERS:
        line = urtrim(F.substring_index(line, marker, 1))
    return line


def _is_promo(line: Column) -> Column:
    def in_lower(low: Column) -> Column:
        hit = F.contains(low, F.lit(_PROMO_ANYWHERE))
        for start in _PROMO_STARTS:
            hit = hit | F.startswith(low, F.lit(start))
        return hit

    return bind(F.lower(line), in_lower)


def sanitize_lines(lines: Column, text: Column) -> Column:
    """Body text without promotional lines or footer labels, blank runs collapsed, edges trimmed.

    ``text`` is what the lines came from: lines are looked at only if it holds such a piece.
    """
    stems = (_PROMO_STARTS[0], _PROMO_STARTS[1])
    promo = bind(F.lower(text), lambda low: F.contains(low, F.lit(stems[0])) | F.contains(low, F.lit(stems[1])))
    labelled = F.contains(text, F.lit(_FIELD_MARKERS[0])) | F.contains(text, F.lit(_FIELD_MARKERS[1]))
    trimmed = F.transform(lines, urtrim)
    kept = F.when(promo, F.filter(trimmed, lambda x: ~_is_promo(x))).otherwise(trimmed)
    clean = F.when(labelled, F.transform(kept, _clean_line)).otherwise(kept)
    joined = F.btrim(F.array_join(clean, "\n"), F.lit("\n"))
    return bind(
        joined, lambda t: F.when(F.contains(t, F.lit("\n\n\n")), F.regexp_replace(t, "\n{3,}", "\n\n")).otherwise(t)
    )


def hashtag_line(text: Column) -> Column:
    """All lower-case latin hashtags of a text on one line, first occurrence first."""
    tags = F.array_distinct(F.regexp_extract_all(text, F.lit(HASHTAG), 1))
    return empty_to_null(F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "))


def with_footer(df: DataFrame, text: str, source_name: Column, url: Column, out: str) -> DataFrame:
    """Add the post text with ``Source``, ``Original`` and one hashtag line at its end."""
    kept = df.columns
    lined = df.withColumn("_lines", lines_of(utrim(F.coalesce(text, F.lit("")))))
    body_end = F.array_max(F.transform("_lines", lambda x, i: F.when(~_is_tag_line(x), i + 1).otherwise(0)))
    split = lined.withColumn("_end", body_end)
    parts = split.withColumns(
        {
            "_main": sanitize_lines(F.slice("_lines", 1, F.col("_end")), F.col(text)),
            "_tags": F.array_join(F.slice("_lines", F.col("_end") + 1, F.size("_lines")), "\n"),
        }
    ).withColumn("_last", F.substring_index("_main", "\n", -1))
    parts = parts.withColumn(
        "_tail", F.when(F.contains("_last", F.lit("#")), F.regexp_extract("_last", _TAIL_TAGS, 0)).otherwise("")
    )
    tail = F.col("_tail")
    last_kept = urtrim(F.regexp_replace("_last", _TAIL_TAGS, ""))
    before_last = F.substring("_main", F.lit(1), F.length("_main") - F.length("_last"))
    without_tail = F.when(last_kept != "", F.concat(before_last, last_kept)).otherwise(
        F.substring(before_last, F.lit(1), F.greatest(F.length(before_last) - 1, F.lit(0)))
    )
    moved = parts.withColumns(
        {
            "_body": F.when(tail != "", without_tail).otherwise(F.col("_main")),
            "_tag_line": hashtag_line(F.concat_ws("\n", F.col("_tags"), tail)),
        }
    )
    body = F.col("_body")
    gap = F.when(body == "", F.lit("")).when(F.endswith(body, F.lit("\n")), F.lit("\n")).otherwise(F.lit("\n\n"))
    footer = F.concat_ws(
        "\n",
        F.concat(F.lit("Source: "), F.coalesce(blank_to_null(source_name), F.lit(DEFAULT_SOURCE))),
        F.concat(F.lit("Original: "), blank_to_null(url)),
    )
    full = F.concat_ws("\n\n", F.concat(body, gap, footer), F.col("_tag_line"))
    empty = is_blank(F.coalesce(text, F.lit("")))
    post = F.when(empty, F.lit("")).otherwise(F.concat(utrim(full), F.lit("\n")))
    return moved.withColumn("_post", post).select(*[F.col(c) for c in kept if c != out], F.col("_post").alias(out))


def render_posts(
    rows: DataFrame, parse_mode: str = "HTML", footer_domains: Sequence[str] = FOOTER_DOMAINS
) -> DataFrame:
    """Add ``post_text`` to rows with final title and text, source name, url and date."""
    title, body = empty_to_null(F.col("final_title")), empty_to_null(F.col("final_text"))
    fallback = fallback_message(
        F.col("final_title"), F.col("source_name"), F.col("published_at"), F.col("canonical_url"), parse_mode
    )
    plain = rows.withColumn(
        "_plain",
        F.when(title.isNotNull() & body.isNotNull(), F.concat(title, F.lit("\n\n"), body)).otherwise(fallback),
    )
    footed = with_footer(plain, "_plain", F.col("source_name"), F.col("canonical_url"), "_footed")
    wants_footer = F.col("domain_id").isin(*footer_domains)
    return footed.select(
        *rows.columns, F.when(wants_footer, F.col("_footed")).otherwise(F.col("_plain")).alias("post_text")
    )

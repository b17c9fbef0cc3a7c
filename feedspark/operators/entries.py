"""Per-source entry filters and normalization into articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.dates import entry_instant, hours_before, iso_text, parts_to_instant
from feedspark.functions.identity import article_id
from feedspark.functions.text import blank_to_null, first_present, utrim
from feedspark.operators.lookups import lookup
from feedspark.operators.ranking import top_n_per_group
from feedspark.sources.feeds import entry_json, external_id


def parsed_time_text(parts: Column) -> Column:
    return iso_text(parts_to_instant(parts))


def with_entry_time(entries: DataFrame) -> DataFrame:
    return entries.withColumn(
        "entry_at",
        entry_instant(
            parsed_time_text(F.col("published_parsed")),
            F.col("published"),
            parsed_time_text(F.col("updated_parsed")),
            F.col("updated"),
        ),
    )


def within_source_age(dated: DataFrame, now: Column) -> DataFrame:
    """Drop entries older than their source allows, and undated ones where the source says so.

    Needs ``entry_at`` and the source's feed settings on each row.
    """
    age = F.col("rss_max_age_hours")
    unlimited = age.isNull() | (age <= 0)
    fresh = unlimited | F.col("entry_at").isNull() | (F.col("entry_at") >= hours_before(now, age))
    dated_enough = F.col("entry_at").isNotNull() | ~F.coalesce(F.col("rss_drop_if_no_date"), F.lit(False))
    return dated.filter(fresh & dated_enough)


def newest_per_source(dated: DataFrame, largest_cap: int) -> DataFrame:
    """Apply each source's item cap to each of its fetches: newest first where it sorts, feed order otherwise.

    A source without a cap keeps all rows and needs no ranking at all.  ``largest_cap`` is the
    biggest configured cap; it lets each map task drop rows that cannot survive.
    """
    cap = F.col("rss_max_items")
    sort_key = F.when(F.col("rss_sort_by_published_desc"), F.col("entry_at"))
    capped = top_n_per_group(
        dated.filter(cap > 0), ["source_id", "run_id"], [sort_key.desc_nulls_last(), F.col("pos").asc()], cap, largest_cap
    )
    return dated.filter(cap.isNull()).unionByName(capped)


def select_entries(entries: DataFrame, settings: DataFrame, now: Column) -> DataFrame:
    """Age, date and item-cap rules of each source over its entries.

    ``sort_key`` and ``pos`` give the order of the kept items within their source.  ``settings`` is
    the feed-settings table of the configured sources; its largest cap is read once.
    """
    largest = settings.agg(F.max("rss_max_items")).first()[0] or 0
    dated = lookup(
        with_entry_time(entries), settings.drop("retry_attempts"), ["source_id"], ["run_id", "pos"], "left"
    )
    kept = newest_per_source(within_source_age(dated, now), int(largest))
    undated_last = F.coalesce(-F.unix_micros("entry_at"), F.lit(2**63 - 1))
    sort_key = F.when(F.col("rss_sort_by_published_desc"), undated_last).otherwise(F.lit(0))
    return kept.select(*entries.columns, "entry_at", sort_key.cast("bigint").alias("sort_key"))


def content_of(entries: DataFrame) -> Column:
    """First content block as it is; only an entry without blocks falls back to summary, description."""
    first = F.get(entries["content"], 0)
    return F.when(
        F.size(entries["content"]) > 0, F.coalesce(first["value"], F.to_json(first))
    ).otherwise(F.coalesce(entries["summary"], entries["description"]))


def normalize_entries(entries: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles of the entries, and the entries that cannot become one (no link).

    ``sources`` are configured sources; they give the domain and the ingest rank.
    """
    origin = sources.select(
        F.col("id").alias("source_id"), "domain_id", "domain_rank", "source_rank"
    )
    linked = entries.withColumn("canonical_url", utrim(F.coalesce("link", F.lit(""))))
    placed = lookup(linked, origin, ["source_id"], ["run_id", "pos"])
    published = first_present(F.col("published"), parsed_time_text(F.col("published_parsed")))
    updated = first_present(F.col("updated"), parsed_time_text(F.col("updated_parsed")))
    if "sort_key" not in placed.columns:
        placed = placed.withColumn("sort_key", F.lit(0).cast("bigint"))
    shaped = placed.select(
        article_id(F.col("domain_id"), F.col("canonical_url")).alias("id"),
        "domain_id",
        "source_id",
        "canonical_url",
        external_id(placed).alias("source_item_external_id"),
        blank_to_null(F.col("title")).alias("title"),
        content_of(placed).alias("content"),
        published.alias("published_at"),
        updated.alias("updated_text"),
        "author",
        "tags",
        entry_json(entries).alias("raw_json"),
        "run_id",
        "domain_rank",
        "source_rank",
        "sort_key",
        "pos",
    )
    good = shaped.filter(F.col("canonical_url") != "")
    bad = shaped.filter(F.col("canonical_url") == "").withColumn("defect", F.lit("missing_link"))
    return good.withColumn("normalized_json", _normalized_json()).drop("updated_text", "author", "tags"), bad.drop(
        "updated_text", "author", "tags"
    )


def _normalized_json() -> Column:
    metadata = F.struct(
        F.col("source_item_external_id").alias("external_id"),
        F.col("published_at"),
        F.col("updated_text").alias("updated_at"),
        F.col("author"),
        F.col("tags"),
    )
    fields = ("id", "domain_id", "source_id", "canonical_url", "title", "content")
    return F.to_json(F.struct(*fields, metadata.alias("metadata")), {"ignoreNullFields": "false"})

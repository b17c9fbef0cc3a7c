"""Idempotent keyed insert of normalized articles, source upsert and the run summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedspark.operators.lookups import lookup, present_in
from feedspark.operators.matching import greedy_matching
from feedspark.operators.ranking import first_per_key, order_struct, ordered_rank
from feedspark.operators.state import event_rows
from feedspark.schemas import ARTICLES
from feedspark.session import set_aside

# Runs one after another, sources in configured order, then the place of the item in its fetch.
INGEST_ORDER = ["run_id", "domain_rank", "source_rank", "sort_key", "pos"]


def item_place() -> Column:
    return order_struct(F.col("sort_key"), F.col("pos"))


def ingest_place() -> Column:
    return order_struct(*[F.col(c) for c in INGEST_ORDER])


def known_ids(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids of the store that also occur in ``incoming``.

    Written this way round, a small batch is broadcast against a scan of the id column; the store
    itself is shuffled only when the batch is large.
    """
    return present_in(store.select("id"), incoming.select("id"), ["id"])


def key_place() -> Column:
    """Place in ingest order with the id behind it: different for any two rows, nulls included."""
    return order_struct(*[F.col(c) for c in INGEST_ORDER], F.col("id"))


def at_places(articles: DataFrame, places: DataFrame) -> DataFrame:
    """The articles at the given ``_place``; the only step that moves content."""
    return articles.withColumn("_place", key_place()).join(places.select("_place"), "_place", "left_semi").drop("_place")


def insert_new(articles: DataFrame, store: DataFrame) -> DataFrame:
    """First article per (domain, url) in ingest order that the store does not hold yet.

    The article id is a hash of exactly that pair, so it stands in for the key.  Known ids leave first
    and only ids and places are aggregated.
    """
    keys = articles.select("id", key_place().alias("_place"))
    fresh = keys.join(known_ids(store, keys), "id", "left_anti")
    return at_places(articles, fresh.groupBy("id").agg(F.min("_place").alias("_place")))


def as_stored(new: DataFrame, now: Column) -> DataFrame:
    """Stored form of newly inserted articles."""
    initial = {
        "lifecycle_state": F.lit("normalized"),
        "publication_status": F.lit("unpublished"),
        "editorial_status": F.lit("NEW"),
        "status_updated_at": now,
        "created_at": now,
        "updated_at": now,
    }
    have = set(new.columns)
    return new.select(
        *[
            initial[f.name].cast(f.dataType).alias(f.name)
            if f.name in initial
            else (F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name))
            for f in ARTICLES.fields
        ]
    )


def reject_unscored(new: DataFrame, domains: DataFrame, now: Column) -> DataFrame:
    """Articles of a domain without scoring do not wait: they are rejected on arrival."""
    flags = domains.select(F.col("id").alias("domain_id"), "llm_enabled")
    off = ~F.coalesce(F.col("llm_enabled"), F.lit(False))
    marked = lookup(new, flags, ["domain_id"], ["id"], "left")
    return marked.withColumns(
        {
            "editorial_status": F.when(off, F.lit("REJECTED")).otherwise(F.col("editorial_status")),
            "rejection_reason": F.when(off, F.lit("llm_disabled")).otherwise(F.col("rejection_reason")),
            "rejected_at": F.when(off, now).otherwise(F.col("rejected_at")),
            "status_updated_at": F.when(off, now).otherwise(F.col("status_updated_at")),
            "updated_at": F.when(off, now).otherwise(F.col("updated_at")),
        }
    ).select(*new.columns)


def insert_events(stored: DataFrame, now: Column) -> DataFrame:
    """INGESTED for every new article and the decision event of those rejected on arrival."""
    rejected = F.col("editorial_status") == "REJECTED"
    kinds = F.when(rejected, F.array(F.lit("INGESTED"), F.lit("LLM_PROCESSED"))).otherwise(
        F.array(F.lit("INGESTED"))
    )
    decision = F.to_json(
        F.struct(F.lit("REJECT").alias("decision"), F.col("rejection_reason").alias("explanation"))
    )
    rows = stored.select("id", "rejection_reason", F.explode(kinds).alias("event_type"))
    return event_rows(
        rows,
        article_id=F.col("id"),
        event_type=F.col("event_type"),
        details=F.when(F.col("event_type") == "LLM_PROCESSED", decision),
        error=F.lit(None).cast("string"),
        now=now,
    )


def missing_link_cut(bad: DataFrame) -> DataFrame:
    """Place of the first entry without link per fetch."""
    return bad.groupBy(*FETCH).agg(F.min(item_place()).alias("cut"))


PAIR = ["source_id", "source_item_external_id"]
FETCH = ["source_id", "run_id"]


def held_pairs(named: DataFrame, store: DataFrame) -> DataFrame:
    """(source, external id) pairs of the batch that a stored article already holds."""
    return present_in(store.select(*PAIR), named.select(*PAIR), PAIR).distinct()


def settle_inserts(articles: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New articles to insert, and the items whose (source, external id) another article holds.

    An item that clashes leaves nothing behind, so a later copy of its url may still be inserted and a
    later item may take the pair that a duplicate did not.  The result is that of inserting one by one in
    ingest order, on one row per id and pair.  Items that meet no other in their id or pair go in at once; only the others
    are matched, and chains of clashes end in few rounds whatever their length.
    """
    rows = articles.select("id", *PAIR, *FETCH[1:], "pos", key_place().alias("_place"))
    fresh = set_aside(rows.join(known_ids(store, rows), "id", "left_anti"))
    named = fresh.filter(F.col("source_item_external_id").isNotNull())
    waiting = fresh.join(held_pairs(named, store), PAIR, "left_anti").groupBy("id", *PAIR).agg(F.min("_place").alias("_place"))
    marked = set_aside(meets_others(waiting))
    crowd = marked.filter("_met").drop("_met")
    taken = marked.filter("not _met").drop("_met")
    if not crowd.isEmpty():
        taken = taken.unionByName(greedy_matching(crowd, ["id"], PAIR))
    placed = taken.select("id", F.col("_place").alias("_in"))
    # An item before the one inserted under its id, or of an id never inserted, can only have clashed.
    lost = (
        fresh.join(placed, "id", "left").filter(F.col("_in").isNull() | (F.col("_place") < F.col("_in")))
        .drop("_in", "_place").withColumn("defect", F.lit("external_id_conflict"))
    )
    return at_places(articles, taken), lost


def meets_others(items: DataFrame) -> DataFrame:
    """Add ``_met``: whether another of the ``items`` (id, pair) has the same id or the same pair."""
    two = F.count(F.lit(1)) > 1
    ids = items.groupBy("id").agg(two.alias("_two")).filter("_two").select("id", F.lit(True).alias("_of_id"))
    named = items.filter(F.col("source_item_external_id").isNotNull())
    pairs = named.groupBy(*PAIR).agg(two.alias("_two")).filter("_two").select(*PAIR, F.lit(True).alias("_of_pair"))
    marked = items.join(ids, "id", "left").join(pairs, PAIR, "left")
    met = F.coalesce("_of_id", F.lit(False)) | F.coalesce("_of_pair", F.lit(False))
    return marked.select(*items.columns, met.alias("_met"))


def clash_cut(insertable: DataFrame, store: DataFrame) -> DataFrame:
    """Place of the first external-id clash per fetch.

    The first of a pair keeps it and the second clashes, so only two leading rows per pair are
    ranked; Spark drops the rest of a hot pair before the shuffle.
    """
    named = insertable.filter(F.col("source_item_external_id").isNotNull())
    nth = F.row_number().over(Window.partitionBy(*PAIR).orderBy("run_id", "sort_key", "pos"))
    leading = named.withColumn("_nth", nth).filter(F.col("_nth") <= 2)
    held = held_pairs(named, store).withColumn("_held", F.lit(True))
    clashing = leading.join(held, PAIR, "left").filter((F.col("_nth") == 2) | F.coalesce("_held", F.lit(False)))
    return clashing.groupBy(*FETCH).agg(F.min(item_place()).alias("cut"))


def source_cuts(articles: DataFrame, bad: DataFrame, store: DataFrame) -> DataFrame:
    """Strict mode: where each fetch of a source stops because of its first bad item.

    Which source inserts a shared url depends on where earlier sources stop, so cuts are found by
    repetition: each round takes the current cuts, finds what each source would insert, and then
    the clashes among that.  A cut is final once those of all earlier sources are, so the rounds
    end, usually after two or three.  Every round is a distributed job over keys only.
    """
    rows = articles.select("id", *PAIR, *INGEST_ORDER)
    fresh = set_aside(rows.join(known_ids(store, rows), "id", "left_anti"))
    missing = set_aside(missing_link_cut(bad))
    cuts = missing
    while True:
        survivors = before_cuts(fresh, cuts).groupBy("id").agg(F.min(ingest_place()).alias("_first"))
        # A source's own cut must not hide an earlier clash of the same source: what counts is
        # that no surviving item comes first.
        unclaimed = fresh.join(survivors, "id", "left").filter(
            F.col("_first").isNull() | (ingest_place() <= F.col("_first"))
        )
        insertable = first_per_key(unclaimed.drop("_first"), ["id", *FETCH], INGEST_ORDER[1:])
        found = missing.unionByName(clash_cut(insertable, store))
        settled = set_aside(found.groupBy(*FETCH).agg(F.min("cut").alias("cut")))
        changed = settled.join(cuts.withColumnRenamed("cut", "_was"), FETCH, "full_outer").filter(
            ~F.col("cut").eqNullSafe(F.col("_was"))
        )
        if changed.isEmpty():
            return settled
        cuts = settled


def before_cuts(articles: DataFrame, cuts: DataFrame) -> DataFrame:
    return lookup(articles, cuts, FETCH, ["sort_key", "pos"], "left").filter(
        F.col("cut").isNull() | (item_place() < F.col("cut"))
    ).drop("cut")


def ingest(
    articles: DataFrame, bad: DataFrame, store: DataFrame, domains: DataFrame, now: Column, *, strict: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New stored rows, their events and the quarantined items.

    By default only the bad items are set aside.  ``strict`` stops a source at its first bad item.
    """
    keep = [*FETCH, "pos", "id", "defect"]
    if strict:
        cuts = source_cuts(articles, bad, store)
        chosen = insert_new(before_cuts(articles, cuts), store)
        items = bad.unionByName(articles.withColumn("defect", F.lit("external_id_conflict")), True)
        stopping = items.withColumn("cut", item_place()).join(cuts, [*FETCH, "cut"], "left_semi")
        quarantine = stopping.select(*keep)
    else:
        chosen, lost = settle_inserts(articles, store)
        quarantine = bad.select(*keep).unionByName(lost.select(*keep))
    numbers = ordered_rank(
        chosen.select("id", *INGEST_ORDER), [F.col(c) for c in INGEST_ORDER], name="ingest_seq"
    ).select("id", "ingest_seq")
    stored = reject_unscored(as_stored(chosen.join(numbers, "id"), now), domains, now)
    return stored, insert_events(stored, now), quarantine


def upsert_sources(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Incoming configuration wins; creation time and counters of a known source stay."""
    configured = ["domain_id", "type", "name", "url", "enabled", "config"]
    old, new = current.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col("o.id") == F.col("n.id"), "full_outer")
    arrived = F.col("n.id").isNotNull()
    zero = F.lit(0).cast("bigint")
    picked = []
    for name in current.columns:
        kept = F.col(f"o.{name}")
        if name == "id":
            picked.append(F.coalesce(F.col("n.id"), F.col("o.id")).alias("id"))
        elif name in configured:
            picked.append(F.when(arrived, F.col(f"n.{name}")).otherwise(kept).alias(name))
        elif name == "updated_at":
            picked.append(F.when(arrived, now).otherwise(kept).alias(name))
        elif name == "created_at":
            picked.append(F.coalesce(kept, now).alias(name))
        elif name in ("consecutive_error_count", "total_error_count"):
            picked.append(F.coalesce(kept, zero).alias(name))
        else:
            picked.append(kept)
    return joined.select(*picked)


def source_summary(fetched: DataFrame, inserted: DataFrame, failed: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts per source: fetched, inserted, duplicate and whether it failed.

    ``fetched`` and ``inserted`` need only ``source_id``; both collapse map-side to one row per source.
    """
    took = fetched.groupBy("source_id").agg(F.count(F.lit(1)).alias("fetched_articles"))
    added = inserted.groupBy("source_id").agg(F.count(F.lit(1)).alias("inserted_articles"))
    broken = failed.select("source_id").distinct().withColumn("failed", F.lit(True))
    zero = F.lit(0).cast("bigint")
    return (
        sources.select(F.col("id").alias("source_id"), "domain_id", "domain_rank", "source_rank")
        .join(took, "source_id", "left")
        .join(added, "source_id", "left")
        .join(broken, "source_id", "left")
        .select(
            "domain_id",
            "source_id",
            "domain_rank",
            "source_rank",
            F.coalesce("fetched_articles", zero).alias("fetched_articles"),
            F.coalesce("inserted_articles", zero).alias("inserted_articles"),
            (F.coalesce("fetched_articles", zero) - F.coalesce("inserted_articles", zero)).alias("duplicate_articles"),
            F.coalesce("failed", F.lit(False)).alias("failed"),
        )
    )


def run_summary(per_source: DataFrame) -> DataFrame:
    """One row of run totals; failed ids in configured order."""
    broken = F.when(F.col("failed"), F.struct("domain_rank", "source_rank", "source_id"))
    return per_source.agg(
        F.count(F.lit(1)).alias("sources_processed"),
        F.coalesce(F.sum("fetched_articles"), F.lit(0)).alias("fetched_articles"),
        F.coalesce(F.sum("inserted_articles"), F.lit(0)).alias("inserted_articles"),
        F.coalesce(F.sum("duplicate_articles"), F.lit(0)).alias("duplicate_articles"),
        F.count_if("failed").alias("failed_sources"),
        F.transform(F.sort_array(F.collect_list(broken)), lambda s: s["source_id"]).alias("failed_source_ids"),
    )


def summary_rollup(per_source: DataFrame) -> DataFrame:
    """The same counts per source, per domain and in total (null marks a rolled-up level)."""
    counts = ("fetched_articles", "inserted_articles", "duplicate_articles")
    return per_source.rollup("domain_id", "source_id").agg(
        *[F.sum(c).alias(c) for c in counts], F.count_if("failed").alias("failed_sources")
    )

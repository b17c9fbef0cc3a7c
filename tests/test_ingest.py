from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from feedspark.functions.identity import article_id
from feedspark.operators.entries import normalize_entries, select_entries
from feedspark.operators.health import fold_source_health, record_fetches
from feedspark.operators.ingest import ingest, insert_new, settle_inserts, source_cuts, upsert_sources
from feedspark.operators.selection import active_sources, select_domains
from feedspark.plans.ingest_run import ingest_run, refreshed_sources
from feedspark.schemas import ARTICLES, FETCH_LOG, SOURCES
from feedspark.sources import config as cfg
from feedspark.sources.connectors import ReaderRegistry
from feedspark.sources.feeds import parse_feeds, settle_fetches
from tests.helpers import attempts, domains, entries, rows, source_config

OLD = [1970, 1, 1, 0, 0, 0]
NOW = [2026, 1, 10, 0, 0, 0]


def settings(spark, **options):
    config = {k: str(v) for k, v in options.items()}
    return cfg.feed_settings(source_config(spark, [{"id": "s1", "config": config}]))


def links(df):
    return [r.link for r in df.orderBy("sort_key", "pos").collect()]


def test_entries_keep_feed_order_without_options(spark, now):
    feed = entries(spark, [{"link": "https://e/1", "published_parsed": OLD}, {"link": "https://e/2"}])
    assert links(select_entries(feed, settings(spark), now)) == ["https://e/1", "https://e/2"]


def test_age_undated_and_cap(spark, now):
    feed = entries(
        spark,
        [{"link": "https://e/old", "published_parsed": OLD}, {"link": "https://e/nodate"},
         {"link": "https://e/a", "published_parsed": NOW}, {"link": "https://e/b", "updated_parsed": NOW}],
    )
    options = {"rss_max_age_hours": 24, "rss_sort_by_published_desc": "yes", "rss_max_items": 1, "rss_drop_if_no_date": "true"}
    assert links(select_entries(feed, settings(spark, **options), now)) == ["https://e/a"]


def test_cap_of_zero_gives_nothing(spark, now):
    feed = entries(spark, [{"link": "https://e/1"}])
    assert links(select_entries(feed, settings(spark, rss_max_items=0), now)) == []


def test_sorting_puts_undated_last_and_keeps_ties(spark, now):
    feed = entries(
        spark, [{"link": "u"}, {"link": "b", "published": "2026-01-02"}, {"link": "a", "published": "2026-01-03"},
                {"link": "b2", "published": "2026-01-02"}],
    )
    assert links(select_entries(feed, settings(spark, rss_sort_by_published_desc=1), now)) == ["a", "b", "b2", "u"]


def test_cap_beyond_the_partial_top_k(spark, now):
    feed = entries(spark, [{"link": f"{n:05d}"} for n in range(1500)])
    assert len(links(select_entries(feed, settings(spark, rss_max_items=1200), now))) == 1200


@pytest.mark.parametrize(
    ("retry", "errors", "ok", "used"),
    [
        (3, [None], True, 1),
        (3, ["ConnectTimeout", None], True, 2),
        (3, ["ReadTimeout"] * 3, False, 3),
        (3, ["HTTPStatusError", None], False, 1),
        (None, ["ConnectTimeout", None], False, 1),
        (0, ["ConnectTimeout", None], False, 1),
    ],
)
def test_fetch_attempts(spark, retry, errors, ok, used):
    tried = attempts(spark, [{"attempt": n + 1, "error_type": e} for n, e in enumerate(errors)])
    retries = spark.createDataFrame([("s1", retry)], "source_id string, retry_attempts int")
    row = settle_fetches(tried, retries).collect()
    assert [(r.ok, r.attempts_used) for r in row] == [(ok, used)]


RSS = (
    "<rss version='2.0' xmlns:content='http://purl.org/rss/1.0/modules/content/'><channel><title>f</title>"
    "<item><title> One </title><link>https://e/1</link><guid>g1</guid><pubDate>Thu, 01 Jan 2026 00:00:00 GMT</pubDate>"
    "<description>short</description><content:encoded>&lt;p&gt;long&lt;/p&gt;</content:encoded></item>"
    "<item><title>Two</title><guid>g2</guid></item></channel></rss>"
)
ATOM = (
    "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>A</title><link rel='self' href='no'/><link href='https://e/a'/>"
    "<id>i1</id><updated>2026-01-01T00:00:00Z</updated><summary>sum</summary><author><name>Me</name></author></entry></feed>"
)


def test_feed_documents(spark):
    landed = attempts(
        spark, [{"source_id": "rss", "body": RSS}, {"source_id": "atom", "body": ATOM}, {"source_id": "bad", "body": "<rss><cha"},
                {"source_id": "empty", "body": "<rss><channel><title>x</title></channel></rss>"}],
    )
    found, warnings = parse_feeds(landed)
    by_key = {(r.source_id, r.pos): r for r in found.collect()}
    assert set(by_key) == {("rss", 0), ("rss", 1), ("atom", 0)}
    assert by_key["rss", 0].content[0].value == "<p>long</p>" and by_key["rss", 0].summary == "short"
    assert by_key["atom", 0].link == "https://e/a" and by_key["atom", 0].author == "Me"
    assert [r.source_id for r in warnings.collect()] == ["bad"]


ITEM = (
    "<item><title>A&nbsp;B &amp; C</title><media:title>M</media:title><media:description>md</media:description>"
    "<description>d</description><link>https://e/1</link><atom:link href='x'/><dc:creator>Me</dc:creator>"
    "<content:encoded><![CDATA[<p>x</item></p>&nbsp;]]></content:encoded></item>"
)
PLAIN = "<item><title>Q & A</title><link>https://e/2?a=1&b=2</link></item>"


def test_prefixes_entities_and_breaks_cost_no_whole_item(spark):
    bodies = {
        "whole": f"<rss><channel><title>t</title>{ITEM}{PLAIN}</channel></rss>",
        "cut": f"<rss><channel>{ITEM}<item><title>bro",
        "middle": f"<rss><channel><item><title>z</ti></item>{PLAIN}</channel></rss>",
        "open": f"<rss><channel><item><title>z</title>{PLAIN}</channel></rss>",
        "comment": f"<rss><channel><!-- {ITEM} -->{PLAIN}</channel></rss>",
        "atom": "<feed><entry><title>A</title><link href='u'/></entry><entry><title>b",
    }
    found, warnings = parse_feeds(attempts(spark, [{"source_id": k, "body": v} for k, v in bodies.items()]))
    got = {(r.source_id, r.pos): r for r in found.collect()}
    assert set(got) == {("whole", 0), ("whole", 1), ("cut", 0), ("middle", 1), ("open", 0), ("comment", 0), ("atom", 0)}
    one = got["whole", 0]
    assert (one.title, one.link, one.summary, one.author) == ("A\xa0B & C", "https://e/1", "d", "Me")
    assert one.content[0].value == "<p>x</item></p>&nbsp;"
    assert (got["whole", 1].title, got["open", 0].link) == ("Q & A", "https://e/2?a=1&b=2")
    assert {r.source_id: r.lost for r in warnings.collect()} == {"cut": 1, "middle": 1, "open": 1, "atom": 1}


def test_documents_are_read_once(spark):
    found, warnings = parse_feeds(attempts(spark, [{"source_id": "whole", "body": RSS}, {"source_id": "bad", "body": "<rss><cha"}]))
    for result in (found, warnings):
        plan = result._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "from_xml" not in plan and "regexp" not in plan and "rlike" not in plan
    assert [r.source_id for r in warnings.collect()] == ["bad"]


def test_unknown_reader_type():
    with pytest.raises(KeyError):
        ReaderRegistry().get("website")


def test_normalize(spark):
    feed = entries(
        spark,
        [{"link": " https://e/1 ", "title": "  ", "content": [("",)], "summary": "s", "published": ""},
         {"link": "\n", "title": "no link"},
         {"link": "https://e/2", "title": " T ", "content": [], "description": "d", "guid": "g"}],
    )
    good, bad = normalize_entries(feed, source_config(spark, [{"id": "s1"}]))
    one, two = good.orderBy("canonical_url").collect()
    assert (one.canonical_url, one.title, one.content, one.published_at) == ("https://e/1", None, "", None)
    assert (two.title, two.content, two.source_item_external_id) == ("T", "d", "g")
    assert one.id == spark.range(1).select(article_id(F.lit("football"), F.lit("https://e/1"))).first()[0]
    assert bad.select("defect").collect()[0][0] == "missing_link"


def incoming(spark, items):
    """Articles from (source_rank, pos, url, external id)."""
    data = [
        (f"d|{url}", "d", f"s{rank}", url, ext, "r", 0, rank, 0, pos) for rank, pos, url, ext in items
    ]
    return spark.createDataFrame(
        data,
        "id string, domain_id string, source_id string, canonical_url string, source_item_external_id string, "
        "run_id string, domain_rank int, source_rank int, sort_key bigint, pos bigint",
    )


def test_first_wins_and_second_ingest_adds_nothing(spark, now):
    batch = incoming(spark, [(1, 0, "u1", "a"), (0, 5, "u1", "b"), (0, 6, "u2", "c")])
    empty = spark.createDataFrame([], ARTICLES)
    off = domains(spark, [{"id": "d", "llm_enabled": False}])
    stored, events, _ = ingest(batch, batch.limit(0).withColumn("defect", F.lit("")), empty, off, now)
    got = {r.canonical_url: r for r in stored.collect()}
    assert got["u1"].source_id == "s0" and got["u1"].editorial_status == "REJECTED"
    assert got["u1"].rejection_reason == "llm_disabled" and len(got) == 2
    assert sorted(r.event_type for r in events.collect()) == ["INGESTED", "INGESTED", "LLM_PROCESSED", "LLM_PROCESSED"]
    assert insert_new(batch, stored).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_default_inserts_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    items = [(rank, pos, f"u{rng.randint(0, 12)}", rng.choice([None, f"e{rng.randint(0, 5)}"])) for rank in range(4)
             for pos in range(9)]
    store = [("s1", "u0", "e1"), ("s2", "u3", "e2")]
    held = spark.createDataFrame(
        [(f"d|{u}", s, e) for s, u, e in store], "id string, source_id string, source_item_external_id string"
    )
    urls, pairs = {u for _, u, _ in store}, {(s, e) for s, _, e in store}
    inserted, clashed = set(), set()
    for rank, pos, url, ext in sorted(items, key=lambda i: i[:2]):
        if url in urls:
            continue
        if ext and (f"s{rank}", ext) in pairs:
            clashed.add((f"s{rank}", pos))
            continue
        urls.add(url)
        pairs.add((f"s{rank}", ext))
        inserted.add((f"s{rank}", pos))
    kept, lost = settle_inserts(incoming(spark, items), held)
    assert {(r.source_id, r.pos) for r in kept.collect()} == inserted
    assert sorted((r.source_id, r.pos) for r in lost.collect()) == sorted(clashed)


def test_copy_that_does_not_clash_is_inserted(spark):
    batch = incoming(spark, [(0, 0, "u1", "a"), (0, 1, "u2", "a"), (1, 0, "u2", "b")])
    kept, lost = settle_inserts(batch, spark.createDataFrame([], ARTICLES))
    assert {(r.source_id, r.canonical_url) for r in kept.collect()} == {("s0", "u1"), ("s1", "u2")}
    assert [(r.source_id, r.pos) for r in lost.collect()] == [("s0", 1)]


def sequential_cuts(items, bad, store):
    """The stated rule, one item after another."""
    urls = {url for _, url, _ in store}
    pairs = {(source, ext) for source, _, ext in store if ext}
    cuts = {}
    for rank in sorted({i[0] for i in items} | {b[0] for b in bad}):
        own = sorted([(pos, url, ext) for r, pos, url, ext in items if r == rank] +
                     [(pos, None, None) for r, pos in bad if r == rank])
        for pos, url, ext in own:
            if url is None or (url not in urls and ext and (f"s{rank}", ext) in pairs):
                cuts[f"s{rank}"] = pos
                break
            if url in urls:
                continue
            urls.add(url)
            if ext:
                pairs.add((f"s{rank}", ext))
    return cuts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strict_cuts_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    items = [(rank, pos, f"u{rng.randint(0, 14)}", rng.choice([None, f"e{rng.randint(0, 9)}"])) for rank in range(5)
             for pos in range(8)]
    bad = [(rng.randint(0, 4), 100)]
    store = [("s1", "u0", "e1"), ("s2", "u3", "e2")]
    held = spark.createDataFrame(
        [(f"d|{u}", s, e) for s, u, e in store], "id string, source_id string, source_item_external_id string"
    )
    bad_rows = spark.createDataFrame(
        [(f"s{r}", "r", 0, p) for r, p in bad], "source_id string, run_id string, sort_key bigint, pos bigint"
    )
    got = {r.source_id: r.cut.k1 for r in source_cuts(incoming(spark, items), bad_rows, held).collect()}
    assert got == sequential_cuts(items, bad, store)


def test_source_upsert_keeps_counters(spark, now):
    old = {"id": "s1", "domain_id": "d", "type": "rss", "name": "old", "enabled": True, "total_error_count": 4,
           "created_at": datetime.datetime(2025, 1, 1)}
    done = upsert_sources(rows(spark, SOURCES, [old]), source_config(spark, [{"id": "s1", "name": "new"}, {"id": "s2"}]), now)
    got = {r.id: r for r in done.collect()}
    assert (got["s1"].name, got["s1"].total_error_count, got["s1"].created_at.year) == ("new", 4, 2025)
    assert (got["s2"].total_error_count, got["s2"].created_at.year) == (0, 2026)


def test_source_health(spark, now):
    log = [("s1", 1, False), ("s1", 2, True), ("s1", 3, False), ("s1", 4, False), ("s2", 1, False), ("s3", 9, True)]
    fetches = rows(
        spark, FETCH_LOG,
        [{"source_id": s, "at": datetime.datetime(2026, 1, n), "run_id": "r", "seq": n, "ok": ok,
          "http_status": 200 if ok else 500, "error_message": None if ok else f"e{n}",
          "last_item_external_id": f"x{n}" if ok else None} for s, n, ok in log],
    )
    stored = rows(
        spark, SOURCES, [{"id": s, "consecutive_error_count": 5, "total_error_count": 7} for s in ("s1", "s2", "s3", "s4")]
    )
    got = {r.id: r for r in record_fetches(stored, fold_source_health(fetches), now).collect()}
    assert (got["s1"].consecutive_error_count, got["s1"].total_error_count, got["s1"].last_error_message) == (2, 10, "e4")
    assert (got["s2"].consecutive_error_count, got["s2"].last_success_at) == (6, None)
    assert (got["s3"].consecutive_error_count, got["s3"].last_error_message, got["s3"].last_item_external_id) == (0, None, "x9")
    assert (got["s4"].consecutive_error_count, got["s4"].updated_at) == (5, None)


def test_config_tables(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(
        '{"llm": {"pricing": {"models": {"larch": {"input_price_per_million_usd": 1.25}}}}, "domains": ['
        '{"id": "football", "name": "F", "llm": {"pipeline_prompt": "f.txt"}, "telegram": {"channel_id": "c"}, "sources": ['
        '{"id": "s1", "type": "rss", "name": "S", "url": "u", "config": {"rss_max_items": 50}},'
        '{"id": "s2", "type": "website", "name": "W"}]}, {"id": "ai", "name": "A", "sources": []}]}'
    )
    config = cfg.scan_config(spark, str(path))
    found = {r.id: r for r in cfg.domains(config).collect()}
    assert found["football"].llm_enabled and not found["ai"].llm_enabled and found["ai"].domain_rank == 1
    active = active_sources(cfg.source_config(config))
    assert [(r.source_id, r.rss_max_items, r.retry_attempts) for r in cfg.feed_settings(active).collect()] == [("s1", 50, 1)]
    assert cfg.run_settings(config).first().asDict() == {
        "max_article_age_hours": 24, "max_published_per_run": 2, "interval_seconds": 60, "default_target_language": "ru",
        "max_articles_per_run": 100, "batch_size": 20,
    }
    assert str(cfg.pricing(config).first().input_price) == "1.250000"
    assert [r.id for r in select_domains(cfg.domains(config), ["ai"]).collect()] == ["ai"]
    with pytest.raises(ValueError, match="nope"):
        select_domains(cfg.domains(config), ["ai", "nope"])


def test_ingest_run_end_to_end(spark, now):
    landed = attempts(spark, [{"source_id": "s1", "body": RSS}, {"source_id": "s2", "error_type": "HTTPStatusError",
                                                                  "http_status": 404, "error_message": "not found"}])
    configured = source_config(spark, [{"id": "s1"}, {"id": "s2", "source_rank": 1}])
    store = spark.createDataFrame([], ARTICLES)
    run = ingest_run(landed, configured, domains(spark, [{"id": "football"}]), store, now)
    total = run.summary.first()
    assert (total.sources_processed, total.fetched_articles, total.inserted_articles, total.failed_source_ids) == (2, 2, 1, ["s2"])
    assert [r.defect for r in run.quarantine.collect()] == ["missing_link"]
    known = rows(spark, SOURCES, [{"id": "s1", "consecutive_error_count": 3}, {"id": "s2"}])
    health = {r.id: r for r in refreshed_sources(known, run, now).collect()}
    assert (health["s1"].consecutive_error_count, health["s1"].last_item_external_id) == (0, "g1")
    assert (health["s2"].last_http_status, health["s2"].last_error_message) == (404, "not found")

    strict = ingest_run(landed, configured, domains(spark, [{"id": "football"}]), store, now, strict=True)
    assert strict.summary.first().failed_source_ids == ["s1", "s2"]
    health = {r.id: r for r in refreshed_sources(known, strict, now).collect()}
    assert health["s1"].consecutive_error_count == 1 and health["s1"].last_success_at is not None

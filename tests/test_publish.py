from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from feedspark.operators.audit import post_checks, short_texts, similar_in_batch, stamp_events
from feedspark.operators.publish import capped_publish, next_to_publish, publish_stats, release_schedule
from feedspark.operators.rendering import render_posts, with_footer
from feedspark.operators.state import current_articles
from feedspark.plans.publish_run import publish_capped, publish_once
from feedspark.schemas import ARTICLES, STATES
from feedspark.sources.connectors import recorded_deliverer
from feedspark.sources.tables import evolve_articles, read_epochs, stored_articles, stored_states, stored_events, write_epoch
from feedspark.streaming.workers import start_ingest, start_publisher
from tests.helpers import articles, attempts, domains, outcomes, source_config, sources
from tests.test_ingest import RSS

DAY = datetime.datetime(2026, 1, 1)


def ready(spark, count, **more):
    return articles(
        spark,
        [{"editorial_status": "READY", "llm_processed_at": DAY + datetime.timedelta(days=n), "final_title": f"T{n}",
          "final_text": f"B{n}", **more} for n in range(count)],
    )


@pytest.mark.parametrize(
    ("outcome", "status", "publication", "event"),
    [
        ({"message_id": 777}, "PUBLISHED", "published", "PUBLISHED"),
        ({"ok": False, "error_type": "ConnectError", "error_message": "e"}, "READY", "unpublished", None),
        ({"ok": False, "error_type": "ConnectTimeout", "error_message": "e"}, "READY", "unpublished", None),
        ({"ok": False, "error_type": "ReadTimeout", "error_message": "e"}, "READY", "unpublished", None),
        ({"ok": False, "error_type": "RuntimeError", "error_message": "e"}, "ERROR", "failed", "ERROR"),
    ],
)
def test_publish_once(spark, now, outcome, status, publication, event):
    store = ready(spark, 2)
    deliver = recorded_deliverer(outcomes(spark, [{"article_id": "a0", **outcome}, {"article_id": "a1", "message_id": 1}]))
    run = publish_once(store, sources(spark, "s1"), domains(spark, [{"id": "football"}]), deliver, now)
    changed = run.changed.collect()
    assert [(r.id, r.editorial_status, r.publication_status) for r in changed] == [("a0", status, publication)]
    assert [r.event_type for r in run.events.collect()] == ([event] if event else [])
    if status == "PUBLISHED":
        assert (changed[0].telegram_message_id, changed[0].telegram_channel, changed[0].lifecycle_state) == (777, "ch", "published")
    else:
        assert changed[0].last_error_stage == "PUBLISH" and changed[0].publication_error == "e"


def test_failed_rows_hold_their_places(spark):
    args = sources(spark, "s1"), domains(spark, [{"id": "football"}])
    blocked = ready(spark, 60).withColumn("publication_status", F.when(F.col("ingest_seq") < 50, "failed"))
    open_ = ready(spark, 60).withColumn("publication_status", F.when(F.col("ingest_seq") < 49, "failed"))
    assert next_to_publish(blocked, *args).count() == 0
    assert next_to_publish(open_, *args).first().id == "a49"
    start = F.lit("2026-02-01").cast("timestamp")
    assert release_schedule(blocked, *args, start, 60).count() == 0
    times = {r.id: (r.release_no, str(r.release_at)) for r in release_schedule(open_, *args, start, 60)
             .withColumn("release_at", F.col("release_at").cast("string")).collect()}
    assert len(times) == 11 and times["a50"] == (2, "2026-02-01 00:01:00")


def test_domain_without_channel_publishes_nothing(spark):
    known = domains(spark, [{"id": "football", "channel_id": ""}])
    assert next_to_publish(ready(spark, 1), sources(spark, "s1"), known).count() == 0


@pytest.mark.parametrize("cap", [0, 1, 2, 3, 2500])
def test_capped_run(spark, now, cap):
    """Stale rows and failures do not count; the run ends with the cap-th success."""
    store = ready(spark, 12).withColumn(
        "published_at", F.when(F.col("ingest_seq") % 3 == 0, "2025-01-01").otherwise("2026-01-09T12:00:00Z")
    )
    recorded = outcomes(spark, [{"article_id": f"a{n}", "ok": n % 4 != 1, "message_id": n, "error_type": "RuntimeError"
                                 if n % 4 == 1 else None} for n in range(12)])
    args = store, sources(spark, "s1"), domains(spark, [{"id": "football"}]), recorded, cap, 24, now
    want, published = [], 0
    for n in range(min(12, cap * 5)):
        if published >= cap:
            break
        action = "skip_old" if n % 3 == 0 else "fail" if n % 4 == 1 else "published"
        published += action == "published"
        want.append((f"a{n}", action))
    got = capped_publish(*args).orderBy("llm_processed_at").collect()
    assert [(r.id, r.action) for r in got] == want
    stats = publish_stats(capped_publish(*args)).first()
    assert stats.published_articles == published
    run = publish_capped(*args)
    kept = {r.id: (r.editorial_status, r.publication_status) for r in run.changed.collect()}
    assert all(kept[i] == ("READY", "failed") for i, a in want if a == "fail")


def footer_cases():
    """Every way to end a post, combined: body, place of its tags, source name and address."""
    for body in ("Ein Satz.", "<b>Kopf</b>\n\nErster.\n\nZweiter."):
        for tags in ([], ["#eins"], ["#eins", "#zwei", "#drei"]):
            for source, url in (("Quelle", "https://q/1"), ("Quelle", None), ("", "")):
                shown = f"Source: {source or 'AI News'}" + (f"\nOriginal: {url}" if url else "")
                want = f"{body}\n\n{shown}\n" + (f"\n{' '.join(tags)}\n" if tags else "")
                for tail in ("\n\n" + "\n".join(tags), "\n\n" + " ".join(tags) + "\n", " " + " ".join(tags)):
                    yield body + tail if tags else body, source, url, want


FOOTER_CASES = [
    *footer_cases(),
    ("Text\n\n#ai\n\n#Big #ai #ai\n", "S", None, "Text\n\n#ai\n\nSource: S\n\n#ai\n"),
    ("#ai #two", "S", None, "Source: S\n\n#ai #two\n"),
    ("a\n\n  #x", "S", None, "a\n\nSource: S\n\n#x\n"),
    ("a\n #x\nЧитайте нас", "S", None, "a\n\nSource: S\n\n#x\n"),
    (" ", "S", "u", ""),
]


def test_footer(spark):
    df = spark.createDataFrame([(n, *case) for n, case in enumerate(FOOTER_CASES)], "n int, text string, s string, u string, want string")
    got = with_footer(df, "text", F.col("s"), F.col("u"), "post").orderBy("n").collect()
    assert [r.post for r in got] == [r.want for r in got]


def test_render(spark):
    df = spark.createDataFrame(
        [("football", "T", "B", "S", "2026-01-01", "u"), ("football", "T<", "", "S&", None, "u"), ("ai", None, None, "S", "soon", "u")],
        "domain_id string, final_title string, final_text string, source_name string, published_at string, canonical_url string",
    )
    got = [r.post_text for r in render_posts(df).collect()]
    assert got == ["T\n\nB", "T&lt;\n\nS&amp;\n\n-\n\nu", "u\n\nS\n\nsoon\n\nu\n\nSource: S\nOriginal: u\n"]
    plain = render_posts(df, parse_mode="plain").collect()[1].post_text
    assert plain == "T<\n\nS&\n\n-\n\nu"


def test_audits(spark):
    posts = spark.createDataFrame(
        [("ai", "<b>T</b>", "x\n\n#ai #b"), ("football", "T", "<i>x</i> #football")], "domain_id string, final_title string, final_text string"
    )
    one, two = post_checks(posts).collect()
    assert one.length_ok and one.tag_count_ok and one.required_tag_ok and one.title_bold_ok and one.plain_text_ok
    assert not (two.tag_count_ok or two.title_bold_ok or two.plain_text_ok) and two.required_tag_ok
    store = articles(spark, [{"content": "one two"}, {"content": " ".join("w" * 10)}, {"content": None}])
    assert {r.id: r.words for r in short_texts(store).collect()} == {"a0": 2, "a2": 0}
    stamped = stamp_events(spark.createDataFrame([("Bearer abc", None)], "event string, env string"), "svc").first()
    assert (stamped.event, stamped.env, stamped.service) == ("Bearer ***", "local", "svc")


def test_similar_pairs_equal_brute_force(spark):
    texts = ["a b c d", "a b c e", "x y", "x y", "q", "a b c d e f g h", "", "d c b a"]
    words = [set(t.split()) for t in texts]
    batches = spark.createDataFrame([("b", n) for n in range(len(texts))], "batch_id string, article_id int")
    data = spark.createDataFrame(list(enumerate(texts)), "article_id int, text string")
    for threshold in (0.3, 0.5, 0.6, 1.0):
        want = {(i, j) for i in range(8) for j in range(i + 1, 8) if words[i] and words[j]
                and len(words[i] & words[j]) / len(words[i] | words[j]) >= threshold}
        got = {(r.article_id, r.other_id) for r in similar_in_batch(batches, data, threshold).collect()}
        assert got == want


def test_similar_pairs_of_an_article_in_two_batches(spark):
    batches = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 1), ("b2", 2), ("b2", 3)], "batch_id string, article_id long")
    texts = spark.createDataFrame([(1, "one two three"), (2, "One two three four"), (3, "five six")], "article_id long, text string")
    found = sorted(map(tuple, similar_in_batch(batches, texts, 0.5).collect()))
    assert found == [("b1", 1, 2, 3, 4), ("b2", 1, 2, 3, 4)]


def test_similar_pairs_leave_out_what_cannot_reach_the_threshold(spark):
    # The longest word is shared and the sizes are alike, but nothing else can be.
    batches = spark.createDataFrame([("b", n) for n in range(2)], "batch_id string, article_id long")
    texts = spark.createDataFrame(
        [(n, "commonest " + " ".join(f"w{n}{k}" for k in range(9))) for n in range(2)], "article_id long, text string"
    )
    found = similar_in_batch(batches, texts, 0.5)
    assert found.isEmpty() and "least(" in found._jdf.queryExecution().optimizedPlan().toString()


def test_schema_repair(spark, now):
    old = articles(spark, [{}, {"telegram_message_id": 9}, {"publication_status": "published"}]).drop("editorial_status", "final_text")
    got = evolve_articles(old, now)
    assert got.columns == ARTICLES.names
    assert {r.id: r.editorial_status for r in got.collect()} == {"a0": "NEW", "a1": "PUBLISHED", "a2": "PUBLISHED"}


def test_streams(spark, now, tmp_path):
    """Landed fetches are followed, repeats add nothing, and ticks publish one article each."""
    root, landing = str(tmp_path / "store"), str(tmp_path / "landing")
    second = RSS.replace("https://e/1", "https://e/3").replace("g1", "g3")
    configured = source_config(spark, [{"id": "s1"}])
    known = domains(spark, [{"id": "football"}])
    for n, body in enumerate([RSS, RSS, second]):
        attempts(spark, [{"run_id": f"r{n}", "body": body}]).coalesce(1).write.mode("append").parquet(landing)

    def follow():
        query = start_ingest(spark, landing, root, str(tmp_path / "p1"), configured, known, clock=lambda: now,
                             files_per_batch=1, once=True)
        query.awaitTermination()

    follow()
    assert sorted(r.canonical_url for r in stored_articles(spark, root).collect()) == ["https://e/1", "https://e/3"]
    assert stored_events(spark, root).count() == 2
    attempts(spark, [{"run_id": "r9", "body": second}]).coalesce(1).write.mode("append").parquet(landing)
    follow()
    assert stored_articles(spark, root).count() == 2

    decided = stored_states(spark, root).withColumn("updated_at", F.lit("2026-01-10 12:00:00").cast("timestamp")).select(
        *[F.lit("READY").alias(c) if c == "editorial_status" else F.col(c) for c in STATES.names]
    )
    write_epoch(decided, root, "states", "editorial", 0)
    ids = [r.id for r in decided.collect()]
    deliver = recorded_deliverer(outcomes(spark, [{"article_id": i, "message_id": n} for n, i in enumerate(ids)]))
    ticks = str(tmp_path / "ticks")
    later = F.lit("2026-01-11").cast("timestamp")
    for expected in (1, 2, 2):
        spark.range(1).coalesce(1).write.mode("append").parquet(ticks)
        stream = spark.readStream.schema("id bigint").parquet(ticks)
        start_publisher(stream, root, str(tmp_path / "p2"), sources(spark, "s1"), known, deliver, clock=lambda: later,
                        once=True).awaitTermination()
        current = current_articles(stored_articles(spark, root), stored_states(spark, root))
        assert current.filter("editorial_status = 'PUBLISHED'").count() == expected
    assert stored_events(spark, root).filter("event_type = 'PUBLISHED'").count() == 2
    assert read_epochs(spark, root, "nothing", STATES).count() == 0


def test_stream_keeps_what_it_sets_aside(spark, now, tmp_path):
    from feedspark.sources.tables import read_epochs
    from feedspark.schemas import FETCH_LOG, schema

    root, landing = str(tmp_path / "store"), str(tmp_path / "landing")
    item = "<item><title>t</title><guid>g2</guid></item>"  # no link
    body = f"<rss><channel><item><title>a</title><link>https://e/1</link><guid>g1</guid></item>{item}<item><title>broken"
    rows = [{"run_id": "r0", "http_status": 200, "body": body}, {"run_id": "r1", "http_status": 404, "error_type": "HTTPStatusError", "error_message": "gone"}]
    attempts(spark, rows).coalesce(1).write.parquet(landing)
    start_ingest(spark, landing, root, str(tmp_path / "p"), source_config(spark, [{"id": "s1"}]), domains(spark, [{"id": "football"}]),
                 clock=lambda: now, once=True).awaitTermination()
    bad = schema("source_id string, run_id string, pos bigint, id string, defect string")
    assert [(r.source_id, r.run_id, r.pos, r.defect) for r in read_epochs(spark, root, "quarantine", bad).collect()] == [("s1", "r0", 1, "missing_link")]
    warned = schema("source_id string, run_id string, event string, lost bigint")
    assert [(r.run_id, r.lost) for r in read_epochs(spark, root, "warnings", warned).collect()] == [("r0", 1)]
    assert {(r.run_id, r.ok) for r in read_epochs(spark, root, "fetch_log", FETCH_LOG).collect()} == {("r0", True), ("r1", False)}


def test_sinks(spark, now, tmp_path):
    from feedspark.operators.state import event_rows
    from feedspark.sources.tables import append_events, append_log_lines

    base = spark.range(2)
    events = event_rows(base, article_id=F.concat(F.lit("a"), "id"), event_type=F.lit("INGESTED"),
                        details=F.lit(None).cast("string"), error=F.lit(None).cast("string"), now=now)
    for _ in range(2):
        append_events(events, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).count() == 4
    append_log_lines(stamp_events(spark.createDataFrame([("/botX/", None)], "event string, env string"), "svc"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).first().event == "/bot***/"

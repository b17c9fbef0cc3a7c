from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feedspark.operators.batching import plan_batches
from feedspark.operators.decisions import batch_decisions, batch_summary, match_results, single_decisions
from feedspark.operators.parsing import parse_batch_results, parse_single, tag_error
from feedspark.operators.report import ingest_report, usage_report
from feedspark.operators.selection import articles_by_ids, llm_candidates, unpublished_candidates
from feedspark.operators.state import apply_decisions, decision_events, latest_events
from feedspark.operators.usage import match_pricing, price_usage, summarize_usage, usage_by_batch
from feedspark.plans.editorial_run import apply_answers, apply_single_answers, plan_requests
from feedspark.schemas import EVENTS, PRICING
from feedspark.sources.prompts import missing_prompts, scan_prompts
from feedspark.sources.responses import parse_api_errors, parse_responses
from tests.helpers import articles, domains, responses, rows, sources

GOOD = "### RESULT\nArticle-ID: {0}\nStatus: READY_TO_PUBLISH\nTitle:\n<b>T {0}</b>\nText:\nBody {0}\n### END RESULT\n"
REJECT = "### RESULT\n\nArticle-ID: {0}\nStatus: REJECT\n\nReason:\nnot football\n\n### END RESULT\n"


def parsed(spark, text):
    found = parse_batch_results(responses(spark, [{"output_text": text}]))
    return {r.article_id: r for r in found.collect()}


def test_batch_answer_happy_path(spark):
    got = parsed(spark, "\n" + REJECT.format("a1") + "\n" + GOOD.format("a2"))
    assert (got["a1"].decision, got["a1"].reason) == ("REJECT", "not football")
    assert (got["a2"].decision, got["a2"].title, got["a2"].text) == ("READY_TO_PUBLISH", "<b>T a2</b>", "Body a2")


@pytest.mark.parametrize(
    ("text", "failure"),
    [("READY_TO_PUBLISH", "No RESULT blocks found in LLM batch output"), (" \n", "Empty LLM batch output"),
     (None, "Empty LLM batch output"), ("### RESULT\n\n### END RESULT", "No RESULT blocks found in LLM batch output"),
     ("### RESULT\nArticle-ID: a1", "No RESULT blocks found in LLM batch output")],
)
def test_unusable_answers(spark, text, failure):
    assert {k: r.failure for k, r in parsed(spark, text).items()} == {None: failure}


def test_block_rules(spark):
    text = "\n".join(
        [
            "### END RESULT", "### RESULT", "Article-ID: gone", "### RESULT", "  Article-ID: kept ", "Status: MAYBE",
            "Status: REJECT", "Reason: inline", "", "tail", "### END RESULT", "noise", "### RESULT", "Status: REJECT",
            "### END RESULT", "### RESULT", "Article-ID: t", "Status: READY_TO_PUBLISH", "Title:", "Text: body", "more",
            "### END RESULT", "### RESULT", "Article-ID: nostatus", "### END RESULT",
        ]
    )
    got = parsed(spark, text)
    assert set(got) == {None, "kept", "t", "nostatus"}
    assert got["kept"].reason == "Status: REJECT\nReason: inline\ntail"
    assert (got["t"].title, got["t"].text) == ("Text: body", "body\nmore")
    assert got["nostatus"].error == "missing_status"


def plan(spark, count, batch_size=20, max_total=100, **article):
    store = articles(spark, [dict(article) for _ in range(count)])
    return store, plan_batches(store, sources(spark, "s1"), domains(spark, [{"id": "football"}]), max_total, batch_size)


def statuses(df):
    return {r.id: r.editorial_status for r in df.collect()}


def test_eighteen_of_twenty(spark, now):
    store, batches = plan(spark, 20)
    text = "\n".join(GOOD.format(f"a{n}") for n in range(18))
    text += "\n### RESULT\nArticle-ID: a18\nStatus: READY_TO_PUBLISH\nTitle: t\n### END RESULT"
    answer = responses(spark, [{"batch_id": "football#1", "output_text": text, "articles": 20}])
    matched = match_results(batches, answer)
    decisions = batch_decisions(matched, domains(spark, [{"id": "football"}]))
    done = {r.id: r for r in apply_decisions(store, decisions, now).collect()}
    assert sum(r.editorial_status == "READY" for r in done.values()) == 18
    assert (done["a18"].last_error_stage, done["a18"].last_error_message) == ("LLM_BATCH_PARSE", "missing_text")
    assert done["a19"].last_error_message == "missing_result_for_article"
    assert done["a0"].final_language == "ru" and done["a0"].llm_processed_at is not None
    counts = batch_summary(matched).first()
    assert (counts.ok_count, counts.error_count, counts.missing_count) == (18, 1, 1)


def test_answer_without_readable_blocks_leaves_articles_missing(spark):
    _, batches = plan(spark, 2)
    answer = responses(spark, [{"batch_id": "football#1", "output_text": "### RESULT\nStatus: REJECT\n### END RESULT"}])
    assert {r.outcome for r in match_results(batches, answer).collect()} == {"missing"}


def test_unknown_duplicate_and_failed_requests(spark):
    _, batches = plan(spark, 3, batch_size=2)
    text = GOOD.format("x999") + GOOD.format("a0") + REJECT.format("a0") + GOOD.format("x999")
    answer = responses(
        spark, [{"batch_id": "football#1", "output_text": text},
                {"batch_id": "football#2", "ok": False, "error_message": "boom", "output_text": None}],
    )
    matched = match_results(batches, answer)
    got = {r.article_id: (r.outcome, r.message) for r in matched.collect()}
    assert got == {
        "x999": ("unknown", None), "a0": ("duplicate", "duplicate_article_id_in_response"),
        "a1": ("missing", "missing_result_for_article"), "a2": ("request_failed", "boom"),
    }
    one = {r.batch_id: r for r in batch_summary(matched).collect()}["football#1"]
    assert (one.error_count, one.logged_error_count, one.duplicate_id_count, one.unknown_id_count) == (1, 3, 2, 1)


def test_random_defects_are_predicted(spark):
    rng = random.Random(3)
    blocks, want = [], {}
    for n in range(60):
        kind = rng.choice(["ok", "absent", "twice", "nostatus", "open", "tag"])
        text = GOOD.format(f"a{n}")
        if kind == "ok":
            want[f"a{n}"] = "ready"
        elif kind in ("absent", "open"):
            text = "" if kind == "absent" else f"### RESULT\nArticle-ID: a{n}\n"
            want[f"a{n}"] = "missing"
        elif kind == "twice":
            text, want[f"a{n}"] = text * 2, "duplicate"
        elif kind == "nostatus":
            text, want[f"a{n}"] = text.replace("Status: READY_TO_PUBLISH", "Status: ?"), "error"
        else:
            text, want[f"a{n}"] = text.replace("Body", "<p>Body</p>"), "bad_tag"
        blocks.append(text)
    asked = spark.createDataFrame([("b1", "football", k) for k in want], "batch_id string, domain_id string, article_id string")
    got = match_results(asked, responses(spark, [{"output_text": "noise\n" + "\n".join(blocks) + GOOD.format("a59x")}]))
    assert {r.article_id: r.outcome for r in got.collect()} == {**want, "a59x": "unknown"}


def test_tags(spark):
    df = spark.createDataFrame([("<b>x</b> < I >y",), ("<a href='x'>",), ("</Script >",), ("1 < 2",)], "t string")
    assert [r[0] for r in df.select(tag_error(F.col("t"))).collect()] == [
        None, "Disallowed HTML tag in output: <a>", "Disallowed HTML tag in output: <script>", None
    ]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("REJECT\nnope", ("REJECT", "nope", None, None, None)),
        ("REJECT", ("REJECT", None, None, None, None)),
        ("READY_TO_PUBLISH\nTitle: T\nText: one\ntwo", ("READY_TO_PUBLISH", None, "T", "one\ntwo", None)),
        ("READY_TO_PUBLISH\n\nTitle: T\n\n Text: \nbody", ("READY_TO_PUBLISH", None, "T", "body", None)),
        ("READY_TO_PUBLISH\nTitle: T\n Text: inline", (None, None, None, None, "READY_TO_PUBLISH output must contain 'Text: ...'")),
        ("READY_TO_PUBLISH\nTitle:\nText: x", (None, None, None, None, "READY_TO_PUBLISH output must contain 'Title: ...'")),
        ("READY_TO_PUBLISH", (None, None, None, None, "READY_TO_PUBLISH output is missing title")),
        ("READY_TO_PUBLISH\nTitle: T", (None, None, None, None, "READY_TO_PUBLISH output is missing text body")),
        ("hello", (None, None, None, None, "Unrecognized LLM output header: 'hello'")),
        ("", (None, None, None, None, "Empty LLM output")),
    ],
)
def test_single_answers(spark, text, want):
    row = parse_single(responses(spark, [{"output_text": text}])).first()
    assert (row.decision, row.reason, row.title, row.text, row.error) == want


def test_single_mode_rejects(spark, now):
    store, batches = plan(spark, 2, batch_size=1)
    answers = responses(spark, [{"batch_id": f"football#{n}", "output_text": "REJECT\nnope"} for n in (1, 2)])
    run = apply_single_answers(store, domains(spark, [{"id": "football"}]), batches, answers, now)
    assert statuses(run.changed) == {"a0": "REJECTED", "a1": "REJECTED"}
    assert run.usage_totals is None
    lost = responses(spark, []).withColumn("article_id", F.lit("a0")).withColumn("domain_id", F.lit("football"))
    assert single_decisions(lost, domains(spark, [{"id": "football"}])).count() == 0


@pytest.mark.parametrize(("count", "size", "total", "batches"), [(11, 10, 100, 2), (68, 20, 100, 4), (40, 20, 30, 2), (5, 0, 100, 5)])
def test_batch_counts(spark, count, size, total, batches):
    _, planned = plan(spark, count, batch_size=size, max_total=total)
    assert planned.select("batch_id").distinct().count() == batches
    assert planned.count() == min(count, total)


def test_unlimited_plan_equals_the_windowed_one(spark):
    _, capped = plan(spark, 30, batch_size=7, max_total=1000)
    _, unlimited = plan(spark, 30, batch_size=7, max_total=None)
    assert sorted(map(tuple, capped.collect())) == sorted(map(tuple, unlimited.collect()))


def test_budget_follows_domain_order(spark):
    store = articles(spark, [{"domain_id": "b"}, {"domain_id": "a"}, {"domain_id": "b"}, {"domain_id": "off"}])
    known = domains(spark, [{"id": "b", "domain_rank": 1}, {"id": "a", "domain_rank": 0},
                            {"id": "off", "domain_rank": 2, "llm_enabled": False}])
    got = plan_batches(store, sources(spark, "s1"), known, 2, 20)
    assert {r.article_id for r in got.collect()} == {"a1", "a0"}
    assert plan_batches(store, sources(spark, "s1"), known, 0, 20).count() == 0


def test_request_text(spark, tmp_path):
    (tmp_path / "p.txt").write_text("Decide.\nWell.")
    store = articles(spark, [{"title": " \t", "content": None, "published_at": ""}, {"published_at": "2026-01-01"}])
    known = domains(spark, [{"id": "football"}, {"id": "ai", "prompt_file": "absent.txt"}])
    prompts = scan_prompts(spark, str(tmp_path))
    assert [r.domain_id for r in missing_prompts(known, prompts).collect()] == ["ai"]
    ready = prompts.withColumn("domain_id", F.lit("football"))
    _, requests = plan_requests(store, store, sources(spark, "s1"), known, ready, 100, 20)
    row = requests.first()
    assert row.prompt == "Decide.\nWell." and row.articles == 2
    assert row.input_text == (
        "### ARTICLE\n\nArticle-ID: a0\nSource: Name s1\nURL: https://example.com/0\nPublished: -\n\nTitle:\n-\n\n"
        "Content:\n-\n\n### END ARTICLE\n\n### ARTICLE\n\nArticle-ID: a1\nSource: Name s1\nURL: https://example.com/1\n"
        "Published: 2026-01-01\n\nTitle:\nt1\n\nContent:\nc1\n\n### END ARTICLE\n"
    )
    _, single = plan_requests(store, store, sources(spark, "s1"), known, ready, 100, 1)
    assert single.orderBy("batch_index").first().input_text.startswith("### ARTICLE\n\nSource: Name s1\nURL:")


def test_candidate_lists(spark):
    store = articles(spark, [{}, {"editorial_status": None}, {"editorial_status": "READY"}, {"source_id": "orphan"},
                             {"telegram_message_id": 5}])
    known = sources(spark, "s1")
    assert [r.id for r in llm_candidates(store, known, ["football"], 10).orderBy("created_at").collect()] == ["a0", "a1", "a4"]
    assert llm_candidates(store, known, ["football"], 0).count() == 0
    assert llm_candidates(store, known, [], 5).count() == 0
    assert [r.id for r in unpublished_candidates(store, known, ["football"], 1).collect()] == ["a2"]
    ids = spark.createDataFrame([("a0",), ("zz",)], "id string")
    assert [r.source_name for r in articles_by_ids(store, known, ids).collect()] == ["Name s1"]


KEYS = ["larch", "larch-short", "larch-short-fast", "larches"]
PRICES = [(key, str(2 * n + 1), str(n + 2)) for n, key in enumerate(KEYS)]


def prices(spark):
    return spark.createDataFrame([(k, Decimal(a), Decimal(b)) for k, a, b in PRICES], PRICING)


def test_versioned_model_names(spark):
    """A key matches itself and its versions after a dash; the longest one counts; nothing else matches."""
    want = {name: key for key in KEYS for name in (key, f"{key}-v3", f"{key}-v3-b")}
    others = [f"{KEYS[0]}x", f"x-{KEYS[0]}", KEYS[0][:-1], "", None]
    models = spark.createDataFrame([(m,) for m in [*want, *others]], "model string")
    assert {r.model: r.model_key for r in match_pricing(models, prices(spark)).collect()} == want


def usage(spark, records):
    return price_usage(responses(spark, [{"model": "larch", "articles": 20, **r} for r in records]), prices(spark))


def test_usage_totals(spark):
    priced = usage(
        spark,
        [{"batch_id": "1", "input_tokens": 100, "output_tokens": 50, "total_tokens": 150, "cached_tokens": 7, "reasoning_tokens": 1},
         {"batch_id": "2", "status": "incomplete", "input_tokens": 200, "output_tokens": 80, "total_tokens": 280,
          "cached_tokens": 3, "reasoning_tokens": 2}],
    )
    got = summarize_usage(priced).first()
    assert (got.input_tokens, got.output_tokens, got.total_tokens, got.cached_tokens, got.reasoning_tokens) == (300, 130, 430, 10, 3)
    assert (got.completed_response_count, got.incomplete_response_count) == (1, 1)
    assert (got.total_cost_usd, got.average_cost_per_article_usd, got.total_cost_cents) == ("0.000560", "0.000014", 0)
    assert got.model == "larch"


def test_usage_with_failures_and_several_models(spark):
    priced = usage(spark, [{"batch_id": "1", "ok": False, "model": None}, {"batch_id": "2", "model": "other"}, {"batch_id": "3"}])
    got = summarize_usage(priced).first()
    assert (got.model, got.attempted_request_count, got.failed_request_count, got.attempted_article_count, got.article_count) == (
        "multiple", 3, 1, 60, 40
    )
    lines = {r.batch_id: r for r in usage_by_batch(priced).collect()}
    assert set(lines) == {"2", "3"} and lines["2"].pricing_missing and lines["3"].usage_missing


def labels(df):
    return {r.label: r.value for r in df.collect()}


def test_report_forms(spark):
    idle = labels(usage_report(summarize_usage(usage(spark, []))))
    assert list(idle) == ["LLM stage not executed"]
    failed = labels(usage_report(summarize_usage(usage(spark, [
        {"batch_id": str(n), "ok": False, "model": None, "requested_model": "larch-short"} for n in range(5)]))))
    assert (failed["Model"], failed["Failed requests"], failed["Total cost USD"]) == ("larch-short", "5", "unavailable")
    normal = labels(usage_report(summarize_usage(usage(spark, [
        {"batch_id": str(n), "input_tokens": 1000, "output_tokens": 500, "total_tokens": 1500} for n in range(2)]))))
    assert (normal["Total cost USD"], normal["Average cost/article"], normal["Total cost cents"]) == ("$0.004000", "$0.000100", "0")
    summary = spark.sql("select 2L sources_processed, 0L failed_sources, array() failed_source_ids, 3L fetched_articles, "
                        "2L inserted_articles, 1L duplicate_articles")
    assert labels(ingest_report(summary))["Failed source ids"] == "-"


ANSWER = (
    '{"model": "larch", "status": "completed", "output": [{"type": "reasoning"}, {"type": "message", "role": "assistant", '
    '"content": [{"type": "output_text", "text": " Hello "}, {"type": "output_text", "text": ""}]}], "usage": {"input_tokens": 100, '
    '"output_tokens": 50, "total_tokens": 150, "input_tokens_details": {"cached_tokens": 7}, '
    '"output_tokens_details": {"reasoning_tokens": 11}}}'
)


def test_recorded_answers(spark):
    landed = spark.createDataFrame(
        [("1", "asked", ANSWER), ("2", "asked", '{"model": " ", "incomplete_details": {"reason": "max_output_tokens"}, "output": []}'),
         ("3", "asked", "not json"), ("4", "asked", ANSWER.replace('"total_tokens": 150, ', ""))],
        "batch_id string, requested_model string, body string",
    )
    got = {r.batch_id: r for r in parse_responses(landed).collect()}
    one = got["1"]
    assert (one.output_text, one.model, one.total_tokens, one.cached_tokens, one.reasoning_tokens, one.ok) == (
        "Hello", "larch", 150, 7, 11, True
    )
    assert (got["2"].model, got["2"].incomplete_reason, got["2"].total_tokens, got["2"].ok) == ("asked", "max_output_tokens", 0, False)
    assert got["3"].error_message == "Responses API returned no output_text"
    assert got["4"].total_tokens == 150


def test_api_errors(spark):
    bodies = ['{"error": {"message": "m", "type": "t", "code": "c"}}', '{"error": {"message": 1, "type": null, "code": 403}}', "[]", "<html>"]
    df = spark.createDataFrame([(n, b) for n, b in enumerate(bodies)], "n int, body string")
    got = [(r.error_type, r.error_code, r.error_message) for r in parse_api_errors(df).orderBy("n").collect()]
    assert got == [("t", "c", "m"), (None, "403", None), (None, None, None), (None, None, None)]


def test_editorial_run(spark, now):
    store, batches = plan(spark, 3, batch_size=2)
    known = domains(spark, [{"id": "football", "target_language": "en"}])
    answers = responses(spark, [{"batch_id": "football#1", "output_text": GOOD.format("a0"), "articles": 2},
                                {"batch_id": "football#2", "ok": False, "error_message": "down", "articles": 1}])
    run = apply_answers(store, known, batches, answers, prices(spark), now)
    assert statuses(run.changed) == {"a0": "READY", "a1": "ERROR", "a2": "ERROR"}
    kinds = {r.article_id: (r.event_type, r.details_json, r.error_message) for r in run.events.collect()}
    assert kinds["a0"] == ("LLM_PROCESSED", '{"decision":"READY_TO_PUBLISH","final_language":"en"}', None)
    assert kinds["a2"] == ("ERROR", None, "down")
    assert run.usage_totals.first().failed_request_count == 1


def test_latest_event(spark):
    trail = rows(spark, EVENTS, [{"seq": n, "article_id": "a", "event_type": t} for n, t in enumerate(["INGESTED", "ERROR"])])
    assert latest_events(trail).first().event_type == "ERROR"
    assert decision_events(
        batch_decisions(match_results(plan(spark, 1)[1], responses(spark, [])), domains(spark, [{"id": "football"}])),
        F.lit("2026-01-10").cast("timestamp"),
    ).first().event_type == "ERROR"

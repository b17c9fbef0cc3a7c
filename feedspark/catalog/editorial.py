"""Batch planning, request text, and parsing and applying of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.catalog.views import DOMAINS_CTE, STORED_WITH, domains, instant, ntz, sources, stored, table
from feedspark.operators.batching import article_text, build_requests, plan_batches
from feedspark.operators.decisions import (
    batch_decisions,
    batch_summary,
    match_results,
    single_decisions,
    unknown_ids,
)
from feedspark.operators.parsing import parse_batch_results, parse_single
from feedspark.operators.selection import awaiting_decision, with_source_name
from feedspark.operators.state import apply_decisions, decision_events
from feedspark.schemas import ARTICLES
from feedspark.sources.prompts import domain_prompts, missing_prompts

NOW = "2024-03-01 00:00:00"


# -- planning -------------------------------------------------------------------------------------


def _plan(spark: SparkSession, d: str, max_total: int | None) -> DataFrame:
    return plan_batches(stored(spark, d), sources(spark, d), domains(spark, d), max_total, 20)


def budget_batches(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, 300)


def full_batches(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, None)


def _planned_cte(limit: str) -> str:
    return f"""{STORED_WITH}, budget AS (
  SELECT c.id, c.domain_id, c.created_at, c.ingest_seq, c.source_name, c.canonical_url, c.published_at, c.title, c.content
  FROM candidates c JOIN domains d ON d.id = c.domain_id WHERE d.llm_enabled
  ORDER BY d.domain_rank, c.created_at, c.ingest_seq {limit}),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY created_at, ingest_seq) - 1 AS k FROM budget),
planned AS (
  SELECT domain_id || '#' || (k // 20 + 1) AS batch_id, domain_id, k // 20 + 1 AS batch_index,
    CAST(k % 20 + 1 AS INTEGER) AS slot, id AS article_id, source_name, canonical_url, published_at, title, content
  FROM numbered)"""


BUDGET_BATCHES_SQL = f"""{_planned_cte('LIMIT 300')}
SELECT batch_id, domain_id, batch_index, slot, article_id FROM planned
"""
FULL_BATCHES_SQL = f"""{_planned_cte('')}
SELECT batch_id, domain_id, batch_index, slot, article_id FROM planned
"""


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The first document of a language as its prompt; the German one is missing."""
    return (
        table(spark, d, "documents")
        .filter("lang <> 'de'")
        .groupBy("lang")
        .agg(F.min_by("text", "doc_id").alias("prompt"))
        .select(F.concat("lang", F.lit("_rules.txt")).alias("prompt_file"), "prompt")
    )


def prompt_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = domain_prompts(domains(spark, d), prompts(spark, d))
    absent = missing_prompts(domains(spark, d), prompts(spark, d)).withColumn("missing", F.lit(True))
    return found.join(absent.select("domain_id", "missing"), "domain_id", "left").select(
        "domain_id", "prompt_file", F.md5("prompt").alias("prompt_md5"),
        F.coalesce("missing", F.lit(False)).alias("missing"),
    )


PROMPT_LOOKUP_SQL = f"""WITH {DOMAINS_CTE}
SELECT d.id AS domain_id, prompt_file, md5(p.text) AS prompt_md5, p.text IS NULL AS missing
FROM domains d LEFT JOIN (
  SELECT lang, arg_min(text, doc_id) AS text FROM documents WHERE lang <> 'de' GROUP BY lang) p ON p.lang = d.id
WHERE d.llm_enabled
"""


def batch_input(spark: SparkSession, d: str) -> DataFrame:
    """Request text of every batch, over whole article texts."""
    rows = stored(spark, d)
    names = domain_prompts(domains(spark, d), prompts(spark, d))
    requests = build_requests(full_batches(spark, d), rows, sources(spark, d), names)
    return requests.select(
        "batch_id", "articles", F.md5("input_text").alias("input_md5"), F.length("input_text").alias("input_chars"),
        F.md5("prompt").alias("prompt_md5"),
    )


_DASHED = "coalesce(nullif(trim({0}, ' ' || chr(9) || chr(10) || chr(13)), ''), '-')"
_ARTICLE_BODY = (
    "'Source: ' || source_name || chr(10) || 'URL: ' || canonical_url || chr(10) || 'Published: ' || "
    "coalesce(nullif(published_at, ''), '-') || chr(10) || chr(10) || 'Title:' || chr(10) || "
    + _DASHED.format("title") + " || chr(10) || chr(10) || 'Content:' || chr(10) || " + _DASHED.format("content")
)

BATCH_INPUT_SQL = f"""{_planned_cte('')},
blocks AS (
  SELECT batch_id, domain_id, slot, '### ARTICLE' || chr(10) || chr(10) || 'Article-ID: ' || article_id || chr(10) ||
    {_ARTICLE_BODY} || chr(10) || chr(10) || '### END ARTICLE' AS block FROM planned),
texts AS (
  SELECT batch_id, domain_id, CAST(count(*) AS INTEGER) AS articles,
    string_agg(block, chr(10) || chr(10) ORDER BY slot) || chr(10) AS input_text FROM blocks GROUP BY batch_id, domain_id)
SELECT batch_id, articles, md5(input_text) AS input_md5, CAST(length(input_text) AS INTEGER) AS input_chars,
  md5(p.text) AS prompt_md5
FROM texts t LEFT JOIN (
  SELECT lang, arg_min(text, doc_id) AS text FROM documents WHERE lang <> 'de' GROUP BY lang) p ON p.lang = t.domain_id
"""


def single_input(spark: SparkSession, d: str) -> DataFrame:
    rows = with_source_name(awaiting_decision(stored(spark, d)), sources(spark, d))
    return rows.select("id", F.md5(article_text()).alias("input_md5"))


SINGLE_INPUT_SQL = f"""{STORED_WITH}
SELECT id, md5('### ARTICLE' || chr(10) || chr(10) || {_ARTICLE_BODY} || chr(10)) AS input_md5 FROM candidates
"""


# -- answers ----------------------------------------------------------------------------------------
#
# Twenty documents make a batch.  Each contributes a block whose defect follows from its number, so
# the SQL predicts every outcome from the number alone and knows nothing about parsing.

_KINDS = 23


def batches(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.concat(F.lit("b"), F.floor(n / 20)).alias("batch_id"), F.col("lang").alias("domain_id"),
        F.concat(F.lit("a"), n).alias("article_id"),
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    n, kind = F.col("doc_id"), F.col("doc_id") % _KINDS
    name = F.concat(F.lit("a"), n)
    head = F.concat(F.lit("### RESULT\n\nArticle-ID: "), name, F.lit("\n"))
    end = F.lit("\n### END RESULT\n")
    reject = F.concat(head, F.lit("Status: REJECT\n"))
    ready = F.concat(head, F.lit("Status: READY_TO_PUBLISH\n\n"))
    title = F.concat(F.lit("Title:\n\n  <b>T"), n, F.lit("</b> \n\n"))
    plain = F.concat(ready, title, F.lit("Text:\n"), "text", F.lit("\n"), end)
    block = (
        F.when(kind == 0, F.concat(head, F.lit("Status: MAYBE\n"), end))
        .when(kind == 1, F.concat(ready, F.lit("Text:\nbody\n"), end))
        .when(kind == 2, F.concat(ready, title, end))
        .when(kind == 3, F.concat(ready, title, F.lit("Text: see <i>this</i> < A href='x'>link</a>\n"), end))
        .when(kind == 4, F.concat(plain, F.lit("\n"), reject, end))
        .when(kind == 5, F.concat(F.lit("### RESULT\nArticle-ID: zz"), n, F.lit("\nStatus: REJECT\n### END RESULT\n")))
        .when(kind == 6, F.lit("Nothing to say here.\n"))
        .when(kind == 7, ready)
        .when(kind == 8, F.concat(F.lit("### RESULT\nArticle-ID: bogus\nStatus: REJECT\n"), plain))
        .when(kind == 9, F.concat(F.lit("### END RESULT\n"), plain))
        .when(kind == 10, F.concat(reject, F.lit("\nReason:\n\nfirst "), n, F.lit("\n\n second \nTitle: not this\nmore\n"), end))
        .when(kind == 11, F.concat(reject, F.lit("Reason: inline "), n, F.lit("\n\nrest\n"), end))
        .when(kind == 12, F.concat(reject, end))
        .when(kind == 13, F.concat(ready, F.lit("Title:  In line "), n, F.lit("  \nText:  starts here\n"), "text", end))
        .when(kind == 14, F.concat(ready, F.lit("Title:\nText: body "), n, F.lit("\n"), end))
        .when(kind == 15, F.concat(F.lit("### RESULT\n \n### END RESULT\n"), plain))
        .when(kind == 16, F.concat(F.lit("### RESULT\nStatus: REJECT\n### END RESULT\n"), plain))
        .when(kind == 17, F.regexp_replace(plain, "\n", "\r\n"))
        .otherwise(plain)
    )
    part = table(spark, d, "documents").select(
        F.floor(n / 20).alias("no"), F.struct("doc_id", block.alias("block")).alias("b")
    )
    whole = part.groupBy("no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["block"]), "\n").alias("text")
    )
    state = F.col("no") % 17
    return whole.select(
        F.concat(F.lit("b"), "no").alias("batch_id"),
        (state != 5).alias("ok"),
        F.when(state == 5, F.lit("timed out")).alias("error_message"),
        F.when(state == 6, F.lit(" \n ")).when(state == 7, F.lit("no blocks\nhere")).when(state != 5, F.col("text"))
        .alias("output_text"),
    )


EXPECTED_CTE = f"""asked AS (
  SELECT *, doc_id % {_KINDS} AS kind, doc_id // 20 % 17 AS state, 'b' || doc_id // 20 AS batch_id,
    'a' || doc_id AS article_id FROM documents),
parsed AS (
  SELECT *, CASE
    WHEN state = 5 THEN 'request_failed' WHEN state IN (6, 7) THEN 'parse_failed' WHEN kind = 4 THEN 'duplicate'
    WHEN kind IN (0, 1, 2) THEN 'error' WHEN kind IN (5, 6, 7) THEN 'missing' WHEN kind = 3 THEN 'bad_tag'
    WHEN kind IN (10, 11, 12) THEN 'reject' ELSE 'ready' END AS outcome,
  CASE WHEN state = 5 THEN 'timed out' WHEN state = 6 THEN 'Empty LLM batch output'
    WHEN state = 7 THEN 'No RESULT blocks found in LLM batch output' WHEN kind = 4 THEN 'duplicate_article_id_in_response'
    WHEN kind = 0 THEN 'missing_status' WHEN kind = 1 THEN 'missing_title' WHEN kind = 2 THEN 'missing_text'
    WHEN kind IN (5, 6, 7) THEN 'missing_result_for_article'
    WHEN kind = 3 THEN 'Disallowed HTML tag in output: <a>' END AS message,
  CASE kind WHEN 10 THEN 'first ' || doc_id || chr(10) || ' second' WHEN 11 THEN
    'Reason: inline ' || doc_id || chr(10) || 'rest' END AS why,
  CASE kind WHEN 13 THEN 'In line ' || doc_id WHEN 14 THEN 'Text: body ' || doc_id ELSE '<b>T' || doc_id || '</b>' END
    AS headline,
  CASE kind WHEN 13 THEN 'starts here' || chr(10) || text WHEN 14 THEN 'body ' || doc_id ELSE text END AS body
  FROM asked)"""


def batch_parse(spark: SparkSession, d: str) -> DataFrame:
    """First result per id of every answer, before it is compared with what was asked."""
    parsed = parse_batch_results(answers(spark, d)).filter(F.col("article_id").isNotNull())
    return parsed.select(
        "batch_id", "article_id", "decision", "reason", "title", F.md5("text").alias("text_md5"), "error", "occurrences"
    )


BATCH_PARSE_SQL = f"""WITH {EXPECTED_CTE}
SELECT batch_id, CASE WHEN kind = 5 THEN 'zz' || doc_id ELSE article_id END AS article_id,
  CASE WHEN kind IN (5, 10, 11, 12) THEN 'REJECT' WHEN kind > 2 THEN 'READY_TO_PUBLISH' END AS decision,
  CASE WHEN kind IN (10, 11) THEN why END AS reason,
  CASE WHEN kind NOT IN (0, 1, 2, 5, 10, 11, 12) THEN headline END AS title,
  CASE WHEN kind = 3 THEN md5('see <i>this</i> < A href=''x''>link</a>')
    WHEN kind NOT IN (0, 1, 2, 5, 10, 11, 12) THEN md5(body) END AS text_md5,
  CASE WHEN kind IN (0, 1, 2) THEN message END AS error, CAST(CASE WHEN kind = 4 THEN 2 ELSE 1 END AS BIGINT) AS occurrences
FROM parsed WHERE state NOT IN (5, 6, 7) AND kind NOT IN (6, 7)
"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return match_results(batches(spark, d), answers(spark, d))


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    return batch_decisions(_matched(spark, d), domains(spark, d))


def waiting(spark: SparkSession, d: str) -> DataFrame:
    """The documents as stored articles that wait for their decision."""
    values = {
        "id": F.concat(F.lit("a"), "doc_id"),
        "domain_id": F.col("lang"),
        "source_id": F.col("source"),
        "lifecycle_state": F.lit("normalized"),
        "publication_status": F.lit("unpublished"),
        "editorial_status": F.lit("NEW"),
        "created_at": instant("2024-01-01 00:00:00"),
        "updated_at": instant("2024-01-01 00:00:00"),
        "ingest_seq": F.col("doc_id"),
    }
    return table(spark, d, "documents").select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ARTICLES.fields]
    )


def batch_apply(spark: SparkSession, d: str) -> DataFrame:
    return decided(apply_decisions(waiting(spark, d), _decisions(spark, d), instant(NOW)))


def decided(states: DataFrame) -> DataFrame:
    return states.select(
        "id", "domain_id", "editorial_status", "rejection_reason", "final_language", "final_title",
        F.md5("final_text").alias("text_md5"), "last_error_stage", "last_error_message",
        ntz("llm_processed_at").alias("llm_processed_at"), ntz("rejected_at").alias("rejected_at"),
        ntz("last_error_at").alias("last_error_at"), ntz("updated_at").alias("updated_at"),
    )


BATCH_APPLY_SQL = f"""WITH {EXPECTED_CTE}
SELECT article_id AS id, lang AS domain_id,
  CASE outcome WHEN 'ready' THEN 'READY' WHEN 'reject' THEN 'REJECTED' ELSE 'ERROR' END AS editorial_status,
  CASE WHEN outcome = 'reject' THEN why END AS rejection_reason,
  CASE WHEN outcome = 'ready' THEN CASE lang WHEN 'fr' THEN 'fr' ELSE 'ru' END END AS final_language,
  CASE WHEN outcome = 'ready' THEN headline END AS final_title, CASE WHEN outcome = 'ready' THEN md5(body) END AS text_md5,
  CASE WHEN outcome = 'request_failed' THEN 'LLM_BATCH_REQUEST' WHEN message IS NOT NULL THEN 'LLM_BATCH_PARSE' END
    AS last_error_stage,
  message AS last_error_message, CASE WHEN outcome = 'ready' THEN TIMESTAMP '{NOW}' END AS llm_processed_at,
  CASE WHEN outcome = 'reject' THEN TIMESTAMP '{NOW}' END AS rejected_at,
  CASE WHEN message IS NOT NULL THEN TIMESTAMP '{NOW}' END AS last_error_at, TIMESTAMP '{NOW}' AS updated_at
FROM parsed
"""


def decision_trail(spark: SparkSession, d: str) -> DataFrame:
    return decision_events(_decisions(spark, d), instant(NOW)).select(
        "article_id", "event_type", ntz("created_at").alias("created_at"), "error_message",
        F.get_json_object("details_json", "$.decision").alias("decision"),
        F.get_json_object("details_json", "$.explanation").alias("explanation"),
        F.get_json_object("details_json", "$.final_language").alias("final_language"),
    )


DECISION_TRAIL_SQL = f"""WITH {EXPECTED_CTE}
SELECT article_id, CASE WHEN message IS NULL THEN 'LLM_PROCESSED' ELSE 'ERROR' END AS event_type,
  TIMESTAMP '{NOW}' AS created_at, message AS error_message,
  CASE outcome WHEN 'ready' THEN 'READY_TO_PUBLISH' WHEN 'reject' THEN 'REJECT' END AS decision,
  CASE WHEN outcome = 'reject' THEN why END AS explanation,
  CASE WHEN outcome = 'ready' THEN CASE lang WHEN 'fr' THEN 'fr' ELSE 'ru' END END AS final_language
FROM parsed
"""


def batch_summary_query(spark: SparkSession, d: str) -> DataFrame:
    return batch_summary(_matched(spark, d))


BATCH_SUMMARY_SQL = f"""WITH {EXPECTED_CTE}, counted AS (
  SELECT batch_id, count(*) AS articles, count(CASE WHEN outcome IN ('ready', 'reject') THEN 1 END) AS ok_count,
    count(CASE WHEN outcome NOT IN ('ready', 'reject', 'missing') THEN 1 END) AS error_count,
    count(CASE WHEN outcome = 'missing' THEN 1 END) AS missing_count,
    count(CASE WHEN state NOT IN (5, 6, 7) AND kind = 5 THEN 1 END) AS unknown_id_count,
    count(CASE WHEN outcome = 'duplicate' THEN 1 END) AS duplicate_id_count
  FROM parsed GROUP BY batch_id)
SELECT *, error_count + duplicate_id_count AS logged_error_count FROM counted
"""


def unknown_result_ids(spark: SparkSession, d: str) -> DataFrame:
    return unknown_ids(_matched(spark, d))


UNKNOWN_IDS_SQL = f"""WITH {EXPECTED_CTE}
SELECT batch_id, 'zz' || doc_id AS article_id FROM parsed WHERE state NOT IN (5, 6, 7) AND kind = 5
"""


def single_answers(spark: SparkSession, d: str) -> DataFrame:
    n, kind = F.col("doc_id"), F.col("doc_id") % 13
    text = (
        F.when(kind == 0, F.lit(" \n"))
        .when(kind == 1, F.concat(F.lit("REJECT\n\n too small "), n, F.lit(" \nreally\n")))
        .when(kind == 2, F.lit("REJECT"))
        .when(kind == 3, F.lit("Maybe 'so'\nTitle: x"))
        .when(kind == 4, F.lit("READY_TO_PUBLISH\nText: no title first"))
        .when(kind == 5, F.lit("READY_TO_PUBLISH\n\nTitle: only\n"))
        .when(kind == 6, F.lit("READY_TO_PUBLISH\nTitle: t\nBody: wrong"))
        .when(kind == 7, F.lit("READY_TO_PUBLISH\n\n"))
        .when(kind == 8, F.concat(F.lit("READY_TO_PUBLISH\nTitle: t\nText: a <script>x</script> "), n))
        .when(kind == 9, F.concat(F.lit("READY_TO_PUBLISH\n Title:  T "), n, F.lit(" \n\n  Text:  \n"), "text"))
        .when(kind == 10, F.lit("READY_TO_PUBLISH\nTitle: t\nText:\n \n"))
        .otherwise(F.concat(F.lit("\nREADY_TO_PUBLISH\nTitle: T "), n, F.lit("\nText: lead "), n, F.lit("\n"), "text"))
    )
    return table(spark, d, "documents").select(
        F.concat(F.lit("a"), n).alias("article_id"), F.col("lang").alias("domain_id"), (n % 19 != 3).alias("ok"),
        F.when(n % 19 == 3, F.lit("timed out")).alias("error_message"),
        F.when(n % 19 != 3, text).alias("output_text"),
    )


_SINGLE_CTE = """judged AS (
  SELECT doc_id, lang, 'a' || doc_id AS article_id, doc_id % 19 <> 3 AS ok, doc_id % 13 AS kind, text,
  CASE doc_id % 13 WHEN 0 THEN 'Empty LLM output'
    WHEN 3 THEN 'Unrecognized LLM output header: "Maybe ''so''"'
    WHEN 4 THEN 'READY_TO_PUBLISH output must contain ''Title: ...'''
    WHEN 5 THEN 'READY_TO_PUBLISH output is missing text body'
    WHEN 6 THEN 'READY_TO_PUBLISH output must contain ''Text: ...'''
    WHEN 7 THEN 'READY_TO_PUBLISH output is missing title'
    WHEN 10 THEN 'READY_TO_PUBLISH output is missing text body' END AS broken,
  CASE WHEN doc_id % 13 = 1 THEN 'too small ' || doc_id || ' ' || chr(10) || 'really' END AS why,
  CASE WHEN doc_id % 13 = 8 THEN 't' ELSE 'T ' || doc_id END AS headline,
  CASE doc_id % 13 WHEN 8 THEN 'a <script>x</script> ' || doc_id WHEN 9 THEN text
    ELSE 'lead ' || doc_id || chr(10) || text END AS body
  FROM documents)"""


def single_parse(spark: SparkSession, d: str) -> DataFrame:
    return parse_single(single_answers(spark, d).filter("ok")).select(
        "article_id", "decision", "reason", "title", F.md5("text").alias("text_md5"), "error"
    )


SINGLE_PARSE_SQL = f"""WITH {_SINGLE_CTE}
SELECT article_id, CASE WHEN kind IN (1, 2) THEN 'REJECT' WHEN broken IS NULL THEN 'READY_TO_PUBLISH' END AS decision,
  why AS reason, CASE WHEN broken IS NULL AND kind NOT IN (1, 2) THEN headline END AS title,
  CASE WHEN broken IS NULL AND kind NOT IN (1, 2) THEN md5(body) END AS text_md5, broken AS error
FROM judged WHERE ok
"""


def single_apply(spark: SparkSession, d: str) -> DataFrame:
    decisions = single_decisions(single_answers(spark, d), domains(spark, d))
    done = apply_decisions(waiting(spark, d), decisions, instant(NOW), only_changed=True)
    return done.select(
        "id", "editorial_status", "rejection_reason", "final_language", "final_title",
        F.md5("final_text").alias("text_md5"), "last_error_stage", "last_error_message",
    )


SINGLE_APPLY_SQL = f"""WITH {_SINGLE_CTE}, told AS (
  SELECT *, CASE WHEN NOT ok THEN 'timed out' WHEN broken IS NOT NULL THEN broken
    WHEN kind = 8 THEN 'Disallowed HTML tag in output: <script>' END AS message FROM judged)
SELECT article_id AS id,
  CASE WHEN message IS NOT NULL THEN 'ERROR' WHEN kind IN (1, 2) THEN 'REJECTED' ELSE 'READY' END AS editorial_status,
  CASE WHEN message IS NULL THEN why END AS rejection_reason,
  CASE WHEN message IS NULL AND kind NOT IN (1, 2) THEN CASE lang WHEN 'fr' THEN 'fr' ELSE 'ru' END END AS final_language,
  CASE WHEN message IS NULL AND kind NOT IN (1, 2) THEN headline END AS final_title,
  CASE WHEN message IS NULL AND kind NOT IN (1, 2) THEN md5(body) END AS text_md5,
  CASE WHEN message IS NOT NULL THEN 'LLM' END AS last_error_stage, message AS last_error_message
FROM told
"""

QUERIES = {
    "budget_batches": (budget_batches, BUDGET_BATCHES_SQL),
    "full_batches": (full_batches, FULL_BATCHES_SQL),
    "prompt_lookup": (prompt_lookup, PROMPT_LOOKUP_SQL),
    "batch_input": (batch_input, BATCH_INPUT_SQL),
    "single_input": (single_input, SINGLE_INPUT_SQL),
    "batch_parse": (batch_parse, BATCH_PARSE_SQL),
    "batch_apply": (batch_apply, BATCH_APPLY_SQL),
    "batch_summary": (batch_summary_query, BATCH_SUMMARY_SQL),
    "decision_trail": (decision_trail, DECISION_TRAIL_SQL),
    "unknown_result_ids": (unknown_result_ids, UNKNOWN_IDS_SQL),
    "single_parse": (single_parse, SINGLE_PARSE_SQL),
    "single_apply": (single_apply, SINGLE_APPLY_SQL),
}

"""Rendering of posts and masking of secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.catalog.stored import PUBLISH_NEXT_SQL
from feedspark.catalog.views import STORED_WITH, domains, sources, stored, table
from feedspark.functions.redaction import redact
from feedspark.operators.audit import (
    post_checks,
    reject_reason_counts,
    short_texts,
    similar_in_batch,
    stamp_events,
)
from feedspark.operators.publish import eligible
from feedspark.operators.rendering import render_posts, with_footer
from feedspark.plans.publish_run import outbox


def post_render(spark: SparkSession, d: str) -> DataFrame:
    """Posts of every eligible article; English stands for the domain with a footer."""
    rows = eligible(stored(spark, d), sources(spark, d), domains(spark, d)).withColumn(
        "source_name", F.concat("source_name", F.lit(" & <co>"))
    )
    posts = render_posts(rows, footer_domains=())
    return posts.select("id", F.md5("post_text").alias("post_md5"), F.length("post_text").alias("post_chars"))


def _escaped(expression: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        expression = f"replace({expression}, '{char}', '{entity}')"
    return expression


POST_RENDER_SQL = f"""{STORED_WITH}, posts AS (
  SELECT id, CASE WHEN final_title IS NOT NULL AND final_text IS NOT NULL
    THEN final_title || chr(10) || chr(10) || final_text
    ELSE {_escaped("coalesce(final_title, canonical_url)")} || chr(10) || chr(10) ||
      {_escaped("source_name || ' & <co>'")} || chr(10) || chr(10) ||
      CASE WHEN published_at IS NULL THEN '-' WHEN published_ts IS NULL THEN published_at
        ELSE strftime(published_ts, '%Y-%m-%d %H:%M UTC') END || chr(10) || chr(10) || {_escaped("canonical_url")} END
    AS post_text FROM eligible)
SELECT id, md5(post_text) AS post_md5, CAST(length(post_text) AS INTEGER) AS post_chars FROM posts
"""


def publish_outbox(spark: SparkSession, d: str) -> DataFrame:
    """The next post, rendered and addressed."""
    posts = outbox(stored(spark, d), sources(spark, d), domains(spark, d))
    return posts.select("article_id", "channel", F.md5("post_text").alias("post_md5"))


PUBLISH_OUTBOX_SQL = f"""
SELECT n.id AS article_id, n.channel, p.post_md5 FROM ({PUBLISH_NEXT_SQL}) n
JOIN ({POST_RENDER_SQL.replace("source_name || ' & <co>'", "source_name")}) p ON p.id = n.id
"""


def _footer_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents with tag tails, promotional lines and footer labels added by number.

    A line that starts with a hash would count as tags, so those of the documents are marked.
    """
    n, kind = F.col("doc_id"), F.col("doc_id") % 9
    body = F.replace("text", F.lit("#"), F.lit("No."))
    text = (
        F.when(kind == 0, F.concat(body, F.lit("\n\n#ai\n#openai #ai\n")))
        .when(kind == 1, F.concat(body, F.lit("\n\n Подробнее в посте. Source: X\nЧитайте также\n")))
        .when(kind == 2, F.concat(body, F.lit(" #ai #new_tag\n")))
        .when(kind == 3, F.concat(body, F.lit("\n\n\n\nlast line Source: Model\nOriginal: https://m\n\n#ai\n")))
        .when(kind == 4, F.concat(body, F.lit("\n\n#AI #Big\n")))
        .when(kind == 5, F.lit(" \n"))
        .when(kind == 6, F.concat(body, F.lit("\n \t\n\n  #ai #two\n")))
        .when(kind == 7, F.concat(F.lit("#top\n"), body, F.lit("\n#x\n\n#y\n")))
        .otherwise(body)
    )
    return table(spark, d, "documents").select(
        "doc_id",
        text.alias("text"),
        F.when(n % 4 == 0, F.lit("  ")).when(n % 4 != 1, F.concat(F.lit(" Source "), "source")).alias("source_name"),
        F.when(n % 5 != 0, F.concat(F.lit("https://ex.org/"), n)).otherwise("").alias("canonical_url"),
    )


def post_footer(spark: SparkSession, d: str) -> DataFrame:
    rows = _footer_inputs(spark, d)
    done = with_footer(rows, "text", F.col("source_name"), F.col("canonical_url"), "post")
    return done.select("doc_id", F.md5("post").alias("post_md5"), F.length("post").alias("post_chars"))


POST_FOOTER_SQL = """
WITH base AS (
  SELECT doc_id, doc_id % 9 AS kind, replace(text, '#', 'No.') AS body,
    CASE WHEN doc_id % 4 IN (0, 1) THEN 'AI News' ELSE 'Source ' || source END AS src,
    CASE WHEN doc_id % 5 <> 0 THEN chr(10) || 'Original: https://ex.org/' || doc_id ELSE '' END AS original
  FROM documents),
lined AS (SELECT *, regexp_replace(CASE kind WHEN 3 THEN body || chr(10) || chr(10) || 'last line'
    WHEN 7 THEN '#top' || chr(10) || body || chr(10) || '#x' ELSE body END, '[ ]+(\\n|$)', '\\1', 'g') AS trimmed FROM base),
shaped AS (SELECT *, regexp_replace(trimmed, '\\n{3,}', chr(10) || chr(10), 'g') AS main,
  CASE kind WHEN 0 THEN '#ai #openai' WHEN 2 THEN '#ai #new_tag' WHEN 3 THEN '#ai' WHEN 6 THEN '#ai #two' WHEN 7 THEN '#y' END
    AS tags FROM lined),
posts AS (SELECT doc_id, CASE WHEN kind = 5 THEN '' ELSE main || chr(10) || chr(10) || 'Source: ' || src || original ||
  coalesce(chr(10) || chr(10) || tags, '') || chr(10) END AS post FROM shaped)
SELECT doc_id, md5(post) AS post_md5, CAST(length(post) AS INTEGER) AS post_chars FROM posts
"""

_BOT = "123456:ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"


def _with_secret(text: str) -> F.Column:
    n = F.col("doc_id") % 7
    secret = (
        F.when(n == 0, F.lit(f"POST https://api.ex.org/bot{_BOT}/sendMessage ok"))
        .when(n == 1, F.lit(f"token {_BOT} leaked"))
        .when(n == 2, F.lit("key sk-abcdefghij0123 leaked"))
        .when(n == 3, F.lit("Authorization: bearer abc.def== done"))
        .when(n == 4, F.lit("telegram_bot_token = abc,def"))
        .when(n == 5, F.lit("OPENAI_API_KEY=sk-abcdefghij0123 rest"))
        .otherwise(F.lit("nothing: sk-short 12345:ABC"))
    )
    return F.concat(F.col(text), F.lit(" "), secret, F.lit(" "), F.col(text))


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", _with_secret("text").alias("message"))
    done = redact(rows)
    return done.select("doc_id", F.md5("message").alias("message_md5"), F.length("message").alias("message_chars"))


_MASKED = """CASE doc_id % 7 WHEN 0 THEN 'POST https://api.ex.org/bot***/sendMessage ok' WHEN 1 THEN 'token *** leaked'
    WHEN 2 THEN 'key *** leaked' WHEN 3 THEN 'Authorization: Bearer ***== done' WHEN 4 THEN 'telegram_bot_token=***,def'
    WHEN 5 THEN 'OPENAI_API_KEY=*** rest' ELSE 'nothing: sk-short 12345:ABC' END"""

REDACT_TEXT_SQL = f"""
SELECT doc_id, md5(m) AS message_md5, CAST(length(m) AS INTEGER) AS message_chars
FROM (SELECT doc_id, text || ' ' || {_MASKED} || ' ' || text AS m FROM documents)
"""


def redact_nested(spark: SparkSession, d: str) -> DataFrame:
    """Secrets inside a map, an array of structs and a struct; keys and numbers stay."""
    secret = F.when(F.col("event_id") % 3 == 0, F.lit("Bearer abc.def")).otherwise(F.col("props"))
    rows = table(spark, d, "events").select(
        "event_id",
        F.create_map(F.lit("Bearer key"), secret).alias("m"),
        F.array(F.struct(secret.alias("note"), F.col("event_id").alias("n"))).alias("a"),
        F.struct(F.struct(F.array(secret).alias("deep")).alias("inner")).alias("s"),
    )
    done = redact(rows)
    return done.select(
        "event_id",
        F.get(F.map_keys("m"), 0).alias("map_key"),
        F.get(F.map_values("m"), 0).alias("map_value"),
        F.get("a", 0)["note"].alias("note"),
        F.get("a", 0)["n"].alias("n"),
        F.get("s.inner.deep", 0).alias("deep"),
    )


REDACT_NESTED_SQL = """
SELECT event_id, 'Bearer key' AS map_key, v AS map_value, v AS note, event_id AS n, v AS deep
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Bearer ***' ELSE props END AS v FROM events)
"""


def event_stamping(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("calling /botABC/"), "event_type")).otherwise(
            F.col("event_type")
        ).alias("event"),
        F.when(F.col("event_id") % 5 == 0, F.lit("prod")).alias("env"),
    )
    return stamp_events(rows, "feedspark")


EVENT_STAMPING_SQL = """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'calling /bot***/' || event_type ELSE event_type END AS event,
  CASE WHEN event_id % 5 = 0 THEN 'prod' ELSE 'local' END AS env, 'feedspark' AS service
FROM events
"""


def short_text_audit(spark: SparkSession, d: str) -> DataFrame:
    return short_texts(stored(spark, d)).select("id", "words")


SHORT_TEXT_SQL = f"""{STORED_WITH}, counted AS (
  SELECT id, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS words FROM stored)
SELECT id, CAST(words AS INTEGER) AS words FROM counted WHERE words < 10
"""


def _audited_posts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    tags = F.when(n % 4 == 0, F.lit("#ai #one")).when(n % 4 == 1, F.lit("#football #two #three #four")).when(
        n % 4 == 2, F.lit("#ai #b #c #d #e #f #g")
    ).otherwise(F.lit(""))
    return table(spark, d, "documents").select(
        "doc_id",
        F.when(n % 3 == 0, F.lit("ai")).when(n % 3 == 1, F.lit("football")).otherwise(F.lit("other")).alias("domain_id"),
        F.when(n % 5 == 0, F.lit("plain")).otherwise(F.concat(F.lit("<b>T"), n, F.lit("</b>"))).alias("final_title"),
        F.concat(
            F.when(n % 6 == 0, F.lit("<i>x</i> ")).otherwise(F.lit("")),
            F.replace("text", F.lit("#"), F.lit("No.")), F.lit("\n\n"), tags,
        ).alias("final_text"),
    )


def post_contract_audit(spark: SparkSession, d: str) -> DataFrame:
    return post_checks(_audited_posts(spark, d)).drop("final_title", "final_text")


POST_CONTRACT_SQL = """
WITH posts AS (
  SELECT doc_id, doc_id % 3 AS d, CASE doc_id % 4 WHEN 0 THEN '#ai #one' WHEN 1 THEN '#football #two #three #four'
      WHEN 2 THEN '#ai #b #c #d #e #f #g' ELSE '' END AS tags,
    CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 7 ELSE 0 END AS n,
    (CASE WHEN doc_id % 6 = 0 THEN 9 ELSE 0 END) + length(replace(text, '#', 'No.')) + 2 AS chars FROM documents)
SELECT doc_id, CASE d WHEN 0 THEN 'ai' ELSE 'football' END AS domain_id,
  chars + length(tags) <= CASE d WHEN 0 THEN 500 ELSE 800 END AS length_ok,
  CASE d WHEN 0 THEN n BETWEEN 2 AND 4 ELSE n BETWEEN 3 AND 6 END AS tag_count_ok,
  CASE d WHEN 0 THEN doc_id % 4 IN (0, 2) ELSE doc_id % 4 = 1 END AS required_tag_ok,
  doc_id % 5 <> 0 AS title_bold_ok, doc_id % 6 <> 0 AS plain_text_ok
FROM posts WHERE d <> 2
"""


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("turn") % 4
    reason = (
        F.when(n == 0, F.lit("low significance"))
        .when(n == 1, F.lit("insufficient technical details"))
        .when(n == 2, F.lit("something else"))
    )
    rejected = table(spark, d, "conversations").select(
        F.when(F.col("role") == "user", F.lit("ai")).otherwise(F.lit("football")).alias("domain_id"),
        reason.alias("rejection_reason"),
    )
    return reject_reason_counts(rejected)


REJECT_REASONS_SQL = """
WITH r AS (
  SELECT CASE WHEN role = 'user' THEN 'ai' ELSE 'football' END AS domain_id,
    CASE turn % 4 WHEN 0 THEN 'low significance' WHEN 1 THEN 'insufficient technical details' WHEN 2 THEN 'something else' END
      AS rejection_reason FROM conversations)
SELECT domain_id, rejection_reason, count(*) AS articles,
  coalesce((domain_id = 'football' AND rejection_reason = 'low significance')
    OR (domain_id = 'ai' AND rejection_reason = 'insufficient technical details'), false) AS in_vocabulary
FROM r GROUP BY domain_id, rejection_reason
"""


def batch_near_dup(spark: SparkSession, d: str) -> DataFrame:
    """Documents of one batch whose word sets overlap by half or more."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents")
    batches = docs.select(F.concat(F.lit("b"), F.floor(n / 20)).alias("batch_id"), n.alias("article_id"))
    return similar_in_batch(batches, docs.select(n.alias("article_id"), "text"), 0.5)


BATCH_NEAR_DUP_SQL = """
WITH sets AS (
  SELECT doc_id, doc_id // 20 AS b, list_distinct(list_filter(
    regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS words FROM documents),
pairs AS (
  SELECT x.b, x.doc_id AS article_id, y.doc_id AS other_id, len(list_intersect(x.words, y.words)) AS shared,
    len(x.words) + len(y.words) AS joint FROM sets x JOIN sets y ON x.b = y.b AND x.doc_id < y.doc_id)
SELECT 'b' || b AS batch_id, article_id, other_id, CAST(shared AS INTEGER) AS shared,
  CAST(joint - shared AS INTEGER) AS total FROM pairs WHERE shared * 2 >= joint - shared
"""

QUERIES = {
    "post_render": (post_render, POST_RENDER_SQL),
    "publish_outbox": (publish_outbox, PUBLISH_OUTBOX_SQL),
    "post_footer": (post_footer, POST_FOOTER_SQL),
    "redact_text": (redact_text, REDACT_TEXT_SQL),
    "redact_nested": (redact_nested, REDACT_NESTED_SQL),
    "event_stamping": (event_stamping, EVENT_STAMPING_SQL),
    "short_text_audit": (short_text_audit, SHORT_TEXT_SQL),
    "post_contract_audit": (post_contract_audit, POST_CONTRACT_SQL),
    "reject_reasons": (reject_reasons, REJECT_REASONS_SQL),
    "batch_near_dup": (batch_near_dup, BATCH_NEAR_DUP_SQL),
}

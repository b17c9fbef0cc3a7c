"""Engine tables derived from the given tables, in Spark and as SQL with the same meaning.

Every ``*_CTE`` string is a ``WITH`` member for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.functions.identity import article_id

LANGS = ("en", "fr", "de", "es")
START = "2024-01-01 00:00:00"


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def ntz(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after(base: Column, minutes: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(base) + minutes.cast("bigint") * 60_000_000)


def lang_rank(lang: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in LANGS]), lang) - 1).cast("int")


LANG_RANK_SQL = "CAST(list_position(['en','fr','de','es'], lang) - 1 AS INTEGER)"


# -- domains and sources of the documents ---------------------------------------------------------


def domains(spark: SparkSession, d: str) -> DataFrame:
    """One domain per language; Spanish is not scored and German has no channel."""
    lang = F.col("lang")
    return (
        table(spark, d, "documents")
        .select("lang")
        .distinct()
        .select(
            lang_rank(lang).alias("domain_rank"),
            lang.alias("id"),
            F.upper(lang).alias("name"),
            F.when(lang != "de", F.concat(F.lit("ch_"), lang)).alias("channel_id"),
            (lang != "es").alias("llm_enabled"),
            F.when(lang == "fr", F.lit("fr")).when(lang == "de", F.lit("")).alias("target_language"),
            F.concat(lang, F.lit("_rules.txt")).alias("prompt_file"),
        )
    )


DOMAINS_CTE = f"""domains AS (
  SELECT DISTINCT {LANG_RANK_SQL} AS domain_rank, lang AS id, upper(lang) AS name,
    CASE WHEN lang <> 'de' THEN 'ch_' || lang END AS channel_id, lang <> 'es' AS llm_enabled,
    CASE lang WHEN 'fr' THEN 'fr' WHEN 'de' THEN '' END AS target_language, lang || '_rules.txt' AS prompt_file
  FROM documents)"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Stored sources; one source of the documents is missing on purpose."""
    return (
        table(spark, d, "documents")
        .select("source")
        .distinct()
        .filter("source <> 'src13'")
        .select(F.col("source").alias("id"), F.concat(F.lit("Name of "), "source").alias("name"))
    )


SOURCES_CTE = """sources AS (
  SELECT DISTINCT source AS id, 'Name of ' || source AS name FROM documents WHERE source <> 'src13')"""


def ranked_sources(spark: SparkSession, d: str) -> DataFrame:
    """One configured source per (language, source name) with its ingest rank."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return (
        table(spark, d, "documents")
        .select("lang", "source")
        .distinct()
        .select(
            F.col("lang").alias("domain_id"),
            lang_rank(F.col("lang")).alias("domain_rank"),
            number.alias("source_rank"),
            F.concat_ws(".", "lang", "source").alias("id"),
        )
    )


# -- normalized articles on their way in ----------------------------------------------------------


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """The documents as normalized articles: exact copies share their url."""
    url = F.concat(F.lit("https://ex.org/"), F.md5("text"))
    return table(spark, d, "documents").select(
        article_id(F.col("lang"), url).alias("id"),
        F.col("lang").alias("domain_id"),
        F.concat_ws(".", "lang", "source").alias("source_id"),
        url.alias("canonical_url"),
        F.concat(F.lit("x"), "doc_id").alias("source_item_external_id"),
        F.concat(F.lit("Title "), "doc_id").alias("title"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("published_at"),
        lang_rank(F.col("lang")).alias("domain_rank"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("source_rank"),
        F.lit("r").alias("run_id"),
        F.lit(0).cast("bigint").alias("sort_key"),
        F.col("doc_id").alias("pos"),
    )


INCOMING_CTE = f"""incoming AS (
  SELECT sha256(lang || '|' || 'https://ex.org/' || md5(text)) AS id, lang AS domain_id,
    lang || '.' || source AS source_id, 'https://ex.org/' || md5(text) AS canonical_url,
    'x' || doc_id AS source_item_external_id, 'Title ' || doc_id AS title, text AS content,
    {LANG_RANK_SQL} AS domain_rank,
    CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS source_rank, doc_id AS pos
  FROM documents)"""


# -- stored articles in every state ---------------------------------------------------------------


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The documents as stored articles; state follows the labels and the document number."""
    n = F.col("doc_id")
    url = F.concat(F.lit("https://ex.org/d/"), n)
    created = minutes_after(instant(START), n)
    published_state = n % 13 == 0
    status = (
        F.when(published_state, F.lit("PUBLISHED"))
        .when(n % 11 == 0, F.lit(None))
        .when(F.col("quality") == 1, F.lit("READY"))
        .when(F.col("quality") == 0, F.lit("REJECTED"))
        .otherwise(F.lit("NEW"))
    )
    delivered = published_state | (n % 97 == 5)
    decided = (F.col("quality") == 1) & (n % 29 != 3)
    documents = table(spark, d, "documents").join(
        table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left"
    )
    null = F.lit(None).cast("string")
    return documents.select(
        article_id(F.col("lang"), url).alias("id"),
        F.col("lang").alias("domain_id"),
        F.col("source").alias("source_id"),
        url.alias("canonical_url"),
        F.concat(F.lit("x"), n).alias("source_item_external_id"),
        F.when(n % 10 == 4, F.lit("  ")).when(n % 10 != 9, F.concat(F.lit("Title "), n)).alias("title"),
        F.col("text").alias("content"),
        F.when(n % 9 == 8, F.lit("soon"))
        .when(n % 9 != 7, F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("published_at"),
        F.when(published_state, F.lit("published")).otherwise(F.lit("normalized")).alias("lifecycle_state"),
        null.alias("raw_json"),
        null.alias("normalized_json"),
        null.alias("rewritten_json"),
        F.when(published_state, F.lit("published"))
        .when(n % 7 == 0, F.lit("failed"))
        .when(n % 5 != 0, F.lit("unpublished"))
        .alias("publication_status"),
        null.alias("publication_error"),
        F.when(delivered, n + 1000).alias("telegram_message_id"),
        F.when(delivered, F.concat(F.lit("ch_"), "lang")).alias("telegram_channel"),
        F.when(published_state, created).alias("telegram_published_at"),
        status.alias("editorial_status"),
        created.alias("status_updated_at"),
        null.alias("rejection_reason"),
        F.lit(None).cast("timestamp").alias("rejected_at"),
        F.when(decided, minutes_after(created, (n * 37) % 1440)).alias("llm_processed_at"),
        null.alias("final_language"),
        F.when(decided & (n % 8 != 0), F.concat(F.lit("<b>Post "), n, F.lit("</b>"))).alias("final_title"),
        F.when(decided, F.col("text")).alias("final_text"),
        null.alias("last_error_stage"),
        null.alias("last_error_message"),
        F.lit(None).cast("timestamp").alias("last_error_at"),
        created.alias("created_at"),
        created.alias("updated_at"),
        n.alias("ingest_seq"),
    )


STORED_CTE = """stored AS (
  SELECT sha256(d.lang || '|' || 'https://ex.org/d/' || d.doc_id) AS id, d.lang AS domain_id,
    d.source AS source_id, 'https://ex.org/d/' || d.doc_id AS canonical_url,
    'x' || d.doc_id AS source_item_external_id,
    CASE WHEN d.doc_id % 10 = 4 THEN '  ' WHEN d.doc_id % 10 <> 9 THEN 'Title ' || d.doc_id END AS title,
    d.text AS content,
    CASE WHEN d.doc_id % 9 = 8 THEN 'soon' WHEN d.doc_id % 9 <> 7 THEN
      strftime(TIMESTAMP '2024-01-01' + to_minutes(d.doc_id), '%Y-%m-%dT%H:%M:%SZ') END AS published_at,
    CASE WHEN d.doc_id % 9 NOT IN (7, 8) THEN TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) END AS published_ts,
    CASE WHEN d.doc_id % 13 = 0 THEN 'published' ELSE 'normalized' END AS lifecycle_state,
    CASE WHEN d.doc_id % 13 = 0 THEN 'published' WHEN d.doc_id % 7 = 0 THEN 'failed'
      WHEN d.doc_id % 5 <> 0 THEN 'unpublished' END AS publication_status,
    CASE WHEN d.doc_id % 13 = 0 OR d.doc_id % 97 = 5 THEN d.doc_id + 1000 END AS telegram_message_id,
    CASE WHEN d.doc_id % 13 = 0 THEN TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) END AS telegram_published_at,
    CASE WHEN d.doc_id % 13 = 0 THEN 'PUBLISHED' WHEN d.doc_id % 11 = 0 THEN NULL
      WHEN l.quality = 1 THEN 'READY' WHEN l.quality = 0 THEN 'REJECTED' ELSE 'NEW' END AS editorial_status,
    CASE WHEN l.quality = 1 AND d.doc_id % 29 <> 3 THEN
      TIMESTAMP '2024-01-01' + to_minutes(d.doc_id + (d.doc_id * 37) % 1440) END AS llm_processed_at,
    CASE WHEN l.quality = 1 AND d.doc_id % 29 <> 3 AND d.doc_id % 8 <> 0
      THEN '<b>Post ' || d.doc_id || '</b>' END AS final_title,
    CASE WHEN l.quality = 1 AND d.doc_id % 29 <> 3 THEN d.text END AS final_text,
    TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at, d.doc_id AS ingest_seq
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

CANDIDATES_CTE = """candidates AS (
  SELECT s.*, src.name AS source_name FROM stored s JOIN sources src ON src.id = s.source_id
  WHERE s.editorial_status IS NULL OR s.editorial_status = 'NEW')"""

ELIGIBLE_CTE = """eligible AS (
  SELECT s.*, src.name AS source_name, d.channel_id AS channel
  FROM stored s JOIN sources src ON src.id = s.source_id JOIN domains d ON d.id = s.domain_id
  WHERE d.channel_id IS NOT NULL AND s.editorial_status = 'READY'
    AND (s.publication_status IS NULL OR s.publication_status IN ('unpublished', 'failed'))
    AND s.telegram_message_id IS NULL AND s.telegram_published_at IS NULL)"""

STORED_WITH = f"WITH {STORED_CTE}, {SOURCES_CTE}, {DOMAINS_CTE}, {CANDIDATES_CTE}, {ELIGIBLE_CTE}"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A recorded delivery outcome for every document."""
    n = F.col("doc_id")
    kind = (
        F.when(n % 6 == 1, F.lit("ConnectTimeout")).when(n % 6 == 3, F.lit("RuntimeError"))
    )
    return table(spark, d, "documents").select(
        article_id(F.col("lang"), F.concat(F.lit("https://ex.org/d/"), n)).alias("article_id"),
        kind.isNull().alias("ok"),
        F.when(kind.isNull(), n + 5000).alias("message_id"),
        F.lit(None).cast("string").alias("channel"),
        kind.alias("error_type"),
        F.when(kind.isNotNull(), F.concat(F.lit("failed at "), n)).alias("error_message"),
        instant("2024-02-01 00:00:00").alias("attempted_at"),
    )


OUTCOMES_CTE = """outcomes AS (
  SELECT sha256(lang || '|' || 'https://ex.org/d/' || doc_id) AS article_id, doc_id % 6 NOT IN (1, 3) AS ok,
    CASE WHEN doc_id % 6 NOT IN (1, 3) THEN doc_id + 5000 END AS message_id,
    CASE doc_id % 6 WHEN 1 THEN 'ConnectTimeout' WHEN 3 THEN 'RuntimeError' END AS error_type,
    CASE WHEN doc_id % 6 IN (1, 3) THEN 'failed at ' || doc_id END AS error_message
  FROM documents)"""

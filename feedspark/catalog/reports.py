"""The run report over the ingest and usage totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.catalog.feeds import INGEST_SUMMARY_SQL
from feedspark.catalog.stored import PUBLISH_STATS_SQL, publish_stats_query
from feedspark.catalog.usage import USAGE_TOTALS_SQL, usage_totals
from feedspark.catalog.views import incoming, ranked_sources
from feedspark.operators.ingest import insert_new, run_summary, source_summary
from feedspark.operators.report import ingest_report, usage_report


def _summary(spark: SparkSession, d: str) -> DataFrame:
    articles = incoming(spark, d)
    new = insert_new(articles, articles.filter(F.col("pos") % 5 == 0))
    sources = ranked_sources(spark, d)
    failed = sources.filter(F.col("source_rank") % 9 == 4).select(F.col("id").alias("source_id"))
    return run_summary(source_summary(articles, new, failed, sources))


def run_report(spark: SparkSession, d: str) -> DataFrame:
    return ingest_report(_summary(spark, d), publish_stats_query(spark, d)).unionByName(
        usage_report(usage_totals(spark, d))
    )


_FAILED_IDS = """(SELECT string_agg(lang || '.' || source, ', ' ORDER BY list_position(['en','fr','de','es'], lang), n) FROM (
    SELECT DISTINCT lang, source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS n FROM documents)
  WHERE n % 9 = 4)"""

RUN_REPORT_SQL = f"""
WITH rolled AS ({INGEST_SUMMARY_SQL}), total AS (SELECT * FROM rolled WHERE domain_id IS NULL),
stats AS ({PUBLISH_STATS_SQL}), u AS ({USAGE_TOTALS_SQL}),
report AS (
  SELECT 'ingest' AS section, unnest([1, 2, 3, 4, 5, 6]) AS line,
    unnest(['Sources processed', 'Failed sources', 'Failed source ids', 'Fetched articles', 'Inserted articles',
      'Duplicate articles']) AS label,
    unnest([CAST((SELECT count(*) FROM rolled WHERE source_id IS NOT NULL) AS VARCHAR), CAST(failed_sources AS VARCHAR),
      {_FAILED_IDS}, CAST(fetched_articles AS VARCHAR), CAST(inserted_articles AS VARCHAR),
      CAST(duplicate_articles AS VARCHAR)]) AS value FROM total
  UNION ALL
  SELECT 'ingest', unnest([7, 8, 9]), unnest(['Skipped old', 'Published', 'Publish failures']),
    unnest([CAST(skipped_old_articles AS VARCHAR), CAST(published_articles AS VARCHAR),
      CAST(publication_failures AS VARCHAR)]) FROM stats
  UNION ALL
  SELECT 'usage', unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]),
    unnest(['Model', 'Requests attempted', 'Successful requests', 'Failed requests', 'Articles attempted',
      'Articles processed', 'Input tokens', 'Output tokens', 'Total tokens', 'Completed responses',
      'Incomplete responses', 'Total cost USD', 'Total cost cents', 'Average cost/article']),
    unnest([model, CAST(attempted_request_count AS VARCHAR), CAST(successful_request_count AS VARCHAR),
      CAST(failed_request_count AS VARCHAR), CAST(attempted_article_count AS VARCHAR), CAST(article_count AS VARCHAR),
      CAST(input_tokens AS VARCHAR), CAST(output_tokens AS VARCHAR), CAST(total_tokens AS VARCHAR),
      CAST(completed_response_count AS VARCHAR), CAST(incomplete_response_count AS VARCHAR), '$' || total_cost_usd,
      CAST(total_cost_cents AS VARCHAR), '$' || average_cost_per_article_usd]) FROM u)
SELECT section, CAST(line AS INTEGER) AS line, label, value FROM report
"""

QUERIES = {"run_report": (run_report, RUN_REPORT_SQL)}

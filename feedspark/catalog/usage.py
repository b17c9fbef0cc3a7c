"""Recorded scorer answers, prices and cost totals."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedspark.catalog.views import table
from feedspark.operators.usage import match_pricing, price_usage, summarize_usage, usage_by_batch
from feedspark.sources.responses import parse_api_errors, parse_responses

# Keys of growing length, one that is a prefix of another without a dash, and one that no request uses.
_KEYS = ("larch", "larch-short", "larch-short-fast", "larches", "unused")
_PRICES = tuple((key, f"{n + 1}.{n}5", f"{7 * n + 3}.5") for n, key in enumerate(_KEYS))
_PRICES_CTE = "prices(model_key, input_price, output_price) AS (VALUES " + ", ".join(
    f"('{key}', CAST({a} AS DECIMAL(18,6)), CAST({b} AS DECIMAL(18,6)))" for key, a, b in _PRICES
) + ")"

# Model of an order by its priority: a key, a version of it, a version of the longest key, a neighbour, no key.
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_MODELS = dict(zip(_PRIORITIES, (_KEYS[0], f"{_KEYS[0]}-v7", f"{_KEYS[2]}-v7", _KEYS[3], f"{_KEYS[0]}x"), strict=True))
_MODEL_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MODELS.items()) + " END"


def pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(key, Decimal(a), Decimal(b)) for key, a, b in _PRICES],
        "model_key string, input_price decimal(18,6), output_price decimal(18,6)",
    )


def order_responses(spark: SparkSession, d: str) -> DataFrame:
    """One recorded request per order."""
    model = F.create_map(*[F.lit(x) for pair in _MODELS.items() for x in pair])[F.col("o_orderpriority")]
    tokens_in = F.floor("o_totalprice").cast("bigint")
    tokens_out = F.col("o_custkey")
    return table(spark, d, "orders").select(
        F.concat(F.lit("b"), "o_orderkey").alias("batch_id"),
        F.lit(_KEYS[0]).alias("requested_model"),
        model.alias("model"),
        F.when(F.col("o_orderstatus") == "F", F.lit("completed")).when(
            F.col("o_orderstatus") == "O", F.lit("incomplete")
        ).alias("status"),
        (F.col("o_orderkey") % 20 + 1).cast("int").alias("articles"),
        (F.col("o_orderkey") % 17 != 5).alias("ok"),
        F.when(F.col("o_orderkey") % 31 == 0, F.lit(0)).otherwise(tokens_in).cast("bigint").alias("input_tokens"),
        tokens_out.alias("output_tokens"),
        F.when(F.col("o_orderkey") % 31 == 0, F.lit(0)).otherwise(tokens_in + tokens_out).cast("bigint").alias(
            "total_tokens"
        ),
        (tokens_in % 100).alias("cached_tokens"),
        (tokens_out % 10).alias("reasoning_tokens"),
    )


RESPONSES_CTE = f"""{_PRICES_CTE}, responses AS (
  SELECT 'b' || o_orderkey AS batch_id, '{_KEYS[0]}' AS requested_model, {_MODEL_SQL} AS model,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'incomplete' END AS status,
    o_orderkey % 20 + 1 AS articles, o_orderkey % 17 <> 5 AS ok,
    CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS input_tokens,
    o_custkey AS output_tokens,
    CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) + o_custkey END AS total_tokens,
    CAST(floor(o_totalprice) AS BIGINT) % 100 AS cached_tokens, o_custkey % 10 AS reasoning_tokens FROM orders),
keyed AS (
  SELECT r.*, (SELECT p.model_key FROM prices p WHERE r.model = p.model_key OR starts_with(r.model, p.model_key || '-')
    ORDER BY length(p.model_key) DESC LIMIT 1) AS model_key FROM responses r),
priced AS (
  SELECT k.*, CASE WHEN ok AND k.model_key IS NOT NULL AND input_tokens > 0
      THEN CAST(input_tokens AS DECIMAL(19,0)) * CAST(input_price * 0.000001 AS DECIMAL(18,12)) ELSE 0 END AS cost_in,
    CASE WHEN ok AND k.model_key IS NOT NULL AND output_tokens > 0
      THEN CAST(output_tokens AS DECIMAL(19,0)) * CAST(output_price * 0.000001 AS DECIMAL(18,12)) ELSE 0 END AS cost_out
  FROM keyed k LEFT JOIN prices p ON p.model_key = k.model_key)"""


def pricing_match(spark: SparkSession, d: str) -> DataFrame:
    responses = order_responses(spark, d)
    matched = responses.select("batch_id", "model").join(match_pricing(responses, pricing(spark)), "model", "left")
    return matched.select("batch_id", "model", "model_key", "input_price", "output_price")


PRICING_MATCH_SQL = f"""WITH {RESPONSES_CTE}
SELECT batch_id, model, k.model_key, input_price, output_price
FROM keyed k LEFT JOIN prices p ON p.model_key = k.model_key
"""


def usage_by_batch_query(spark: SparkSession, d: str) -> DataFrame:
    return usage_by_batch(price_usage(order_responses(spark, d), pricing(spark)))


def _usd(expression: str) -> str:
    return f"CAST(CAST(round({expression}, 6) AS DECIMAL(38,6)) AS VARCHAR)"


USAGE_BY_BATCH_SQL = f"""WITH {RESPONSES_CTE}
SELECT batch_id, model, model_key, status, input_tokens, output_tokens, total_tokens, cached_tokens, reasoning_tokens,
  {_usd('cost_in')} AS input_cost_usd, {_usd('cost_out')} AS output_cost_usd,
  {_usd('cost_in + cost_out')} AS total_cost_usd, total_tokens = 0 AS usage_missing, model_key IS NULL AS pricing_missing
FROM priced WHERE ok
"""


def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return summarize_usage(price_usage(order_responses(spark, d), pricing(spark)))


USAGE_TOTALS_SQL = f"""WITH {RESPONSES_CTE}, t AS (
  SELECT count(*) AS n, count(CASE WHEN ok THEN 1 END) AS good, sum(articles) AS asked,
    sum(CASE WHEN ok THEN articles END) AS answered, sum(cost_in) AS a, sum(cost_out) AS b,
    count(CASE WHEN ok AND status = 'completed' THEN 1 END) AS completed,
    count(CASE WHEN ok AND status = 'incomplete' THEN 1 END) AS incomplete,
    {', '.join(f'sum(CASE WHEN ok THEN {c}_tokens END) AS {c}' for c in ('input', 'output', 'total', 'cached', 'reasoning'))}
  FROM priced)
SELECT 'multiple' AS model, n AS attempted_request_count, good AS successful_request_count,
  n - good AS failed_request_count, CAST(asked AS BIGINT) AS attempted_article_count,
  CAST(answered AS BIGINT) AS article_count, completed AS completed_response_count,
  incomplete AS incomplete_response_count,
  {', '.join(f'CAST({c} AS BIGINT) AS {c}_tokens' for c in ('input', 'output', 'total', 'cached', 'reasoning'))},
  {_usd('a')} AS input_cost_usd, {_usd('b')} AS output_cost_usd, {_usd('a + b')} AS total_cost_usd,
  CAST(round((a + b) * 100, 0) AS BIGINT) AS total_cost_cents,
  (CAST(round((a + b) * 1000000) AS HUGEINT) * 2 + answered) // (answered * 2) // 1000000 || '.' || lpad(CAST(
    (CAST(round((a + b) * 1000000) AS HUGEINT) * 2 + answered) // (answered * 2) % 1000000 AS VARCHAR), 6, '0')
    AS average_cost_per_article_usd
FROM t
"""


def _odd_members(body: Column, n: Column) -> Column:
    """In some answers members that are no objects stand before the message."""
    marked = F.regexp_replace(body, r'"output":\[', '"output":["x",7,null,[1],')
    return F.when(n % 8 == 3, marked).otherwise(body)


def response_parse(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as recorded JSON answers, with gaps in several places."""
    n = F.col("conv_id") * 100 + F.col("turn")
    message = F.struct(
        F.lit("message").alias("type"),
        F.col("role"),
        F.array(
            F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text")),
            F.struct(F.lit("refusal").alias("type"), F.lit("no").alias("text")),
            F.struct(F.lit("output_text").alias("type"), F.when(n % 5 == 0, F.lit("tail")).otherwise("").alias("text")),
        ).alias("content"),
    )
    other = F.struct(
        F.lit("reasoning").alias("type"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("array<struct<type:string,text:string>>").alias("content"),
    )
    usage = F.struct(
        (n * 3).alias("input_tokens"),
        (n * 2).alias("output_tokens"),
        F.when(n % 4 == 0, n * 7).alias("total_tokens"),
        F.when(n % 3 == 0, F.struct((n % 11).alias("cached_tokens"))).alias("input_tokens_details"),
        F.when(n % 3 == 1, F.struct((n % 13).alias("reasoning_tokens"))).alias("output_tokens_details"),
    )
    body = F.struct(
        F.when(n % 7 == 0, F.lit(" ")).when(n % 7 != 1, F.lit("m-5")).alias("model"),
        F.when(n % 6 != 0, F.lit("completed")).alias("status"),
        F.when(n % 9 == 0, F.struct(F.lit("max_output_tokens").alias("reason"))).alias("incomplete_details"),
        F.array(other, message).alias("output"),
        F.when(n % 10 != 3, usage).alias("usage"),
    )
    landed = table(spark, d, "conversations").select(
        "conv_id", "turn", F.lit("asked").alias("requested_model"), _odd_members(F.to_json(body), n).alias("body")
    )
    return parse_responses(landed).withColumn("output_text", F.md5("output_text")).drop("requested_model")


RESPONSE_PARSE_SQL = """
WITH c AS (SELECT *, conv_id * 100 + turn AS n FROM conversations),
t AS (SELECT *, CASE WHEN role = 'assistant' THEN nullif(trim(text || CASE WHEN n % 5 = 0 THEN chr(10) || 'tail' ELSE '' END,
  ' ' || chr(9) || chr(10) || chr(13)), '') END AS answer, n % 10 <> 3 AS counted FROM c)
SELECT conv_id, turn, md5(answer) AS output_text, CASE WHEN n % 7 IN (0, 1) THEN 'asked' ELSE 'm-5' END AS model,
  CASE WHEN n % 6 <> 0 THEN 'completed' END AS status, CASE WHEN n % 9 = 0 THEN 'max_output_tokens' END AS incomplete_reason,
  CASE WHEN counted THEN n * 3 ELSE 0 END AS input_tokens, CASE WHEN counted THEN n * 2 ELSE 0 END AS output_tokens,
  CASE WHEN NOT counted THEN 0 WHEN n % 4 = 0 THEN n * 7 ELSE n * 5 END AS total_tokens,
  CASE WHEN counted AND n % 3 = 0 THEN n % 11 ELSE 0 END AS cached_tokens,
  CASE WHEN counted AND n % 3 = 1 THEN n % 13 ELSE 0 END AS reasoning_tokens, answer IS NOT NULL AS ok,
  CASE WHEN answer IS NULL THEN 'Responses API returned no output_text' END AS error_message
FROM t
"""


def api_error_parse(spark: SparkSession, d: str) -> DataFrame:
    """Events as error bodies: proper, with wrong types, without an error, and broken."""
    n, kind = F.col("event_id"), F.col("event_id") % 6
    body = (
        F.when(kind == 0, F.concat(F.lit('{"error":{"type":"'), "event_type", F.lit('","code":"c'), n, F.lit('","message":"m'), n, F.lit('"}}')))
        .when(kind == 1, F.concat(F.lit('{"error":{"type":7,"code":'), n, F.lit(',"message":null}}')))
        .when(kind == 2, F.lit('{"error":"text"}'))
        .when(kind == 3, F.lit('[1,2]'))
        .when(kind == 4, F.lit('{"error":{"type":"x"'))
        .otherwise(F.concat(F.lit('{"error":{"code":{"a":1},"message":"'), "event_type", F.lit('"}}')))
    )
    return parse_api_errors(table(spark, d, "events").select("event_id", body.alias("body")))


API_ERROR_SQL = """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN event_type END AS error_type,
  CASE event_id % 6 WHEN 0 THEN 'c' || event_id WHEN 1 THEN CAST(event_id AS VARCHAR) END AS error_code,
  CASE event_id % 6 WHEN 0 THEN 'm' || event_id WHEN 5 THEN event_type END AS error_message
FROM events
"""

QUERIES = {
    "pricing_match": (pricing_match, PRICING_MATCH_SQL),
    "usage_by_batch": (usage_by_batch_query, USAGE_BY_BATCH_SQL),
    "usage_totals": (usage_totals, USAGE_TOTALS_SQL),
    "response_parse": (response_parse, RESPONSE_PARSE_SQL),
    "api_error_parse": (api_error_parse, API_ERROR_SQL),
}

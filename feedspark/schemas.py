"""Table schemas shared by scans, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "decimal(18,6)": T.DecimalType(18, 6),
    "array<int>": T.ArrayType(T.IntegerType()),
    "array<struct<value:string>>": T.ArrayType(T.StructType().add("value", T.StringType())),
    "array<struct<term:string>>": T.ArrayType(T.StructType().add("term", T.StringType())),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def schema(columns: str) -> T.StructType:
    """``name type, name type`` as a struct; unlike the DDL parser this needs no session."""
    pairs = [column.split(" ", 1) for column in columns.split(", ")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Lifecycle values of an article, its editorial decision and its delivery.
LIFECYCLE_STATES = ("raw", "normalized", "rewritten", "published")
EDITORIAL_STATUSES = ("NEW", "REJECTED", "READY", "PUBLISHED", "ERROR")
PUBLICATION_STATUSES = ("unpublished", "published", "failed", "skipped_old")
EVENT_TYPES = ("INGESTED", "LLM_PROCESSED", "PUBLISHED", "ERROR")

ENTRY_FIELDS = (
    "link string, title string, id string, guid string, published string, published_parsed array<int>, "
    "updated string, updated_parsed array<int>, summary string, description string, "
    "content array<struct<value:string>>, author string, tags array<struct<term:string>>"
)
ENTRIES = schema(f"source_id string, run_id string, pos bigint, {ENTRY_FIELDS}")

DOMAINS = schema(
    "domain_rank int, id string, name string, channel_id string, llm_enabled boolean, "
    "target_language string, prompt_file string"
)
SOURCE_CONFIG = schema(
    "domain_id string, domain_rank int, source_rank int, id string, type string, name string, url string, "
    "enabled boolean, config map<string,string>"
)
SOURCES = schema(
    "id string, domain_id string, type string, name string, url string, enabled boolean, "
    "config map<string,string>, last_fetch_at timestamp, last_success_at timestamp, last_error_at timestamp, "
    "consecutive_error_count bigint, total_error_count bigint, last_http_status int, last_error_message string, "
    "last_item_external_id string, last_item_published_at string, created_at timestamp, updated_at timestamp"
)
FETCH_ATTEMPTS = schema(
    "source_id string, run_id string, attempt int, http_status int, error_type string, error_message string, "
    "body string"
)
FETCH_LOG = schema(
    "source_id string, at timestamp, run_id string, seq bigint, ok boolean, http_status int, error_message string, "
    "last_item_external_id string, last_item_published_at string"
)
QUARANTINE = schema("source_id string, run_id string, pos bigint, id string, defect string")
WARNINGS = schema("source_id string, run_id string, event string, lost bigint")
ARTICLES = schema(
    "id string, domain_id string, source_id string, canonical_url string, source_item_external_id string, "
    "title string, content string, published_at string, lifecycle_state string, raw_json string, "
    "normalized_json string, rewritten_json string, publication_status string, publication_error string, "
    "telegram_message_id bigint, telegram_channel string, telegram_published_at timestamp, "
    "editorial_status string, status_updated_at timestamp, rejection_reason string, rejected_at timestamp, "
    "llm_processed_at timestamp, final_language string, final_title string, final_text string, "
    "last_error_stage string, last_error_message string, last_error_at timestamp, created_at timestamp, "
    "updated_at timestamp, ingest_seq bigint"
)
# The bulky columns of an article, which no later step changes.  Everything else is its state.
CONTENT = ("title", "content", "raw_json", "normalized_json", "rewritten_json")
STATES = T.StructType([f for f in ARTICLES.fields if f.name not in CONTENT])
EVENTS = schema(
    "seq bigint, article_id string, event_type string, created_at timestamp, details_json string, "
    "error_message string"
)
PRICING = schema("model_key string, input_price decimal(18,6), output_price decimal(18,6)")
RESPONSES = schema(
    "batch_id string, domain_id string, requested_model string, articles int, ok boolean, error_message string, "
    "output_text string, model string, status string, incomplete_reason string, input_tokens bigint, "
    "output_tokens bigint, total_tokens bigint, cached_tokens bigint, reasoning_tokens bigint"
)
OUTCOMES = schema(
    "article_id string, ok boolean, message_id bigint, channel string, error_type string, error_message string, "
    "attempted_at timestamp"
)

"""Free-text answers to per-article decisions.

Everything up to the per-id reconciliation is array work inside one row: a response is split into
lines, marker lines give the blocks, and each block is read by position.  No shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.text import WS, blank_to_null, empty_to_null, is_blank, lines_of, quoted, ultrim, utrim

# The answer format.
START, END = "### RESULT", "### END RESULT"
_ID = rf"(?U)^Article-ID:{WS}*([A-Za-z0-9_\-]+){WS}*$"
_STATUS = rf"(?U)^Status:{WS}*(REJECT|READY_TO_PUBLISH){WS}*$"
_TITLE_LINE = rf"(?sU)^Title:{WS}*(.+?){WS}*$"
_TEXT_LINE = rf"(?sU)^Text:{WS}*(.*)$"
_TAG = r"(?U)<\s*/?\s*([a-zA-Z0-9]+)[^>]*>"
ALLOWED_TAGS = ("b", "i", "u")

# Messages of failed answers.
EMPTY_BATCH = "Empty LLM batch output"
NO_BLOCKS = "No RESULT blocks found in LLM batch output"
EMPTY_SINGLE = "Empty LLM output"
NO_TITLE_LINE = "READY_TO_PUBLISH output must contain 'Title: ...'"
NO_TEXT_LINE = "READY_TO_PUBLISH output must contain 'Text: ...'"
NO_TITLE = "READY_TO_PUBLISH output is missing title"
NO_BODY = "READY_TO_PUBLISH output is missing text body"
# Stands for the message of a failed request that recorded none.
NO_ANSWER = "No answer recorded"


def _position(lines: Column, test) -> Column:
    """1-based index of the first line that passes; 0 if none does."""
    return F.array_position(F.transform(lines, test), True).cast("int")


def _from(lines: Column, start: Column) -> Column:
    """Lines from a 1-based index to the end."""
    return F.slice(lines, start, F.greatest(F.size(lines) - start + 1, F.lit(0)))


def _joined(lines: Column) -> Column:
    return utrim(F.array_join(lines, "\n"))


def _drop_blank(lines: Column) -> Column:
    return F.filter(lines, lambda x: ~is_blank(x))


def extract_blocks(responses: DataFrame) -> DataFrame:
    """Add ``blocks``: text between a start marker and the next marker, if that is an end marker.

    So a second start discards the open block, a stray end is ignored, an unterminated block is
    dropped, and blank blocks vanish.
    """
    lined = responses.withColumn("_lines", lines_of(utrim(F.coalesce("output_text", F.lit("")))))
    marks = F.filter(
        F.transform("_lines", lambda x, i: F.struct(i.alias("i"), utrim(x).alias("t"))),
        lambda m: m["t"].isin(START, END),
    )
    marked = lined.withColumn("_marks", marks)
    pairs = F.zip_with(
        F.col("_marks"),
        F.slice("_marks", 2, F.size("_marks")),
        lambda a, b: F.when(
            (a["t"] == START) & (b["t"] == END), F.struct(a["i"].alias("start"), b["i"].alias("end"))
        ),
    )
    paired = marked.withColumn("_pairs", F.filter(pairs, lambda p: p.isNotNull()))
    texts = F.transform(
        "_pairs", lambda p: _joined(F.slice(F.col("_lines"), p["start"] + 2, p["end"] - p["start"] - 1))
    )
    return paired.withColumn("blocks", F.filter(texts, lambda b: b != "")).drop("_lines", "_marks", "_pairs")


def batch_failure() -> Column:
    """Reason a whole answer is unusable, from ``output_text`` and ``blocks``."""
    return F.when(is_blank(F.coalesce("output_text", F.lit(""))), F.lit(EMPTY_BATCH)).when(
        F.size("blocks") == 0, F.lit(NO_BLOCKS)
    )


def _headers(blocks: DataFrame) -> DataFrame:
    lines = blocks.withColumn("_lines", lines_of(F.col("block")))
    trimmed = lines.withColumn("_trim", F.transform("_lines", utrim))

    def first_match(pattern: str) -> Column:
        hit = F.get(F.filter("_trim", lambda x: F.rlike(x, F.lit(pattern))), 0)
        return F.regexp_extract(hit, pattern, 1)

    return trimmed.withColumns({"article_id": first_match(_ID), "status": first_match(_STATUS)})


def _reason() -> Column:
    lines, trimmed = F.col("_lines"), F.col("_trim")
    at = _position(trimmed, lambda x: x == "Reason:")
    section = _from(lines, at + 1)
    stop = _position(section, lambda x: F.startswith(utrim(x), F.lit("Title:")) | F.startswith(utrim(x), F.lit("Text:")))
    reason = F.slice(section, 1, F.when(stop > 0, stop - 1).otherwise(F.size(section)))
    status_at = _position(trimmed, lambda x: F.startswith(x, F.lit("Status:")))
    trailing = _from(lines, status_at + 1)
    return blank_to_null(F.array_join(_drop_blank(F.when(at > 0, reason).otherwise(trailing)), "\n"))


def _title() -> Column:
    trimmed = F.col("_trim")
    at = _position(trimmed, lambda x: F.startswith(x, F.lit("Title:")))
    inline = utrim(F.substring(F.get(trimmed, at - 1), F.lit(7), F.length(F.get(trimmed, at - 1))))
    following = F.get(F.filter(_from(trimmed, at + 1), lambda x: x != ""), 0)
    return F.when(at > 0, F.coalesce(F.nullif(inline, F.lit("")), following))


def _text() -> Column:
    lines, trimmed = F.col("_lines"), F.col("_trim")
    at = _position(trimmed, lambda x: F.startswith(x, F.lit("Text:")))
    line = ultrim(F.get(lines, at - 1))
    inline = ultrim(F.substring(line, F.lit(6), F.length(line)))
    body = F.concat(F.filter(F.array(inline), lambda x: ~is_blank(x)), _from(lines, at + 1))
    return F.when(at > 0, blank_to_null(F.array_join(body, "\n")))


def parse_blocks(responses: DataFrame) -> DataFrame:
    """One row per readable block: ``(batch_id, block_no, article_id, decision, reason, title, text, error)``.

    A block without article id is no result at all.  Every answer also gives one row without article
    id; its ``failure`` tells why the answer is unusable as a whole, if it is.
    """
    unanswered = F.coalesce(F.col("error_message"), F.lit(NO_ANSWER))
    failure = F.when(~F.coalesce("ok", F.lit(False)), unanswered).otherwise(batch_failure())
    judged = extract_blocks(responses).withColumn("failure", failure)
    usable = F.when(F.col("failure").isNull(), F.col("blocks")).otherwise(F.array().cast("array<string>"))
    blocks = judged.select(
        "batch_id", "failure",
        F.posexplode(F.concat(F.array(F.lit(None).cast("string")), usable)).alias("block_no", "block"),
    )
    found = _headers(blocks).filter((F.col("block_no") == 0) | (F.coalesce("article_id", F.lit("")) != ""))
    status = F.coalesce("status", F.lit(""))
    ready = status == "READY_TO_PUBLISH"
    read = found.withColumns({"_status": status, "_title": F.when(ready, _title()), "_text": F.when(ready, _text())})
    error = (
        F.when(F.col("block_no") == 0, F.lit(None))
        .when(F.col("_status") == "", F.lit("missing_status"))
        .when(ready & F.col("_title").isNull(), F.lit("missing_title"))
        .when(ready & F.col("_text").isNull(), F.lit("missing_text"))
    )
    good = error.isNull()
    return read.select(
        "batch_id",
        "block_no",
        F.nullif("article_id", F.lit("")).alias("article_id"),
        F.when(good, empty_to_null(F.col("_status"))).alias("decision"),
        F.when(F.col("_status") == "REJECT", _reason()).alias("reason"),
        F.when(good, F.col("_title")).alias("title"),
        F.when(good, F.col("_text")).alias("text"),
        error.alias("error"),
        "failure",
    )


def first_result() -> Column:
    """Aggregate: the fields of the first block of a group, as ``_r``."""
    fields = ("decision", "reason", "title", "text", "error", "failure")
    return F.min_by(F.struct(*fields), "block_no").alias("_r")


def parse_batch_results(responses: DataFrame) -> DataFrame:
    """First result of each id in an answer and how often the id occurs; and one row per answer.

    An aggregate instead of a window: repeated blocks collapse before the shuffle.
    """
    return (
        parse_blocks(responses)
        .groupBy("batch_id", "article_id")
        .agg(first_result(), F.count(F.lit(1)).alias("occurrences"))
        .select("batch_id", "article_id", "_r.*", "occurrences")
    )


def first_disallowed_tag(text: Column) -> Column:
    """Lower-case name of the first tag outside the whitelist; null if there is none."""
    tags = F.transform(F.regexp_extract_all(text, F.lit(_TAG), 1), F.lower)
    return F.when(F.contains(text, F.lit("<")), F.get(F.filter(tags, lambda t: ~t.isin(*ALLOWED_TAGS)), 0))


def tag_error(text: Column) -> Column:
    return F.concat(F.lit("Disallowed HTML tag in output: <"), first_disallowed_tag(text), F.lit(">"))


def parse_single(responses: DataFrame, text: str = "output_text") -> DataFrame:
    """Strict single-article answers: adds ``decision, reason, title, text`` or ``error``."""
    lined = responses.withColumn("_lines", lines_of(utrim(F.coalesce(text, F.lit("")))))
    head = lined.withColumn("_head", utrim(F.get("_lines", 0))).withColumn("_rest", F.slice("_lines", 2, F.size("_lines")))
    title_at = _position(F.col("_rest"), lambda x: ~is_blank(x))
    placed = head.withColumn("_title_at", title_at).withColumn(
        "_after", F.when(F.col("_title_at") > 0, _from(F.col("_rest"), F.col("_title_at") + 1))
    )
    placed = placed.withColumn("_text_at", _position(F.col("_after"), lambda x: ~is_blank(x)))
    title_line = utrim(F.get("_rest", F.col("_title_at") - 1))
    text_line = F.get("_after", F.col("_text_at") - 1)
    inline = F.rlike(text_line, F.lit(_TEXT_LINE))
    body_lines = F.concat(
        F.when(inline, F.array(F.regexp_extract(text_line, _TEXT_LINE, 1))).otherwise(F.array().cast("array<string>")),
        _from(F.col("_after"), F.col("_text_at") + 1),
    )
    read = placed.withColumns(
        {
            "_title": F.when(
                F.rlike(title_line, F.lit(_TITLE_LINE)), utrim(F.regexp_extract(title_line, _TITLE_LINE, 1))
            ),
            "_text_ok": inline | (utrim(text_line) == "Text:"),
            "_body": F.when(F.col("_text_at") > 0, _joined(body_lines)),
        }
    )
    ready, reject = F.col("_head") == "READY_TO_PUBLISH", F.col("_head") == "REJECT"
    error = (
        F.when(F.col("_head") == "", F.lit(EMPTY_SINGLE))
        .when(
            ready,
            F.when(F.col("_title_at") == 0, F.lit(NO_TITLE))
            .when(F.col("_title").isNull(), F.lit(NO_TITLE_LINE))
            .when(F.coalesce("_text_at", F.lit(0)) == 0, F.lit(NO_BODY))
            .when(~F.col("_text_ok"), F.lit(NO_TEXT_LINE))
            .when(F.col("_body") == "", F.lit(NO_BODY)),
        )
        .when(~reject, F.concat(F.lit("Unrecognized LLM output header: "), quoted(F.col("_head"))))
    )
    final = read.withColumn("error", error)
    good = F.col("error").isNull()
    return final.select(
        *responses.columns,
        F.when(good, F.col("_head")).alias("decision"),
        F.when(reject, blank_to_null(F.array_join("_rest", "\n"))).alias("reason"),
        F.when(good & ready, F.col("_title")).alias("title"),
        F.when(good & ready, F.col("_body")).alias("text"),
        "error",
    )

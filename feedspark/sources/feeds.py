"""Feed documents to entry rows."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedspark.functions.dates import iso_text, parts_to_instant
from feedspark.functions.text import empty_to_null
from feedspark.operators.lookups import lookup
from feedspark.schemas import ENTRIES, ENTRY_FIELDS
from feedspark.session import set_aside

# Failures worth another attempt; an HTTP status error is not among them.
TRANSIENT_ERRORS = ("ConnectTimeout", "ReadTimeout", "ConnectError", "RemoteProtocolError")

# Prefixed elements keep their prefix, so that none of them stands in for a plain one.
_RSS_ITEM = (
    "title string, link string, guid string, pubDate string, updated string, `dc:date` string, description string, "
    "`content:encoded` string, author string, `dc:creator` string, category array<string>, _corrupt_record string"
)
_ATOM_ENTRY = (
    "title string, link array<struct<_href:string,_rel:string>>, id string, published string, updated string, "
    "summary string, content array<string>, author struct<name:string>, category array<struct<_term:string>>, "
    "_corrupt_record string"
)
_XML = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
# Entities that XML itself knows.
_XML_ENTITIES = ("amp", "lt", "gt", "quot", "apos")
_ENTRY_STRUCT = f"struct<{', '.join(part.replace(' ', ':', 1) for part in ENTRY_FIELDS.split(', '))}>"


def settle_fetches(attempts: DataFrame, retries: DataFrame) -> DataFrame:
    """Outcome of each fetch from its recorded attempts.

    ``retries(source_id, retry_attempts)`` bounds the attempts that count (at least one).  The
    first attempt that succeeds, or fails for good, ends the fetch; otherwise the last one does.
    Only attempt numbers are aggregated; the deciding row, body included, is joined back on its
    unique key, so a source with very many runs is spread over all tasks.
    """
    allowed = F.greatest(F.coalesce(F.col("retry_attempts"), F.lit(1)), F.lit(1))
    failed = F.col("error_type").isNotNull()
    final = ~failed | ~F.col("error_type").isin(*TRANSIENT_ERRORS)
    keys = ["source_id", "run_id"]
    used = (
        lookup(
            attempts.select(*keys, "attempt", final.alias("_final")),
            retries.select("source_id", "retry_attempts"), ["source_id"], ["run_id", "attempt"], "left",
        )
        .filter(F.col("attempt") <= allowed)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_final"), F.col("attempt"))).alias("_settled"),
            F.max("attempt").alias("_last"),
        )
        .select(*keys, F.coalesce("_settled", "_last").alias("attempt"))
    )
    return (
        attempts.join(used, [*keys, "attempt"], "left_semi")
        .withColumnRenamed("attempt", "attempts_used")
        .withColumn("ok", ~failed)
    )


def _no(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _rss_entry(item: Column) -> Column:
    encoded = item["content:encoded"]
    return F.struct(
        item["link"].alias("link"),
        item["title"].alias("title"),
        item["guid"].alias("id"),
        item["guid"].alias("guid"),
        F.coalesce(item["pubDate"], item["dc:date"]).alias("published"),
        _no("array<int>").alias("published_parsed"),
        item["updated"].alias("updated"),
        _no("array<int>").alias("updated_parsed"),
        item["description"].alias("summary"),
        _no("string").alias("description"),
        F.when(encoded.isNotNull(), F.array(F.struct(encoded.alias("value")))).alias("content"),
        F.coalesce(item["author"], item["dc:creator"]).alias("author"),
        F.transform(item["category"], lambda c: F.struct(c.alias("term"))).alias("tags"),
    ).cast(_ENTRY_STRUCT)


def _atom_entry(entry: Column) -> Column:
    links = F.filter(
        entry["link"], lambda x: F.coalesce(empty_to_null(x["_rel"]), F.lit("alternate")) == "alternate"
    )
    return F.struct(
        F.get(links, 0)["_href"].alias("link"),
        entry["title"].alias("title"),
        entry["id"].alias("id"),
        _no("string").alias("guid"),
        entry["published"].alias("published"),
        _no("array<int>").alias("published_parsed"),
        entry["updated"].alias("updated"),
        _no("array<int>").alias("updated_parsed"),
        entry["summary"].alias("summary"),
        _no("string").alias("description"),
        F.transform(entry["content"], lambda c: F.struct(c.alias("value"))).alias("content"),
        entry["author"]["name"].alias("author"),
        F.transform(entry["category"], lambda c: F.struct(c["_term"].alias("term"))).alias("tags"),
    ).cast(_ENTRY_STRUCT)


def _plain_sections(body: Column) -> Column:
    """CDATA sections as escaped text, so that tags inside them are no tags."""

    def escaped(part: Column) -> Column:
        end = F.instr(part, "]]>")
        inner = F.substring(part, F.lit(1), end - 1)
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            inner = F.replace(inner, F.lit(sign), F.lit(name))
        return F.when(end > 0, F.concat(inner, F.substring(part, end + 3, F.length(part)))).otherwise(
            F.concat(F.lit("<![CDATA["), part)
        )

    parts = F.split(body, r"<!\[CDATA\[")
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(escaped(p))), "")
    return F.when(F.contains(body, F.lit("<![CDATA[")), joined).otherwise(body)


def _known_entities(body: Column) -> Column:
    """Named HTML entities as numbered ones; an ampersand that starts no reference is escaped."""
    names = {n: c for n, c in name2codepoint.items() if n not in _XML_ENTITIES}
    codes = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def named(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.try_element_at(codes, name)
        return (
            F.when(name.startswith("#") | name.isin(*_XML_ENTITIES), F.concat(F.lit("&"), part))
            .when(code.isNotNull(), F.concat(F.lit("&#"), code.cast("string"), F.substring(part, F.length(name) + 1, F.length(part))))
            .otherwise(F.concat(F.lit("&amp;"), part))
        )

    odd = body.rlike(rf"&(?!(?:{'|'.join(_XML_ENTITIES)}|#[0-9]+|#x[0-9A-Fa-f]+);)")
    mended = F.array_join(F.transform(F.split(body, "&"), lambda p, i: F.when(i == 0, p).otherwise(named(p))), "")
    return F.when(odd, mended).otherwise(body)


def parse_feeds(
    responses: DataFrame, stage: Callable[[DataFrame], DataFrame] = set_aside
) -> tuple[DataFrame, DataFrame]:
    """Entries of landed ``responses(source_id, run_id, body, ...)``, and a warning row per document that is damaged.

    RSS 2.0, RSS 1.0 and Atom.  A document is cut into its items and each item is read by a typed XML schema, in the
    task that scans it, so a broken item or tail costs no other item.  ``pos`` is the place among the
    document's whole items.  A warning carries how many items that begin in the document gave no entry.

    ``stage`` keeps the read documents: entries and warnings are taken from them, and no condition on a result is
    moved in front of the exchange that deals the documents out.
    """
    plain = responses.select("source_id", "run_id", _plain_sections(F.col("body")).alias("_b"))
    clean = plain.select(
        "source_id", "run_id", _known_entities(F.regexp_replace("_b", r"(?s)<!--.*?-->", "")).alias("_b")
    )
    # An item may not hold the start of another one: a broken item ends where the next begins.
    begun = F.filter(
        F.split("_b", r"(?=<(?:item|entry)[\s>])"), lambda p: p.rlike(r"^<(?:item|entry)[\s>]")
    )
    closed = F.col("_b").rlike(r"</(?:rss|feed|rdf:RDF)\s*>\s*$")
    cut = clean.select("source_id", "run_id", closed.alias("closed"), begun.alias("begun"))
    whole = F.filter(
        F.transform("begun", lambda p: F.regexp_extract(p, r"(?s)^<(item|entry)[\s>].*?</\1\s*>", 0)), lambda p: p != ""
    )
    read = F.transform(
        whole,
        lambda p: F.struct(
            F.from_xml(F.when(p.startswith("<item"), p), _RSS_ITEM, _XML).alias("rss"),
            F.from_xml(F.when(~p.startswith("<item"), p), _ATOM_ENTRY, _XML).alias("atom"),
        ),
    )
    # An item that cannot be read keeps its place as a null.
    entries = F.transform(
        "read",
        lambda r: F.when(F.coalesce(r["rss"]["_corrupt_record"], r["atom"]["_corrupt_record"]).isNotNull(), F.lit(None))
        .when(r["rss"].isNotNull(), _rss_entry(r["rss"]))
        .otherwise(_atom_entry(r["atom"])),
    )
    items = cut.select("source_id", "run_id", "closed", F.size("begun").alias("begun"), read.alias("read"))
    shaped = items.select("source_id", "run_id", "closed", "begun", entries.alias("entries"))
    lost = F.coalesce(F.col("begun") - F.size(F.filter("entries", lambda e: e.isNotNull())), F.lit(0)).cast("bigint")
    documents = stage(shaped.select("source_id", "run_id", "closed", lost.alias("lost"), "entries"))
    rows = (
        documents.select("source_id", "run_id", F.posexplode("entries").alias("pos", "e")).filter(F.col("e").isNotNull())
        .select("source_id", "run_id", F.col("pos").cast("bigint").alias("pos"), "e.*")
    )
    warnings = documents.select("source_id", "run_id", "closed", "lost").filter(
        ~F.coalesce("closed", F.lit(False)) | (F.col("lost") > 0)
    ).select("source_id", "run_id", F.lit("feed_parse_warning").alias("event"), "lost")
    return rows, warnings


def external_id(entry: DataFrame) -> Column:
    """Id a feed gives to an entry: the first present of id, guid, link, title."""
    return F.coalesce(*[empty_to_null(entry[c]) for c in ("id", "guid", "link", "title")])


def entry_json(entries: DataFrame) -> Column:
    """Raw form of an entry for storage, with parsed times as text."""
    shown = []
    for field in [f for f in ENTRIES.names if f not in ("source_id", "run_id", "pos")]:
        if field in ("published_parsed", "updated_parsed"):
            parts = entries[field]
            shown.append(F.coalesce(iso_text(parts_to_instant(parts)), F.to_json(parts)).alias(field))
        else:
            shown.append(entries[field])
    return F.to_json(F.struct(*shown))

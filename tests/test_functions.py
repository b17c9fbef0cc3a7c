from __future__ import annotations

import datetime
import random
from decimal import Decimal
from email.utils import parsedate_to_datetime

import pytest
from pyspark.sql import functions as F

from feedspark.functions import dates, money, redaction, text

UTC = datetime.timezone.utc


def expected_instant(value: str):
    value = value.strip()
    try:
        found = datetime.datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        try:
            found = parsedate_to_datetime(value)
        except (TypeError, ValueError):
            return None
    found = found if found.tzinfo else found.replace(tzinfo=UTC)
    return found.astimezone(UTC).replace(tzinfo=None)


DATES = [
    "2026-01-01T00:00:00Z", "2026-01-01", "20260101", "20260101T101112", "2026-01-01T10", "2026-01-01 10:11",
    "2026-01-01T10:11:12.5", "2026-01-01T10:11:12.123456789+03:00", "2026-01-01T10:11:12-0530", "2026-13-01", "12:30",
    "2026", "2026-01", "  2026-02-03T04:05:06Z \n", "Mon, 01 Jan 2024 10:00:00 GMT", "Mon, 1 Jan 2024 10:00 EST",
    "1 Jan 2024 10:00:00 +0300", "Mon, 01 Jan 24 10:00:00 -0000", "Mon, 01 Jan 70 10:00:00 PDT",
    "Mon 01 January 2024 10:00:00", "Jan 1 2024 10:00", "Mon, 1 Jan 2024", "Mon, 32 Jan 2024 10:00:00 GMT",
    "1 Foo 2024 10:00:00 GMT", "junk", "Mon, 01 Jan 2024 25:00:00 GMT", "Mon, 01 Jan 2024 10:00:00 XYZ",
    "Mon, 01 Jan 2024 10:00:00 +0300 (MSK)", "2024-02-30", "2024-02-30T10:00:00Z", "2024-01-01T10:00:00 +0300",
]


def test_dates_agree_with_the_standard_library(spark):
    df = spark.createDataFrame([(d,) for d in DATES], "s string")
    got = df.select("s", dates.parse_instant(F.col("s")).cast("timestamp_ntz").alias("t")).collect()
    assert {r.s: r.t for r in got} == {d: expected_instant(d) for d in DATES}


def test_first_present_date_field_decides(spark):
    df = spark.createDataFrame(
        [("junk", "2024-01-01"), ("", "2024-01-01"), (None, None)], "published string, updated string"
    )
    none = F.lit(None).cast("string")
    got = df.select(
        dates.entry_instant(none, F.col("published"), none, F.col("updated")).cast("string").alias("t")
    ).collect()
    assert [r.t for r in got] == [None, "2024-01-01 00:00:00", None]


def test_freshness_is_inclusive_and_drops_undated(spark, now):
    df = spark.createDataFrame([("2026-01-09",), ("2026-01-08T23:59:59Z",), (None,), ("soon",)], "p string")
    got = [r[0] for r in df.select(dates.is_fresh(F.col("p"), now, F.lit(24))).collect()]
    assert got == [True, False, False, False]


def test_display_date(spark):
    df = spark.createDataFrame([("2026-01-01T03:04:05+03:00",), (" soon ",), (None,), ("",)], "p string")
    got = [r[0] for r in df.select(dates.display_instant(F.col("p"))).collect()]
    assert got == ["2026-01-01 00:04 UTC", "soon", "-", "-"]


def test_time_parts(spark):
    df = spark.createDataFrame([([2024, 1, 2, 3, 4, 5, 0],), ([2024, 13, 1, 0, 0, 0],), (None,)], "p array<int>")
    got = [r[0] for r in df.select(dates.iso_text(dates.parts_to_instant(F.col("p")))).collect()]
    assert got == ["2024-01-02T03:04:05+00:00", None, None]


def test_trim_and_lines_follow_unicode_rules(spark):
    samples = [" \t x　\n", "\x1c ", "a\r\nb\x0bc d\x85e", "plain", "é \xa0"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select(text.utrim(F.col("s")), text.lines_of(F.col("s"))).collect()
    assert [r[0] for r in got] == [s.strip() for s in samples]
    assert got[2][1] == samples[2].splitlines()
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_html_escape_and_quotes(spark):
    df = spark.createDataFrame([("<a href=\"x\">Tom & 'Jo'</a>",)], "s string")
    assert df.select(text.html_escape(F.col("s"))).first()[0] == (
        "&lt;a href=&quot;x&quot;&gt;Tom &amp; &#x27;Jo&#x27;&lt;/a&gt;"
    )
    for sample in ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash"]:
        df = spark.createDataFrame([(sample,)], "s string")
        assert df.select(text.quoted(F.col("s"))).first()[0] == repr(sample)


@pytest.mark.parametrize(
    ("tokens", "price", "usd", "cents"),
    [(2500, "2.0", "0.005000", 1), (0, "2.0", "0.000000", 0), (10, "0", "0.000000", 0), (1, "0.499999", "0.000000", 0),
     (9_000_000_000_000, "14", "126000000.000000", 12_600_000_000)],
)
def test_cost(spark, tokens, price, usd, cents):
    cost = money.token_cost(F.lit(tokens).cast("bigint"), F.lit(Decimal(price)))
    row = spark.range(1).select(money.usd_text(cost), money.usd_cents(cost)).first()
    assert tuple(row) == (usd, cents)


BOT = "123456:ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"


@pytest.mark.parametrize(
    ("given", "masked"),
    [
        (f'POST https://api.telegram.org/bot{BOT}/sendMessage "200"', 'POST https://api.telegram.org/bot***/sendMessage "200"'),
        (f"token {BOT} end", "token *** end"),
        ("key sk-abcdefghij123.", "key ***."),
        ("bearer abc.def==", "Bearer ***=="),
        ("openai_api_key = secret,next", "openai_api_key=***,next"),
        ("TELEGRAM_BOT_TOKEN=x", "TELEGRAM_BOT_TOKEN=***"),
        ("sk-short 12345:abc", "sk-short 12345:abc"),
        ("ключsk-abcdefghij123", "ключsk-abcdefghij123"),
        ("", ""),
        (None, None),
    ],
)
def test_redaction(spark, given, masked):
    df = spark.createDataFrame([(given,)], "message string")
    assert redaction.redact(df).first()[0] == masked


def test_redaction_gates_change_nothing(spark):
    """The lookups in front of each pass never hide a match."""
    pieces = ["sk-abcdefghij", "Bearer ", "abc.def", "/bot", BOT, "OPENAI_API_KEY", "=", "secret", " ", "x", "é", "/", ","]
    rng = random.Random(7)
    samples = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    plain = F.col("s")
    for pattern, replacement in (
        redaction._ENV, redaction._BOT_URL, redaction._BOT_TOKEN, redaction._API_KEY, redaction._BEARER
    ):
        plain = F.regexp_replace(plain, pattern, replacement)
    assert df.select(plain.alias("a"), redaction.redact_text(F.col("s")).alias("b")).filter("a <> b").count() == 0


def test_redaction_reaches_nested_values_but_not_keys(spark):
    df = spark.sql(
        "select map('Bearer k', array(named_struct('t', 'Bearer abc', 'n', 1))) as m, 5 as n, cast(null as struct<a:string>) as s"
    )
    row = redaction.redact(df).first()
    assert row.m["Bearer k"][0].t == "Bearer ***" and row.m["Bearer k"][0].n == 1 and row.n == 5 and row.s is None

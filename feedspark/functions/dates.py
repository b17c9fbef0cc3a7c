"""Lenient date parsing: ISO 8601 first, RFC 2822 second, otherwise null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedspark.functions.text import bind, first_present, utrim

_DAY = r"^\d{4}-\d{2}-\d{2}"
_TIME = r"[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?"
_OFFSET = r"([+-])(\d{2}):?(\d{2})?(?::?(\d{2}))?"
_ISO = (
    r"^(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2}))"
    r"(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(?: ?" + _OFFSET + r")?)?$"
)
# Matched pieces are laid out with a separator that no date text holds.
_SEP = "\x01"
_ISO_SHAPE = _SEP.join(("$1-$2$4-$3$5", "$6", "$7", "$8", "$9", "$10", "$11", "$12", "$13"))

# RFC 2822 month names and zone abbreviations with their offsets in minutes.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_FULL_MONTHS = (
    "january february march april may june july august september october november december".split()
)
_ZONE_MINUTES = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_RFC = (
    r"(?i)^(?:\S*,\s*|(?:mon|tue|wed|thu|fri|sat|sun)\s+)?"
    r"(?:(\d{1,2})\s+([a-z]{3,9})|([a-z]{3,9})\s+(\d{1,2}),?)\s+(\d{2,4}),?\s+"
    r"(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2}))?"
    r"(?:\s*([+-])(\d{2})(\d{2})|\s+([a-z]\S*|\S+))?(?:\s.*)?$"
)
_RFC_SHAPE = _SEP.join(("$1$4", "$2$3", "$5", "$6", "$7", "$8", "$9", "$10", "$11", "$12"))


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _utc(day: Column, hms: Column) -> Column:
    """``yyyy-MM-dd`` and a padded time as an instant; impossible values become null."""
    return F.concat(day, F.lit("T"), hms, F.lit("Z")).try_cast("timestamp")


def _pieces(text: Column, pattern: str, shape: str, use: Callable[[Column], Column]) -> Column:
    """Match once: text that does not match stays in one piece and gives null."""
    count = shape.count(_SEP) + 1
    laid_out = F.split(F.regexp_replace(text, pattern, shape), _SEP, -1)
    return bind(laid_out, lambda p: F.when(F.size(p) == count, use(p)))


def _clock(hour: Column, minute: Column, second: Column, fraction: Column | None = None) -> Column:
    parts = F.concat_ws(":", *[F.lpad(c, 2, "0") for c in (hour, minute, second)])
    return parts if fraction is None else F.concat(parts, F.lit("."), F.rpad(fraction, 6, "0"))


def _shift(instant: Column, sign: Column, hours: Column, minutes: Column, seconds: Column | None = None) -> Column:
    """Move a wall-clock reading with a ``+hh:mm`` offset to UTC."""

    def number(part: Column) -> Column:
        return F.coalesce(part.try_cast("bigint"), F.lit(0))

    total = number(hours) * 3600 + number(minutes) * 60 + (number(seconds) if seconds is not None else 0)
    east = F.when(sign == "+", total).otherwise(-total) * 1_000_000
    return F.when(sign == "", instant).otherwise(F.timestamp_micros(F.unix_micros(instant) - east))


def _parse_iso(text: Column) -> Column:
    zulu = F.replace(text, F.lit("Z"), F.lit("+00:00"))
    return _pieces(
        zulu, _ISO, _ISO_SHAPE,
        lambda p: _shift(_utc(p[0], _clock(p[1], p[2], p[3], p[4])), p[5], p[6], p[7], p[8]),
    )


def _parse_common(text: Column) -> Column:
    """The frequent ISO forms, which a plain cast reads; anything it refuses is tried in general."""

    def shaped(pattern: str, suffix: str) -> Column:
        return F.when(F.rlike(text, F.lit(pattern)), F.concat(text, F.lit(suffix)).try_cast("timestamp"))

    return F.coalesce(
        shaped(_DAY + _TIME + r"(?:Z|[+-]\d{2}:\d{2})$", ""), shaped(_DAY + _TIME + "$", "Z"),
        shaped(_DAY + "$", "T00:00:00Z"),
    )


def _parse_rfc(text: Column) -> Column:
    month_number = {name: i + 1 for names in (_MONTHS, _FULL_MONTHS) for i, name in enumerate(names)}

    def read(p: Column) -> Column:
        month = F.try_element_at(_literal_map(month_number), F.lower(p[1]))
        year = p[2].try_cast("int")
        year = F.when(year > 99, year).when(year > 68, year + 1900).otherwise(year + 2000)
        day = F.concat(
            F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
            F.lpad(p[0], 2, "0"),
        )
        local = _shift(_utc(day, _clock(p[3], p[4], p[5])), p[6], p[7], p[8])
        zone = F.try_element_at(_literal_map(_ZONE_MINUTES), F.upper(p[9])).cast("bigint")
        moved = F.timestamp_micros(F.unix_micros(local) - zone * 60_000_000)
        return F.when(zone.isNull() | (zone == 0), local).otherwise(moved)

    return _pieces(text, _RFC, _RFC_SHAPE, read)


def parse_instant(text: Column) -> Column:
    """Timestamp of a date text; a reading without zone counts as UTC."""
    return bind(utrim(text), lambda t: F.coalesce(_parse_common(t), _parse_iso(t), _parse_rfc(t)))


def parts_to_instant(parts: Column) -> Column:
    """Instant of a ``[year, month, day, hour, minute, second, ...]`` array."""
    padded = [F.lpad(F.get(parts, i).cast("string"), 4 if i == 0 else 2, "0") for i in range(6)]
    return _utc(F.concat_ws("-", *padded[:3]), F.concat_ws(":", *padded[3:]))


def iso_text(instant: Column) -> Column:
    return F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def entry_instant(published_parsed: Column, published: Column, updated_parsed: Column, updated: Column) -> Column:
    """Time of a feed entry: the first field that is present decides, even if it cannot be parsed."""
    return parse_instant(first_present(published_parsed, published, updated_parsed, updated))


def display_instant(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM UTC``; text that is no date is shown as it is, absence as a dash."""
    shown = F.date_format(parse_instant(text), "yyyy-MM-dd HH:mm 'UTC'")
    return F.when(text.isNull() | (text == ""), F.lit("-")).otherwise(F.coalesce(shown, utrim(text)))


def hours_before(now: Column, hours: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - hours.cast("bigint") * 3_600_000_000)


def is_fresh(published: Column, now: Column, max_age_hours: Column) -> Column:
    """Publish gate: undated or unreadable is never fresh; the boundary counts as fresh."""
    instant = parse_instant(published)
    return F.coalesce(instant >= hours_before(now, max_age_hours), F.lit(False))

"""Unicode-aware trimming, line handling and escaping as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character the Unicode whitespace rule of the data model strips.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set for use inside a Java regular expression that carries the (?U) flag.
WS = r"[\s\x1c-\x1f]"

# The line boundaries of the data model (CR LF counts once).
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_RARE_BREAK = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and hand it to ``use``; a plain reference would compute it per use."""
    return F.get(F.transform(F.array(value), use), 0)


def utrim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def ultrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def urtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    """Trim; nothing left means null."""
    return F.nullif(utrim(c), F.lit(""))


def empty_to_null(c: Column) -> Column:
    """Only the empty string counts as absent; spaces are kept."""
    return F.nullif(c, F.lit(""))


def first_present(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[empty_to_null(c) for c in cols])


def or_dash(c: Column) -> Column:
    return F.coalesce(empty_to_null(c), F.lit("-"))


def lines_of(c: Column) -> Column:
    """Split into lines; the rare boundaries are rewritten only in text that holds one."""

    def split(text: Column) -> Column:
        plain = F.when(F.rlike(text, F.lit(_RARE_BREAK)), F.regexp_replace(text, LINE_BREAK, "\n")).otherwise(text)
        return F.split(plain, "\n", -1)

    return bind(c, split)


def is_blank(c: Column) -> Column:
    return utrim(c) == ""


def html_escape(c: Column) -> Column:
    """Escape the five HTML-sensitive characters; the ampersand has to go first."""
    # The standard entity for each character.
    for char, entity in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def quoted(c: Column) -> Column:
    """Quote text for an error message the way a Python literal shows it."""
    escaped = c
    for char, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\xa0", "\\xa0")):
        escaped = F.replace(escaped, F.lit(char), F.lit(shown))
    has_single, has_double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return (
        F.when(~has_single, F.concat(F.lit("'"), escaped, F.lit("'")))
        .when(~has_double, F.concat(F.lit('"'), escaped, F.lit('"')))
        .otherwise(F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))
    )

"""Column functions on raw log text.  Everything here stays inside the JVM.

Regex classes are ASCII (``\\d``, ``\\w``, ``\\s``); ``(?d)`` makes ``\\n`` the only
line terminator so that ``.`` crosses NEL and U+2028.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
BLANKS = " \t\n\x0b\f\r"
WILDCARD = "<*>"
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")
UNKNOWN = "UNKNOWN"
TIMESTAMP_SHAPES = (
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*Z?",
    r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}",
    r"\d{6}\s+\d{6}",
    r"\d{10,13}",
    r"\d{2,4}[/\-]\w{2,3}[/\-]\d{2,4}[: ]\d{2}:\d{2}:\d{2}",
)
LEVEL_WORDS = r"DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL|TRACE|NOTICE|ALERT|EMERG"
COMPONENT_SHAPES = (
    r"\[([a-zA-Z][\w./-]{1,60})\]",
    r"([a-zA-Z][\w./-]{1,60})\[\d+\]:",
    r"([a-zA-Z][\w./-]{1,60}):\s",
)
ENTITY_SHAPES = (
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?:req|request|trace|span|session|tx|correlation)[_\-]?[iI][dD][=: ]+([a-zA-Z0-9\-_]{8,})",
    r"\b[0-9a-f]{12,32}\b",
)

TIMESTAMP_ANY = "^(" + "|".join(TIMESTAMP_SHAPES) + r")\s+"
LEVEL_ANY = rf"(?i)\b({LEVEL_WORDS})\b"
DIGIT_TOKEN = r"\S*[0-9]\S*"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lines_of(text: Column) -> Column:
    """Array of stripped, non-blank lines of one text value."""
    parts = F.transform(F.split(text, "\r\n|\r|\n"), strip)
    return F.filter(parts, lambda x: x != "")


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


# -- generic line shape ------------------------------------------------------

def generic_ts(raw: Column) -> Column:
    """Leading timestamp by the first shape that fits, else ''."""
    return F.regexp_extract(raw, TIMESTAMP_ANY, 1)


def after_ts(raw: Column) -> Column:
    return F.regexp_replace(raw, TIMESTAMP_ANY, "")


def generic_level(rest: Column) -> Column:
    """First level word, upper-cased as written (WARNING stays WARNING)."""
    return F.coalesce(
        F.nullif(F.upper(F.regexp_extract(rest, LEVEL_ANY, 1)), F.lit("")), F.lit(UNKNOWN)
    )


def after_level(rest: Column) -> Column:
    """Cut the first level word out; text without one is left untouched."""
    cut = F.regexp_replace(rest, rf"(?d)^(.*?)(?i:\b(?:{LEVEL_WORDS})\b)", "$1")
    return F.when(rest.rlike(LEVEL_ANY), strip(cut)).otherwise(rest)


def generic_component(rest: Column) -> Column:
    return first_non_empty(*[F.regexp_extract(rest, p, 1) for p in COMPONENT_SHAPES])


def norm_level(level: Column) -> Column:
    up = F.upper(level)
    return F.when(up.isin(*LEVELS), up).otherwise(F.lit(UNKNOWN))


# -- entities ----------------------------------------------------------------

def entity(content: Column, raw: Column, pattern: str | None) -> Column:
    """Group 1 of ``pattern`` in the content, else in the whole line, else ''."""
    if not pattern:
        return F.lit("")
    return first_non_empty(
        F.regexp_extract(content, pattern, 1), F.regexp_extract(raw, pattern, 1)
    )


def has_group(pattern: str) -> bool:
    import re

    return re.compile(pattern).groups > 0


def entity_generic(raw: Column, pattern: str | None) -> Column:
    if not pattern:
        return F.lit("")
    return F.regexp_extract(raw, pattern, 1 if has_group(pattern) else 0)


# -- tokens ------------------------------------------------------------------

def tokens(content: Column) -> Column:
    return F.split(strip(content), r"\s+")


def signature(content: Column) -> Column:
    """Content with single blanks and every token that holds a digit wildcarded."""
    return F.regexp_replace(F.regexp_replace(strip(content), r"\s+", " "), DIGIT_TOKEN, WILDCARD)


def params(content: Column, template: Column) -> Column:
    """Content tokens standing where the template has a wildcard."""
    pairs = F.arrays_zip(tokens(content).alias("c"), tokens(template).alias("t"))
    hits = F.filter(pairs, lambda p: (p["t"] == WILDCARD) & p["c"].isNotNull())
    return F.transform(hits, lambda p: p["c"])


def strip_prefix(raw: Column) -> Column:
    """Drop the first four blank-separated fields when there are five or more."""
    return F.regexp_replace(strip(raw), r"^(?:\S+\s+){4}(?=\S)", "")


# -- text model answers ------------------------------------------------------

def strip_fence(text: Column) -> Column:
    """Answer text without a surrounding ``` fence."""
    clean = strip(text)
    lines = F.split(clean, "\n")
    body = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: strip(x) != "```")
    return F.when(clean.startswith("```"), F.array_join(body, "\n")).otherwise(clean)

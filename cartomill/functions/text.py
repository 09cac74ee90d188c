"""Text expressions: normalisers, match ranks, bounds, escapes and ids (JVM side where it can be)."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def decomposed(s: pd.Series) -> pd.Series:
    """NFKD without marks; Spark has no such built-in. Null stays null."""

    def one(t):
        return None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M"))

    return s.map(one)


@pandas_udf(StringType())
def without_latin_marks(s: pd.Series) -> pd.Series:
    """NFKD without the combining marks U+0300 to U+036F; the vowel signs of other scripts stay. Null stays null."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "\u0300" <= c <= "\u036f"))


def trimmed(c: Column) -> Column:
    """Without white space at the ends as JavaScript knows it: Unicode spaces, line ends and U+FEFF."""
    return F.regexp_replace(c, r"\A[\s\p{Z}\x{feff}]+|[\s\p{Z}\x{feff}]+\z", "")


def search_key(c: Column) -> Column:
    """No marks, lower case, runs of punctuation and separators are one space."""
    return F.trim(F.regexp_replace(F.lower(decomposed(c)), r"[\p{P}\p{Z}]+", " "))


def area_key(c: Column) -> Column:
    """As search_key, punctuation kept."""
    return F.regexp_replace(F.trim(F.lower(decomposed(c))), r"\s+", " ")


def candidate_key(c: Column) -> Column:
    """No marks of U+0300 to U+036F, trimmed, lower case."""
    return F.lower(trimmed(without_latin_marks(c)))


def match_rank(text: Column, query: Column) -> Column:
    """0 equal, 1 begins with, 2 contains, else null."""
    return F.when(text == query, 0).when(text.startswith(query), 1).when(text.contains(query), 2)


def bounded(c: Column, most: int) -> Column:
    """Text of 1 to most code points without control characters, trimmed as JavaScript does (Unicode spaces, line ends and U+FEFF)."""
    t = trimmed(c)
    return F.when((F.char_length(t) > 0) & (F.char_length(t) <= most) & ~has_control(t), t)


def has_control(c: Column, wide: bool = False) -> Column:
    """C0 and DEL, with C1 if wide."""
    return c.rlike(r"[\x00-\x1f\x7f-\x9f]" if wide else r"[\x00-\x1f\x7f]")


def truncated(c: Column, most: int) -> Column:
    """At most so many code points, the last an ellipsis where text was cut."""
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def xml_escaped(c: Column) -> Column:
    """Without code points XML forbids, the five marks escaped."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        out = F.replace(out, F.lit(raw), F.lit(f"&{name};"))
    return out


def area_id(country: Column, source: Column, source_id: Column) -> Column:
    """CC:source:id; null if a part is null, empty or has a colon."""
    parts = (country, source, source_id)
    good = F.lit(True)
    for p in parts:
        good = good & p.isNotNull() & (p != "") & ~p.contains(":")
    return F.when(good, F.concat_ws(":", *parts))


def country_code(c: Column) -> Column:
    """Two capital letters, else null."""
    t = F.upper(F.trim(c))
    return F.when(t.rlike(r"\A[A-Z]{2}\z"), t)


def is_whole(c: Column) -> Column:
    """Text of digits that a double holds exactly."""
    n = c.try_cast("decimal(38,0)")
    return F.coalesce(c.rlike(r"\A[0-9]{1,38}\z") & (n <= F.lit(9007199254740991)), F.lit(False))


def release_id(c: Column) -> Column:
    """YYYY-MM-DD.N with a day of the calendar, else null."""
    return F.when(c.rlike(r"\A\d{4}-\d{2}-\d{2}\.\d+\z") & F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd").isNotNull(), c)


def date_precision(c: Column) -> Column:
    """Year, month or day of a date written as YYYY, YYYY-MM or YYYY-MM-DD; null if it is none."""
    month = c.rlike(r"\A\d{4}-(0[1-9]|1[0-2])\z")
    day = c.rlike(r"\A\d{4}-\d{2}-\d{2}\z") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()
    return F.when(c.rlike(r"\A\d{4}\z"), "year").when(month, "month").when(day, "day")


def utc_instant(c: Column) -> Column:
    """D3: the instant of YYYY-MM-DDTHH:MM:SS.mmmZ text, null for other forms and impossible dates."""
    return F.when(
        c.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"),
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")),
    )


def html_safe_json(c: Column) -> Column:
    """JSON text that can stand in a script element: <, >, & and the line separators as escapes."""
    out = c
    for raw in ("<", ">", "&", "\u2028", "\u2029"):
        out = F.replace(out, F.lit(raw), F.lit(f"\\u{ord(raw):04x}"))
    return out


def is_form(c: Column, form: str) -> Column:
    """X11: whether text has a fixed form; false for null."""
    return F.coalesce(c.rlike(FORMS[form]), F.lit(False))


#: Forms of ids and digests.
FORMS = {
    "iso2": r"\A[A-Z]{2}\z", "sha256": r"\A[0-9a-f]{64}\z", "commit": r"\A[0-9a-f]{7,40}\z", "release": r"\A\d{4}-\d{2}-\d{2}\.\d+\z",
    "uuid": r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\z",
}


def secret_findings(c: Column) -> Column:
    """What of a text should not be published: ``absolute-path``, ``secret-key``, ``timestamp``; null text has none."""
    path = c.rlike(r"(?:\A|[\s\"'(=:,])(?:/(?:Users|home|root|tmp|var|etc|opt|mnt|private)/|[A-Za-z]:\\\\)")
    secret = c.rlike(r"(?i)(?:api[_-]?key|access[_-]?token|secret|passwo?r?d|authorization|private[_-]?key)\s*[:=]")
    stamp = c.rlike(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}")
    flags = [F.when(x, F.lit(n)) for n, x in (("absolute-path", path), ("secret-key", secret), ("timestamp", stamp))]
    return F.filter(F.array(*flags), lambda x: x.isNotNull())


def updated_in_order(created: Column, updated: Column) -> Column:
    """Whether an update is not before the creation, by instants; null if either is none."""
    return utc_instant(updated) >= utc_instant(created)


def canonical_text(json: Column) -> Column:
    """JS2, JS3, K5: JSON with the keys of every object in order and without spaces; equal for equal documents, null for text that is none."""
    return F.to_json(F.try_parse_json(json))


def merged_maps(*maps: Column) -> Column:
    """MP2: one map of all keys; of a key in several the last counts."""
    def over(m: Column, later: Column) -> Column:
        return F.map_concat(F.map_filter(m, lambda k, v: ~F.map_contains_key(later, k)), later)

    return reduce(over, maps)

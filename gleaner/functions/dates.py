"""Dates as people write them, to ISO 8601 in UTC. Built-in parsing only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import SPACE, bound, strip

NOISE_WORDS = ["last modified", *"added at by created date on posted published submitted updated".split()]
NOISE = rf"(?i)\b(?:{'|'.join(NOISE_WORDS)})\b[:{SPACE}]*"
SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 30 * 86400, "year": 365 * 86400}
RELATIVE = rf"(?i)(\d+)[{SPACE}]+({'|'.join(SECONDS)})s?[{SPACE}]+ago"
#: Shape, and patterns of the parser, in the order of precedence. A weekday is cut off first: the parser takes none.
SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", ["y-M-d H:m:s"]),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", ["y-M-d H:m"]),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ["y-M-d"]),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", ["y/M/d"]),
    (r"^\d{1,2} \p{L}+ \d{4} \d{1,2}:\d{1,2}$", ["d MMMM y H:m"]),
    (r"^\d{1,2} \p{L}+ \d{4}$", ["d MMMM y", "d MMM y"]),
    (r"^\p{L}+ \d{1,2} \d{4}$", ["MMMM d y", "MMM d y"]),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ["d-M-y"]),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", ["d/M/y", "M/d/y"]),
]
WEEKDAY = r"(?i)^(?:mon|tues|wednes|thurs|fri|satur|sun)day (?=\d{1,2} \p{L}+ \d{4}$)|^(?:mon|tue|wed|thu|fri|sat|sun) (?=\d{1,2} \p{L}+ \d{4}$)"
ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:.(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,]\d+)?)?)?([+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"


def iso_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def cleaned(c: Column) -> Column:
    """Without noise words, ordinal endings, "of" and commas."""
    s = F.regexp_replace(strip(c), NOISE, " ")
    s = F.regexp_replace(s, r"(?i)\b(\d{1,2})(?:st|nd|rd|th)\b", "$1")
    s = F.regexp_replace(s, r"(?i)\bof\b", " ")
    s = F.regexp_replace(s, r"[, ]+", " ")
    return F.regexp_replace(F.regexp_replace(s, f"[{SPACE}]+", " "), r"^[ .;|\-]+|[ .;|\-]+$", "")


def _stamp(t: Column, dated: Column | bool, zoned: Column | bool = False) -> Column:
    """Date only if there is no time of day (and no zone); NULL for no time at all."""
    dated, zoned = (x if isinstance(x, Column) else F.lit(x) for x in (dated, zoned))
    bare = dated | (~zoned & (F.date_format(t, "HH:mm:ss") == "00:00:00"))
    return F.when(bare, F.date_format(t, "yyyy-MM-dd")).otherwise(iso_time(t))


def iso_form(s: Column) -> Column:
    z = F.replace(s, F.lit("Z"), F.lit("+00:00"))
    g = lambda i: F.regexp_extract(z, ISO, i)
    # both date separators or none
    fits = z.rlike(ISO) & (z.rlike(r"^\d{4}-\d{2}-\d{2}") | z.rlike(r"^\d{8}(?!\d)"))
    two = lambda i: F.coalesce(F.nullif(g(i), F.lit("")), F.lit("00"))
    t = F.try_to_timestamp(F.concat(g(1), F.lit("-"), g(2), F.lit("-"), g(3), F.lit(" "), two(4), F.lit(":"), two(5), F.lit(":"), two(6)), F.lit("yyyy-MM-dd HH:mm:ss"))
    off = F.regexp_replace(g(7), ":", "")
    sign = F.when(off.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    seconds = sign * (F.coalesce(F.substring(off, 2, 2).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(F.substring(off, 4, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(off, 6, 2).try_cast("int"), F.lit(0)))
    moved = F.timestamp_seconds(F.unix_timestamp(t) - seconds)
    return F.when(fits & t.isNotNull(), F.when(off == "", _stamp(t, False)).otherwise(_stamp(moved, False, True)))


def zoned_form(s: Column) -> Column:
    """One-digit fields with an offset."""
    shape = r"^(\d{4}-\d{1,2}-\d{1,2})T(\d{1,2}:\d{1,2}:\d{1,2})([+-])(\d{2}):?(\d{2})$"
    g = lambda i: F.regexp_extract(s, shape, i)
    t = F.try_to_timestamp(F.concat(g(1), F.lit(" "), g(2)), F.lit("y-M-d H:m:s"))
    seconds = F.when(g(3) == "-", F.lit(-1)).otherwise(F.lit(1)) * (g(4).try_cast("int") * 3600 + g(5).try_cast("int") * 60)
    return F.when(s.rlike(shape) & t.isNotNull(), iso_time(F.timestamp_seconds(F.unix_timestamp(t) - seconds)))


def relative_form(s: Column, now: Column) -> Column:
    n = F.regexp_extract(s, RELATIVE, 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(s, RELATIVE, 2))
    each = F.create_map(*(F.lit(x) for kv in SECONDS.items() for x in kv))
    return F.when(s.rlike(RELATIVE), iso_time(F.timestamp_seconds(F.unix_timestamp(now) - n * F.try_element_at(each, unit))))


def absolute_form(s: Column) -> Column:
    """Of cleaned text. Which forms are tried follows from a few shapes, so most strings meet one parser."""

    def parsed(plain: Column, pattern: str) -> Column:
        return bound(F.try_to_timestamp(plain, F.lit(pattern)), lambda t: F.when(t.isNotNull(), _stamp(t, "H" not in pattern)))

    def days(plain: Column) -> Column:
        forms = []
        for shape, patterns in SHAPES:
            stamps = [parsed(plain, p) for p in patterns]
            forms.append(F.when(plain.rlike(shape), F.coalesce(*stamps)))
        return F.coalesce(*forms)

    moment = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"), bound(F.try_to_timestamp(F.regexp_replace(s, "T", " "), F.lit("y-M-d H:m:s")), lambda t: F.when(t.isNotNull(), _stamp(t, False))))
    numeric = F.when(s.rlike(r"^\d{4}-?\d{2}-?\d{2}"), iso_form(s))
    zoned = F.when(F.contains(s, F.lit("T")), F.coalesce(zoned_form(s), moment))
    within = bound(F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2})", 1), lambda d: F.when(d != "", F.date_format(F.try_to_timestamp(d, F.lit("yyyy-MM-dd")), "yyyy-MM-dd")))
    return F.coalesce(numeric, zoned, bound(F.regexp_replace(s, WEEKDAY, ""), days), within)


def parse_date(raw: Column, now: Column) -> Column:
    """struct(iso, ok). `now` is a parameter, so that results can be repeated."""
    plain = bound(cleaned(raw), lambda s: F.when(s != "", absolute_form(s)))
    relative = bound(strip(raw), lambda s: relative_form(s, now))
    iso = F.when(F.coalesce(raw, F.lit("")) != "", F.coalesce(relative, plain))
    return bound(iso, lambda x: F.struct(x.alias("iso"), x.isNotNull().alias("ok")))


def year_of(iso: Column) -> Column:
    return F.regexp_extract(iso, r"^(\d{4})", 1).try_cast("int")

"""URL functions on columns, by regular expressions (the built-in parser rejects many URLs of real pages)."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner.functions.text import bound, strip

PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
TRACKING_PREFIXES = "_ga fbclid gclid mc_ ref_ utm_".split()
TRACKING = "from ref referrer share source".split()


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, PARTS, n)


def server(url: Column) -> Column:
    """Host and port, without user info."""
    return F.regexp_replace(part(url, 2), "(?s)^.*@", "")


def host_of(url: Column) -> Column:
    """Lower-case host without port; '' if there is none."""
    return F.lower(bound(server(url), lambda s: F.when(s.startswith("["), F.regexp_extract(s, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(s, "^([^:]*)", 1))))


def registrable_match(url: Column, base: Column | str) -> Column:
    """The URL's host is `base` or lies under it."""
    base = F.lit(base) if isinstance(base, str) else base
    return bound(host_of(url), lambda h: (h == base) | h.endswith(F.concat(F.lit("."), base)))


def decode(c: Column) -> Column:
    """+ and percent codes; text with broken codes keeps them."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query(raw: Column, keep: set[str] | None = None) -> Column:
    """Parameters without tracking ones, sorted, encoded again."""
    pairs = F.filter(F.split(raw, "&"), lambda x: x != "")
    pairs = F.transform(pairs, lambda x: F.struct(decode(F.regexp_extract(x, "(?s)^([^=]*)", 1)).alias("k"), decode(F.regexp_replace(x, "(?s)^[^=]*=?", "")).alias("v")))

    def wanted(x: Column) -> Column:
        k = F.lower(x["k"])
        bad = k.isin(*TRACKING)
        for p in TRACKING_PREFIXES:
            bad = bad | k.startswith(p)
        return ~bad if keep is None else ~bad & k.isin(*keep)

    kept = F.array_sort(F.filter(pairs, wanted))
    return F.array_join(F.transform(kept, lambda x: F.concat(encode(x["k"]), F.lit("="), encode(x["v"]))), "&")


def normalize_url(url: Column, keep_params: set[str] | None = None, drop_query: bool = False) -> Column:
    """Canonical form for comparison. A bad port gives NULL. Parts are bound, as each is named often."""

    def of(p: Column) -> Column:
        scheme = F.lower(F.coalesce(F.nullif(p["scheme"], F.lit("")), F.lit("https")))
        digits, number = p["digits"], F.when(p["digits"].rlike("^[0-9]{1,9}$"), p["digits"].try_cast("int"))
        bad = (digits != "") & (number.isNull() | (number > 65535))
        usual = ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443)) | (number == 0)
        host = F.concat(p["host"], F.when((digits == "") | usual, F.lit("")).otherwise(F.concat(F.lit(":"), number.cast("string"))))
        path = F.coalesce(F.nullif(p["path"], F.lit("")), F.lit("/"))
        place = F.when(host != "", F.concat(F.lit("//"), host, F.when(path.startswith("/"), F.lit("")).otherwise("/"), path)).otherwise(F.when(path.startswith("/"), F.concat(F.lit("//"), path)).otherwise(path))
        out = F.concat(scheme, F.lit(":"), place)
        if not drop_query:
            q = F.when(p["query"] == "", F.lit("")).otherwise(query(p["query"], keep_params))
            out = F.concat(out, bound(q, lambda x: F.when(x != "", F.concat(F.lit("?"), x)).otherwise("")))
        return F.when(~bad, out)

    def split(u: Column) -> Column:
        digits = bound(server(u), lambda s: F.regexp_extract(s, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1))
        return F.struct(part(u, 1).alias("scheme"), host_of(u).alias("host"), digits.alias("digits"), part(u, 3).alias("path"), part(u, 4).alias("query"))

    return bound(bound(F.regexp_replace(strip(url), r"[\t\r\n]", ""), split), of)


@F.pandas_udf(StringType())
def joined(base: pd.Series, href: pd.Series) -> pd.Series:
    """Relative references with dot segments, which need a loop."""
    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href)], dtype=object)


def followable(href: Column) -> Column:
    h = strip(href)
    return (h != "") & ~h.startswith("#") & ~h.startswith("javascript:") & ~h.startswith("mailto:")


def absolute(base: Column, href: Column) -> Column:
    """A reference without dot segments made absolute, in the JVM; NULL where `joined` is needed."""
    h = strip(href)
    scheme, place = part(base, 1), part(base, 2)
    dots = h.rlike(r"(^|/)\.{1,2}(/|$|\?|#)")
    root = F.concat(scheme, F.lit("://"), place)
    folder = F.regexp_replace(F.coalesce(F.nullif(part(base, 3), F.lit("")), F.lit("/")), "[^/]*$", "")
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(dots, F.lit(None).cast("string"))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(root, F.coalesce(F.nullif(part(base, 3), F.lit("")), F.lit("")), h))
        .otherwise(F.concat(root, folder, h))
    )

"""Text functions on columns. All are JVM expressions but the Unicode forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: All white space, as characters.
BLANKS = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Horizontal white space, and all white space, spelt out so that no engine's own classes matter.
RUN = r"[\t \x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
SEPARATOR = "\n".join(["", "", "---", "### Source & Archival Attribution", ""])
MISSING = "not listed on source page"
STOP_TERMS = "all categories home more stories story tags".split()


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unicode_form(form: str):
    """An Arrow UDF for a Unicode normal form; NULL stays NULL."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(form, x), na_action="ignore")

    return run


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    """Compatibility form and full case folding."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def with_nfc(df: DataFrame, name: str) -> DataFrame:
    """The column in composed form. Rows without a character from U+0300 on can't change and skip Python."""
    may = F.coalesce(F.col(name).rlike(r"[^\x{0}-\x{2ff}]"), F.lit(False))
    return df.where(~may).unionByName(df.where(may).withColumn(name, unicode_form("NFC")(F.col(name))))


def strip(c) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c) -> Column:
    return strip(F.regexp_replace(c, RUN, " "))


def normalize_paragraphs(c: Column, nfc: bool = False) -> Column:
    """Paragraphs between runs of line ends; lines squeezed, empty ones dropped. `nfc` composes first (in Python)."""
    flat = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    if nfc:
        flat = unicode_form("NFC")(flat)
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), squeeze), lambda x: x != "")
    return F.filter(F.transform(F.split(flat, "\n{2,}"), lambda p: F.array_join(lines(p), "\n")), lambda p: p != "")


def clean_inline(c: Column, nfc: bool = False) -> Column:
    """Squeezed text, NULL if nothing is left. Line ends inside stay."""
    return F.nullif(squeeze(unicode_form("NFC")(c) if nfc else c), F.lit(""))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[{WORD}\x{{2019}}'\-]+"))


def content_hash(paragraphs: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(paragraphs, lambda p: F.lower(squeeze(p))), "\n"), 256))


def body_paragraphs(paragraphs: Column) -> Column:
    return F.filter(paragraphs, lambda p: p.rlike(f"[^{SPACE}]"))


def body_text(paragraphs: Column) -> Column:
    return F.array_join(body_paragraphs(paragraphs), "\n\n")


def strip_attribution(c: Column) -> Column:
    """The text before the first separator, without white space at its end; without a separator, the text."""
    at = F.locate(SEPARATOR, c)
    return F.when(at > 0, F.regexp_replace(F.substring(c, F.lit(1), at - 1), f"[{SPACE}]+$", "")).otherwise(c)


def normalize_terms(values: Column) -> Column:
    """Lower-case, squeezed, distinct, sorted; without stop terms and those over 80 characters. NULL gives no terms."""

    def one(v: Column) -> Column:
        return F.lower(F.btrim(F.regexp_replace(v, f"[{SPACE}]+", " "), F.lit(" ,;|/")))

    terms = F.transform(F.filter(values, lambda v: v.isNotNull() & (v != "")), one)
    good = F.filter(terms, lambda t: (t != "") & (F.length(t) <= 80) & ~t.isin(*STOP_TERMS))
    return F.coalesce(F.array_sort(F.array_distinct(good)), F.array().cast("array<string>"))


def listed(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(MISSING))


def attribution_block(source_url, site_name, site_host, author_name, author_url, published_at, categories, tags, license_note, archived_at) -> Column:
    many = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("not listed")
    rows = [
        ("Source URL: ", source_url),
        ("Source site: ", F.concat(site_name, F.lit(" ("), site_host, F.lit(")"))),
        ("Author/submitter: ", listed(author_name)),
        ("Author profile: ", listed(author_url)),
        ("Published: ", listed(published_at)),
        ("Categories: ", many(categories)),
        ("Tags: ", many(tags)),
        ("License/terms: ", license_note),
        ("Archived at: ", archived_at),
    ]
    return F.concat(F.lit(SEPARATOR.lstrip("\n")), F.concat_ws("\n", *(F.concat(F.lit(k), v) for k, v in rows)))


def with_attribution(body: Column, block: Column) -> Column:
    return F.when(body != "", F.concat(body, F.lit("\n\n"), block)).otherwise(block)


def slugify(c: Column, nfkd: bool = True) -> Column:
    """ASCII letters and digits joined by hyphens. Compatibility decomposition runs in Python, unless `nfkd` is off."""
    plain = F.regexp_replace(unicode_form("NFKD")(c) if nfkd else c, r"[^\x00-\x7f]", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(plain, "[^0-9A-Za-z]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled"))


def match_form(folded_text: Column) -> Column:
    """Case-folded text with dashes, _ and / as blanks and other signs dropped; for term matching."""
    x = F.regexp_replace(folded_text, r"[\x{2010}-\x{2015}_/]+", " ")
    x = F.regexp_replace(x, rf"[^{WORD}{SPACE}'\-]", " ")
    return strip(F.regexp_replace(x, f"[{SPACE}]+", " "))


def term_count(haystack: Column, term: str) -> Column:
    """Occurrences of a literal term with no word character on either side."""
    if not term:
        return F.lit(0)
    return F.regexp_count(haystack, F.lit(rf"(?<![{WORD}])\Q{term}\E(?![{WORD}])"))


def truthy(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))

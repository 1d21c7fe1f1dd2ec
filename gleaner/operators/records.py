"""Parsed documents to canonical records: one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.dates import iso_time, year_of

BLOCKING = ("empty_body", "missing_title", "missing_canonical")
FLAGS = (*BLOCKING, *"missing_author missing_date unparseable_date missing_tags short_body body_fallback_heuristic truncated_multipage unclassified_taxonomy".split())
TEXTS = """source_url dedup_key canonical_url external_id title author_name author_url published_at published_at_raw language
source_description primary_niche target_funnel recommended_affiliate seo_slug""".split()
LISTS = "tags categories body_paragraphs source_keywords detected_ad_placements detected_commercial_links flags".split()


def fields(df: DataFrame) -> list[Column]:
    have = set(df.columns)
    empty = F.array().cast("array<string>")
    out = [(F.col(c) if c in have else F.lit("en" if c == "language" else None).cast("string")).alias(c) for c in TEXTS]
    out += [(F.coalesce(F.col(c), empty) if c in have else empty).alias(c) for c in LISTS]
    rest = {"classification_confidence": "double", "http_status": "int", "extra": "string"}
    return out + [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in rest.items()]


def parsed(df: DataFrame) -> DataFrame:
    """The columns of a parsed document, with defaults for those `df` lacks: no text, empty lists. Others are dropped."""
    return df.select(*fields(df))


def add_flag(flags: Column, flag: str) -> Column:
    return F.when(F.array_contains(flags, flag), flags).otherwise(F.array_append(flags, F.lit(flag)))


def derived_flags(tags: Column, categories: Column, body: Column, words: Column, min_words: int) -> Column:
    """Flags that follow from the fields; '' counts as missing."""
    no = lambda c: ~T.truthy(F.col(c))
    undated = F.when(T.truthy(F.col("published_at_raw")), F.lit("unparseable_date")).otherwise(F.lit("missing_date"))
    rules = [
        F.when(no("title"), F.lit("missing_title")),
        F.when(no("author_name"), F.lit("missing_author")),
        F.when(no("published_at"), undated),
        F.when((F.size(tags) == 0) & (F.size(categories) == 0), F.lit("missing_tags")),
        F.when(no("canonical_url"), F.lit("missing_canonical")),
        F.when(body == "", F.lit("empty_body")).when(words < min_words, F.lit("short_body")),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def complete(flags: Column) -> Column:
    return ~F.arrays_overlap(flags, F.array(*map(F.lit, BLOCKING)))


def build_records(df: DataFrame, site_id, site_name, site_host, license_note, adapter_version, as_of: Column, min_words: int = 120) -> DataFrame:
    """Records of parsed documents (see `parsed`); site values are strings or columns. `as_of` stands for the clock.

    Given flags keep their duplicates; derived ones are added where absent; the result is sorted.
    """
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    c = F.col
    site = {"source_site": lit(site_id), "source_site_name": lit(site_name), "_host": lit(site_host), "license_note": lit(license_note), "adapter_version": lit(adapter_version)}
    base = df.select(*fields(df), *(v.alias(k) for k, v in site.items()))
    base = base.withColumns({"tags": T.normalize_terms(c("tags")), "categories": T.normalize_terms(c("categories")), "body_text": T.body_text(c("body_paragraphs")), "fetched_at": iso_time(as_of)})
    base = base.withColumn("word_count", T.word_count(c("body_text")))
    new = derived_flags(c("tags"), c("categories"), c("body_text"), c("word_count"), min_words)
    base = base.withColumn("flags", F.array_sort(F.concat(c("flags"), F.array_except(new, c("flags")))))
    url = F.when(T.truthy(c("canonical_url")), c("canonical_url")).otherwise(c("source_url"))
    block = T.attribution_block(url, c("source_site_name"), c("_host"), c("author_name"), c("author_url"), c("published_at"), c("categories"), c("tags"), c("license_note"), c("fetched_at"))
    base = base.withColumn("attribution_block", block)
    return base.withColumns(
        {
            "body_with_attribution": T.with_attribution(c("body_text"), c("attribution_block")),
            "published_year": year_of(c("published_at")),
            "paragraph_count": F.size(T.body_paragraphs(c("body_paragraphs"))),
            "char_count": F.length("body_text"),
            "content_hash": T.content_hash(c("body_paragraphs")),
            "is_complete": complete(c("flags")),
        }
    ).drop("body_paragraphs", "_host")


def to_dict(records: DataFrame) -> DataFrame:
    """What is stored and exported: all but the confidence."""
    return records.drop("classification_confidence")


def without_nulls(*maps: Column) -> Column:
    """Maps merged, the later one winning, without NULL values. Needs spark.sql.mapKeyDedupPolicy=LAST_WIN where keys may repeat."""
    return F.map_filter(F.map_concat(*maps), lambda _, v: v.isNotNull())

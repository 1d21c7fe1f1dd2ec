"""Weighted keyword classification of documents by a taxonomy: one fused projection, no join and no shuffle.

A taxonomy is small configuration (a list of categories with keywords), so its terms become literal patterns when the plan is
built; the work per document is bounded by its own text. Fields are normalised and terms counted once, in one Arrow pass.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import text as T

WEIGHTS = {"body": 1, "title": 4, "meta_keyword": 5, "source_tag": 6, "body_match_cap": 3}
#: Characters of a body that the reference's classifier reads; what a caller may pass as `sample`.
SAMPLE = 4000
TITLE_CAP = 2
RESULT = "primary_niche target_funnel recommended_affiliate seo_slug scores matched_terms confidence".split()


@dataclass(frozen=True)
class Category:
    niche: str
    funnel: str
    affiliate: str
    keywords: tuple[str, ...]


@dataclass(frozen=True)
class Taxonomy:
    """Categories in order of precedence; `fallback` names what unmatched documents get, whatever the categories are."""

    categories: tuple[Category, ...]
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    fallback: tuple[str, str, str] = ("general", "general", "general")

    @classmethod
    def of(cls, config: dict, fallback: tuple[str, str, str] | None = None) -> Taxonomy:
        cats = tuple(Category(c["primary_niche"], c["target_funnel"], c["recommended_affiliate"], tuple(c.get("keywords", ()))) for c in config["categories"])
        weights = WEIGHTS | {name: int(w) for name, w in (config.get("weights") or {}).items()}
        return cls(cats, weights, fallback or cls.fallback)


#: A neutral taxonomy for use without a file.
DEFAULT = Taxonomy.of(
    {
        "categories": [
            {"primary_niche": "science", "target_funnel": "digest", "recommended_affiliate": "journals", "keywords": ["science", "physics", "data set", "theory"]},
            {"primary_niche": "cooking", "target_funnel": "recipes", "recommended_affiliate": "kitchen", "keywords": ["recipe", "cooking", "oven", "slow cooker"]},
            {"primary_niche": "travel", "target_funnel": "guides", "recommended_affiliate": "tickets", "keywords": ["travel", "hotel", "city guide", "train"]},
        ]
    }
)


def load_taxonomy(path: str | None = None, fallback: tuple[str, str, str] | None = None) -> Taxonomy:
    """From a JSON file; without one (no path, or none there) the default. It is configuration, read by the driver."""
    if path is None or not os.path.exists(path):
        return DEFAULT
    with open(path, encoding="utf-8") as f:
        return Taxonomy.of(json.load(f), fallback)


def taxonomy_table(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """One row per keyword, with the places of category and keyword."""
    rows = [(i, j, c.niche, c.funnel, c.affiliate, k) for i, c in enumerate(taxonomy.categories) for j, k in enumerate(c.keywords)]
    return spark.createDataFrame(rows, "cat_pos int, kw_pos int, primary_niche string, target_funnel string, recommended_affiliate string, keyword string")


#: Signs that part words, `text.match_form`'s in Python; of ASCII by table.
SIGNS = re.compile(r"[^\w\s'\-]|_")
ASCII_SIGNS = {i: " " for i in range(128) if not (chr(i).isalnum() or chr(i).isspace() or chr(i) in "'-")}


def normal_term(s: str) -> str:
    """Case-folded compatibility form with dashes, _ and / as blanks and other signs dropped, for terms and texts alike."""
    if s.isascii():
        return " ".join(s.lower().translate(ASCII_SIGNS).split())
    return " ".join(SIGNS.sub(" ", unicodedata.normalize("NFKC", s).casefold()).split())


def occurrences(text: str, term: str) -> int:
    """Of a literal term with no letter or digit on either side (`text` in normal form)."""
    n, at, k, end = 0, text.find(term), len(term), len(text)
    while at >= 0:
        whole = not (at and text[at - 1].isalnum()) and not (at + k < end and text[at + k].isalnum())
        n += whole
        at = text.find(term, at + (k if whole else 1))
    return n


def term_counts(title: Column, body: Column, tags: Column, keywords: Column, terms: list[str]) -> Column:
    """For each term, how often the tags, keywords, title and body have it, as one array. Lists are joined by a sign that no term holds."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        many = lambda x: "\x01".join(map(normal_term, x.split("\x01"))) if x else ""
        for batch in batches:
            rows = zip(*(map(f, x) for f, x in zip((many, many, normal_term, normal_term), batch)))
            yield pd.Series([[occurrences(x, t) for t in terms for x in row] for row in rows], dtype=object)

    # not for plans to repeat: a filter that is inferred from what is made of the counts would count again
    return run.asNondeterministic()(tags, keywords, title, body)


def plain_slug(s: str) -> str:
    s = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()
    return re.sub("[^a-z0-9]+", "-", s.lower()).strip("-") or "untitled"


def classified(df: DataFrame, taxonomy: Taxonomy = DEFAULT, title: str = "title", tags: str = "tags", categories: str = "categories", keywords: str = "source_keywords", body: str = "body_text", sample: int | None = None) -> DataFrame:
    """`df` with the columns of RESULT. NULL fields count as empty. The whole body is read, or its first `sample` characters.

    Several tags that hold a keyword count once; the title counts at most twice, the body up to its cap. The best score wins,
    the first category among equals. A later category of a niche replaces the score and matches of an earlier one, and keeps its place and slug term.
    """
    c, w = F.col, taxonomy.weights
    none = F.array().cast("array<string>")
    lists = lambda x: F.array_join(F.transform(F.coalesce(x, none), lambda v: F.coalesce(v, F.lit(""))), "\x01")
    whole = F.coalesce(c(body), F.lit(""))
    # each term is counted once in each field
    terms = list(dict.fromkeys(t for cat in taxonomy.categories for k in cat.keywords if (t := normal_term(k))))
    fields = ("_tags", "_keywords", "_title", "_body")
    counts = term_counts(F.coalesce(c(title), F.lit("")), whole if sample is None else F.substring(whole, 1, sample), lists(F.concat(F.coalesce(c(tags), none), F.coalesce(c(categories), none))), lists(c(keywords)), terms)
    df = df.withColumns({"_slug": T.slugify(F.when(T.truthy(c(title)), c(title)).otherwise("story")), "_n": counts if terms else F.array().cast("array<int>")})
    at = {t: [F.get(c("_n"), F.lit(len(fields) * i + j)) for j in range(len(fields))] for i, t in enumerate(terms)}
    niches: dict[str, list[Column]] = {}
    for i, cat in enumerate(taxonomy.categories):
        score, labels, seeds = F.lit(0), [], []
        for k in cat.keywords:
            if not (term := normal_term(k)):
                continue
            tags_n, keywords_n, title_n, body_n = at[term]
            in_body = F.least(body_n, F.lit(w["body_match_cap"]))
            score = score + F.when(tags_n > 0, w["source_tag"]).otherwise(0) + F.when(keywords_n > 0, w["meta_keyword"]).otherwise(0) + w["title"] * F.least(title_n, F.lit(TITLE_CAP)) + w["body"] * in_body
            labels += [F.when(n > 0, F.lit(f"{kind}:{k}")) for kind, n in (("tag", tags_n), ("keyword", keywords_n), ("title", title_n))]
            labels.append(F.when(body_n > 0, F.concat(F.lit(f"body:{k}x"), in_body.cast("string"))))
            seeds.append(F.when(tags_n + keywords_n + title_n + body_n > 0, F.lit(plain_slug(term))))
        niches.setdefault(cat.niche, []).append(F.struct(
            score.alias("score"), F.lit(-i).alias("order"), F.lit(cat.niche).alias("niche"),
            (F.array_compact(F.array(*labels)) if labels else F.array().cast("array<string>")).alias("labels"),
            (F.coalesce(*seeds) if seeds else F.lit(None).cast("string")).alias("seed"),
        ))

    def merged(own: list[Column]) -> Column:
        """The last category of a niche that scores, in the place of the first that does, with the first term found in any."""
        if len(own) == 1:
            return own[0]
        last, first = own[0], own[-1]["order"]
        for x in own[1:]:
            last = F.when(x["score"] > 0, x).otherwise(last)
        for x in reversed(own[:-1]):
            first = F.when(x["score"] > 0, x["order"]).otherwise(first)
        return F.struct(last["score"].alias("score"), first.alias("order"), last["niche"].alias("niche"), last["labels"].alias("labels"), F.coalesce(*(x["seed"] for x in own)).alias("seed"))

    per = F.array(*map(merged, niches.values())) if niches else F.array().cast("array<struct<score: int, order: int, niche: string, labels: array<string>, seed: string>>")
    df = df.withColumn("_scored", F.filter(per, lambda x: x["score"] > 0))
    first = {x.niche: x for x in reversed(taxonomy.categories)}
    attribute = lambda key, pick: F.try_element_at(F.create_map(*(F.lit(v) for n, x in first.items() for v in (n, pick(x)))), key)
    ranked = F.sort_array(F.transform("_scored", lambda x: x["score"]), False)
    df = df.withColumns({"_best": F.array_max("_scored"), "_ranked": ranked})
    best, none_found, fall = c("_best"), F.size("_scored") == 0, taxonomy.fallback
    s1, s2 = F.get(c("_ranked"), F.lit(0)), F.coalesce(F.get(c("_ranked"), F.lit(1)), F.lit(0))
    seed = F.coalesce(best["seed"], F.lit(""))
    out = {
        "primary_niche": F.coalesce(best["niche"], F.lit(fall[0])),
        "target_funnel": F.coalesce(attribute(best["niche"], lambda x: x.funnel), F.lit(fall[1])),
        "recommended_affiliate": F.coalesce(attribute(best["niche"], lambda x: x.affiliate), F.lit(fall[2])),
        "seo_slug": F.concat(c("_slug"), F.lit("-"), F.when(none_found, F.lit(fall[0])).otherwise(seed)),
        "scores": F.map_from_entries(F.transform("_scored", lambda x: F.struct(x["niche"], x["score"]))),
        "matched_terms": F.coalesce(best["labels"], none),
        "confidence": F.when(none_found, F.lit(0.0)).otherwise(F.bround(s1 / (s1 + s2 + F.lit(1e-6)), 4)),
    }
    return df.withColumns(out).drop("_slug", "_n", "_scored", "_best", "_ranked")

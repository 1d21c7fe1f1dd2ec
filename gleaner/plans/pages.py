"""Pages to classified records: one Python pass over the HTML, then expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.html import parsed_page
from gleaner.functions.urls import host_of, normalize_url, registrable_match
from gleaner.operators.classify import DEFAULT, Taxonomy, classified
from gleaner.operators.discover import edges
from gleaner.operators.records import build_records, to_dict

CLASSES = "primary_niche target_funnel recommended_affiliate seo_slug".split()


@dataclass(frozen=True)
class Site:
    """What a site adapter declares. Patterns are searched in normalised URLs."""

    site_id: str
    display_name: str
    base_url: str
    base_host: str
    story_re: str
    listing_res: tuple[str, ...] = ()
    license_note: str = ""
    language: str = "en"
    adapter_version: str = "1.0.0"
    start_urls: tuple[str, ...] = ()
    #: What a site may do its own way: URLs, keys, ids, and the parser (pages and the site in, parsed documents out).
    normalize: Callable[[Column], Column] = normalize_url
    key_of: Callable[[Column], Column] | None = None
    id_of: Callable[[Column], Column] | None = None
    parser: Callable[[DataFrame, Site], DataFrame] | None = None

    def dedup_key(self, url: Column) -> Column:
        return (self.key_of or self.normalize)(url)

    def external_id(self, url: Column) -> Column:
        return self.id_of(url) if self.id_of else F.lit(None).cast("string")

    def is_story(self, url: Column) -> Column:
        return url.rlike(self.story_re)

    def is_listing(self, url: Column) -> Column:
        hit = F.lit(False)
        for p in self.listing_res:
            hit = hit | url.rlike(p)
        return hit


def parse_pages(pages: DataFrame, site: Site) -> DataFrame:
    """Parsed documents of pages (url, html; final_url and status if there): the default parser of a site."""
    p = pages.withColumn("_p", parsed_page(F.col("html"), want=("title", "canonical", "paragraphs", "fallback")))
    status = F.col("status") if "status" in pages.columns else F.lit(None).cast("int")
    canonical = F.coalesce(F.col("_p.canonical"), F.col("final_url") if "final_url" in pages.columns else F.col("url"))
    return p.select(
        F.col("url").alias("source_url"),
        site.dedup_key(F.col("url")).alias("dedup_key"),
        site.normalize(canonical).alias("canonical_url"),
        site.external_id(F.col("url")).alias("external_id"),
        F.col("_p.title").alias("title"),
        F.col("_p.paragraphs").alias("body_paragraphs"),
        F.when(F.col("_p.fallback"), F.array(F.lit("body_fallback_heuristic"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.lit(site.language).alias("language"),
        status.alias("http_status"),
    )


def page_records(pages: DataFrame, site: Site, as_of: Column, taxonomy: Taxonomy = DEFAULT) -> DataFrame:
    """Records with their classes. Pages of all hosts can be given; the site's name goes with each host."""
    parsed = (site.parser or parse_pages)(pages, site)
    records = build_records(parsed, site.site_id, site.display_name, host_of(F.col("source_url")), site.license_note, site.adapter_version, as_of)
    out = classified(records.drop(*CLASSES, "classification_confidence"), taxonomy)
    return out.withColumnRenamed("confidence", "classification_confidence")


def story_pages(pages: DataFrame, site: Site) -> DataFrame:
    """The pages of a corpus that are the site's stories."""
    url = site.normalize(F.col("url"))
    return pages.where(registrable_match(url, site.base_host) & site.is_story(url))


def site_links(pages: DataFrame, site: Site) -> DataFrame:
    """Links to the site's stories and listings; see `discover.edges`."""
    return edges(pages, site.base_host, site.story_re, site.listing_res)


def records_of(pages: DataFrame, sites: list[Site], as_of: Column, taxonomy: Taxonomy = DEFAULT) -> DataFrame:
    """Records of the stories of several sites, each parsed its own way."""
    found = [page_records(story_pages(pages, s), s, as_of, taxonomy) for s in sites]
    return reduce(DataFrame.unionByName, found)


def probe(pages: DataFrame, site: Site, url: str, as_of: Column, taxonomy: Taxonomy = DEFAULT, save_html: str | None = None) -> dict | None:
    """The record of one page as a dict, for a look at it; None if the corpus hasn't the page. Raw HTML goes to `save_html`."""
    page = pages.where(F.col("url") == url).limit(1)
    if save_html:
        page.select("html").write.mode("overwrite").parquet(save_html)
    found = to_dict(page_records(page, site, as_of, taxonomy)).head()
    return None if found is None else found.asDict(recursive=True)

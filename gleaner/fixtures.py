"""Views of the test tables in the shapes that the operators take, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import RUN
from gleaner.operators.classify import Taxonomy
from gleaner.sources.io import table

#: Stands for the clock in all queries.
NOW = "2024-02-01 00:00:00"

#: Words of the test texts.
TAXONOMY = Taxonomy.of(
    {
        "categories": [
            {"primary_niche": "english", "target_funnel": "west", "recommended_affiliate": "one", "keywords": ["the", "with", "worthless"]},
            {"primary_niche": "german", "target_funnel": "north", "recommended_affiliate": "two", "keywords": ["der", "nicht", "und"]},
            {"primary_niche": "french", "target_funnel": "south", "recommended_affiliate": "three", "keywords": ["le", "pour", "dans"]},
        ]
    }
)


def now():
    return F.lit(NOW).cast("timestamp")


def parsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed documents: lines as paragraphs, the language as a tag, the label as what is known of them."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = d.join(lab, "doc_id", "left")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/d/"), F.col("doc_id").cast("string"))
    return d.select(
        "doc_id",
        "source",
        url.alias("source_url"),
        url.alias("dedup_key"),
        F.when(F.col("quality").isNotNull(), url).alias("canonical_url"),
        F.when(F.col("lang") != "de", F.get(F.split("text", "\n"), F.lit(0))).alias("title"),
        F.when(F.col("quality") == 1, F.col("source")).alias("author_name"),
        F.when(F.col("quality") == 1, F.lit("2024-01-15")).alias("published_at"),
        F.when(F.col("lang") == "es", F.lit("ayer")).alias("published_at_raw"),
        F.when(F.col("lang") != "fr", F.array("lang", F.lit("Home"), F.concat(F.lit(" /"), F.col("source"), F.lit("; ")))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, RUN, " "))), lambda x: x != "").alias("body_paragraphs"),
        F.col("lang").alias("language"),
    )


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site over the ids of pages: each lists two others, a story of its own and one that seven share."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("i"))
    a = lambda path, text: F.concat(F.lit('<li><a href="'), path, F.lit('">'), text, F.lit("</a></li>"))
    s = lambda c: c.cast("string")
    i = F.col("i")
    html = F.concat(
        F.lit("<html><body><ul>"),
        a(F.concat(F.lit("/list/"), s(2 * i + 1)), F.lit("next")),
        a(F.concat(F.lit("/list/"), s(2 * i + 2), F.lit("?utm_source=x")), F.lit("after")),
        a(F.concat(F.lit("/story/"), s(i)), F.concat(F.lit(" Story  "), s(i))),
        a(F.concat(F.lit("/story/s"), s(i % 7), F.lit("#top")), F.concat(F.lit("Shared "), s(i % 7))),
        a(F.lit("https://elsewhere.example.net/story/1"), F.lit("off")),
        F.lit("</ul></body></html>"),
    )
    return p.select(F.concat(F.lit("https://site.example.org/list/"), s(i)).alias("url"), html.alias("html"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a work queue."""
    e = table(spark, sf_dir, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("dedup_key"),
        F.concat(F.lit("site"), (F.col("user_id") % 5).cast("string")).alias("source_site"),
        F.concat(F.lit("https://q.example.com/"), F.col("event_id").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("listing_url"),
        F.col("event_type").alias("hint_title"),
        F.when(F.col("event_type") == "error", F.lit("failed")).when(F.col("event_type") == "view", F.lit("done")).otherwise("pending").alias("state"),
        (F.col("event_id") % 4).cast("int").alias("attempts"),
        F.when(F.col("event_type") == "error", F.lit("timeout")).alias("last_error"),
        stamp.alias("discovered_at"),
        stamp.alias("updated_at"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as stories that are stored already."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    old = F.lit("2024-01-01T00:00:00+00:00")
    return d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("dedup_key"),
        F.col("source").alias("source_site"),
        F.col("lang").alias("title"),
        F.md5("text").alias("content_hash"),
        (F.col("doc_id") + 1).alias("id"),
        old.alias("first_seen_at"),
        old.alias("updated_at"),
        F.lit(1).alias("revision"),
    )


def story_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written once, and those of good quality once more with another text."""
    d = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    one = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("dedup_key"), F.col("source").alias("source_site"), F.col("lang").alias("title"), F.md5("text").alias("content_hash"), F.col("doc_id").alias("arrival"))
    two = d.join(good, "doc_id").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "source", F.lit(None).cast("string"), F.md5(F.concat("text", F.lit("!"))), F.col("doc_id") + 1_000_000_000_000)
    return one.union(two)

"""Sources of pages, and sinks of raw pages and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "url string, final_url string, status int, html string, from_cache boolean"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A page corpus: url and html, with defaults for what else a fetch gives."""
    df = spark.read.parquet(path)
    extra = {"final_url": F.col("url"), "status": F.lit(200), "from_cache": F.lit(False)}
    return df.withColumns({k: v for k, v in extra.items() if k not in df.columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_html(pages: DataFrame, path: str) -> None:
    """Raw pages by url. Text files split at line ends, so pages stay in a table."""
    pages.select("url", "html").write.mode("overwrite").parquet(path)


def write_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(records: DataFrame, path: str) -> None:
    """CSV has no lists: they become JSON texts."""
    flat = records.withColumns({c: F.to_json(c) for c, t in records.dtypes if t.startswith(("array", "map", "struct"))})
    flat.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)

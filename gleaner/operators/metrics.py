"""Counters, gauges and histograms as aggregations; log lines as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DURATIONS = [x / 2 for x in (1, 2, 4, 10, 20, 60, 120, 240, 600)]
CONFIDENCES = [x / 10 for x in range(11)]
LOG_KEYS = "timestamp level logger message module function line".split()


def counter(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("value"))


def gauge(df: DataFrame, labels: list[str], value: str, time: str) -> DataFrame:
    """The last value by time; the greatest of several at that time."""
    return df.groupBy(*labels).agg(F.max_by(value, F.struct(time, value)).alias("value"))


def histogram(df: DataFrame, labels: list[str], value: str, buckets: list[float]) -> DataFrame:
    """Cumulative buckets (labels, le, count), with +Inf, total_sum and total_count beside each. One shuffle of partial counts.

    NULL values are left out.
    """
    v = F.col(value)
    sums = [F.count_if(v <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(buckets)]
    g = df.where(v.isNotNull()).groupBy(*labels).agg(*sums, F.count(v).alias("total_count"), F.sum(v).alias("total_sum"))
    rows = [F.struct(F.lit(f"{float(b):g}").alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("total_count").alias("count")))
    return g.select(*labels, F.explode(F.array(*rows)).alias("_b"), "total_sum", "total_count").select(*labels, "_b.*", "total_sum", "total_count")


def timed(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("duration", F.col(end).cast("double") - F.col(start).cast("double"))


def log_json(df: DataFrame, extra: list[str] | None = None) -> Column:
    """A log line as JSON: the usual keys that `df` has, then `extra`; NULLs are left out."""
    keys = [k for k in LOG_KEYS if k in df.columns] + list(extra or [])
    return F.to_json(F.struct(*keys))

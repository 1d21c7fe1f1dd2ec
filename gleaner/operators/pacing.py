"""Request times under a minimum interval, and penalties of hosts after failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVAL, JITTER, MOST = 2.0, 0.6, 60.0


def schedule(requests: DataFrame, host: str, asked: str, interval: float = INTERVAL, tie: str | None = None) -> DataFrame:
    """`requests` with sent and delay: each is sent when asked, but at least `interval` seconds after the one before.

    `asked` is in seconds. The recurrence has a closed form, a running maximum, so one window by host does it.
    """
    w = Window.partitionBy(host).orderBy(*([asked, tie] if tie else [asked]))
    n = F.row_number().over(w) * F.lit(float(interval))
    df = requests.withColumn("_n", n)
    top = F.max(F.col(asked) - F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("sent", top + F.col("_n"))
    return df.withColumn("delay", F.col("sent") - F.col(asked)).drop("_n")


def _step(outcome: Column, seconds: Column, most: float) -> Column:
    """A step as x -> least(hi, greatest(lo, a x + b)); such functions are closed under composition."""
    far = 1e18
    bad = outcome == "penalize"
    good = outcome == "relax"
    return F.struct(
        F.when(good, F.lit(0.6)).otherwise(F.lit(1.0)).alias("a"),
        F.when(bad, seconds).when(good, F.lit(-0.25)).otherwise(F.lit(0.0)).alias("b"),
        F.when(good, F.lit(0.0)).otherwise(F.lit(-far)).alias("lo"),
        F.when(bad, F.lit(float(most))).otherwise(F.lit(far)).alias("hi"),
    )


def _then(f: Column, g: Column) -> Column:
    """g after f."""
    clamp = lambda x: F.least(g["hi"], F.greatest(g["lo"], g["a"] * x + g["b"]))
    return F.struct((g["a"] * f["a"]).alias("a"), (g["a"] * f["b"] + g["b"]).alias("b"), clamp(f["lo"]).alias("lo"), clamp(f["hi"]).alias("hi"))


def _fold(steps: Column) -> Column:
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(-1e18).alias("lo"), F.lit(1e18).alias("hi"))
    return F.aggregate(steps, start, _then)


def penalties(outcomes: DataFrame, host: str, time: str, outcome: str, seconds: Column | float = 5.0, most: float = MOST, chunk: str = "day") -> DataFrame:
    """(host, penalty): seconds added per request after all outcomes in order of `time`, from none at the start.

    "penalize" adds `seconds` up to `most`; "relax" takes 0.6 of it less 0.25, not under 0; others change nothing.
    The steps of a `chunk` of time are composed first, the chunks of a host after, so no task holds a busy host whole.
    """
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    step = _step(F.col(outcome), s, most)
    rows = outcomes.select(F.col(host).alias("host"), F.date_trunc(chunk, F.col(time)).alias("_c"), F.struct(F.col(time).alias("t"), step.alias("s")).alias("_s"))
    part = rows.groupBy("host", "_c").agg(F.array_sort(F.collect_list("_s")).alias("_l"))
    part = part.select("host", "_c", _fold(F.transform("_l", lambda x: x["s"])).alias("_f"))
    whole = part.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("_c", "_f"))).alias("_l"))
    f = _fold(F.transform("_l", lambda x: x["_f"]))
    return whole.select("host", f.alias("_f")).select("host", F.least(F.col("_f.hi"), F.greatest(F.col("_f.lo"), F.col("_f.b"))).alias("penalty"))


def retry_wait(attempt: Column) -> Column:
    """Seconds before the next attempt."""
    return F.pow(F.lit(2.0), attempt)

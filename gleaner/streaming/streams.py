"""The same semantics over streams: dedup, keyed upsert with replay, penalties as state, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gleaner.operators.pacing import MOST
from gleaner.operators.store import merged

#: Calls of Python a micro-batch, and rows of state; a row has its share of all keys.
BUCKETS = 256


def dedup(stream: DataFrame, keys: list[str], time: str, within: str = "1 hour") -> DataFrame:
    """Each key once, as far as its repeats come within the watermark; unbounded dedup needs `Store`."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, labels: list[str], length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per tumbling window (an extension)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *labels).agg(F.count("*").alias("n"))


def _bucket(key: str) -> Column:
    """Keys share a call of Python and a row of state by BUCKETS of them: a call for each key costs more than what it does."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("_b")


def host_penalties(stream: DataFrame, host: str, time: str, outcome: str, seconds: float = 5.0, most: float = MOST) -> DataFrame:
    """(host, penalty) after each micro-batch; outcomes are applied in order of time within a batch."""

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values([time, outcome], kind="stable")
        for h, x in zip(rows["_key"], rows[outcome]):
            p = now.get(h, 0.0)
            now[h] = min(most, p + seconds) if x == "penalize" else max(0.0, p * 0.6 - 0.25) if x == "relax" and p > 0 else p
        state.update((list(now), list(now.values())))
        met = rows["_key"].unique().tolist()
        yield pd.DataFrame({"host": pd.Series(met, dtype=object), "penalty": [now[h] for h in met]})

    rows = stream.select(F.col(host).cast("string").alias("_key"), time, outcome).select("*", _bucket("_key"))
    return rows.groupBy("_b").applyInPandasWithState(run, "host string, penalty double", "hosts array<string>, penalties array<double>", "update", GroupStateTimeout.NoTimeout)


def queue_states(stream: DataFrame, order: str, max_attempts: int = 3) -> DataFrame:
    """The work queue as keyed state. In: dedup_key, action ("found" or "mark"), state, error, bump, and an order within a micro-batch.

    A key that is found the first time is pending; later finds change nothing. A mark puts its state and error (NULL too) on a known key
    and counts an attempt where `bump` says so; unknown keys are ignored. Out: each key that a micro-batch touched, as it is
    then, with due: whether it is still to be done.
    """

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = {k: v for k, *v in zip(*state.get)} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        for k, action, to, error, bump in zip(*(rows[c] for c in ("dedup_key", "action", "state", "error", "bump"))):
            if action == "found":
                now.setdefault(k, ("pending", 0, None))
            elif k in now:
                now[k] = to, now[k][1] + int(bool(bump)), error
        if now:
            state.update((list(now), *map(list, zip(*now.values()))))
            met = [k for k in rows["dedup_key"].unique().tolist() if k in now]
            out = pd.DataFrame([(k, *now[k]) for k in met], columns=["dedup_key", "state", "attempts", "last_error"], dtype=object)
            yield out.assign(due=[now[k][0] == "pending" and now[k][1] < max_attempts for k in met])

    rows = stream.select("dedup_key", "action", "state", "error", "bump", order, _bucket("dedup_key"))
    kept = "dedup_keys array<string>, states array<string>, attempts array<int>, last_errors array<string>"
    return rows.groupBy("_b").applyInPandasWithState(run, "dedup_key string, state string, attempts int, last_error string, due boolean", kept, "update", GroupStateTimeout.NoTimeout)


class Store:
    """Stories as versions of a table, one folder per micro-batch, the last complete one is current.

    A replayed batch writes its own version again from the version before, so it changes nothing. Old versions can be
    dropped once no reader has them. The folder must be one that all executors share.
    """

    def __init__(self, spark: SparkSession, path: str, empty: DataFrame, order: str, as_of: Callable[[int], Column]):
        self.spark, self.path, self.empty, self.order, self.as_of = spark, path.rstrip("/"), empty, order, as_of

    def versions(self) -> list[int]:
        """Complete versions, by the marks that the committer leaves."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        glob = jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")
        found = glob.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(glob)
        return sorted(int(x.getPath().getParent().getName()[2:]) for x in found or [])

    def current(self, before: int | None = None) -> DataFrame:
        old = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(self.empty.schema).parquet(f"{self.path}/v={old[-1]}") if old else self.empty

    def write(self, batch: DataFrame, batch_id: int) -> None:
        rows = merged(self.current(batch_id), batch, self.order, self.as_of(batch_id)).drop("outcome", "content_changed")
        rows.select(*self.empty.columns).write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

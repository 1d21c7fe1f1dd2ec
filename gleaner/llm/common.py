"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources import shared
from gleaner.sources.shared import fresh_path as fresh_path  # noqa: PLC0414
from gleaner.sources.shared import release as release  # noqa: PLC0414

#: Rows of a side that may be broadcast: a count is taken before, and beyond it another plan is used.
BROADCAST_ROWS = 1 << 20
#: Parts of a key that may be hot, where the other side is too large to broadcast.
SALTS = 64
#: Bits of the largest filter, 32 MB; up to 22 million ids it lets through one row in a hundred by mistake, beyond more.
FILTER_BITS = 1 << 28
FILTER_HASHES = 4


_open = threading.local()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """See shared.materialize; within `scratch`, the table is deleted at its end, unless it is `lasting`."""
    out = shared.materialize(df, tag)
    if levels := getattr(_open, "levels", None):
        levels[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables materialized within, at its end. Nothing lazy that reads them may leave it.

    Spark deletes the shuffle files of jobs whose plans are garbage: both collectors are told to look.
    """
    spark = SparkSession.active()
    _open.levels = [*getattr(_open, "levels", []), []]
    try:
        yield
    finally:
        for df in _open.levels.pop():
            release(df)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


@contextmanager
def tables_made() -> Iterator[list[DataFrame]]:
    """The tables materialized within, for who knows when they are done with."""
    made: list[DataFrame] = []
    _open.levels = [*getattr(_open, "levels", []), made]
    try:
        yield made
    finally:
        _open.levels.pop()


def lasting(df: DataFrame) -> DataFrame:
    """A table of this `scratch` that outlasts it."""
    if levels := getattr(_open, "levels", None):
        levels[-1].remove(df)
        if len(levels) > 1:
            levels[-2].append(df)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text) -> F.Column:
    """Words of a text, split at blanks and line ends; NULL text has none."""
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def looked_up(big: DataFrame, side: DataFrame, on: list[str], by: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """`big` with the columns of `side`, a written table of one row for each key.

    `side` is counted. Up to `most` rows it is broadcast, so that no row of `big` moves; beyond that, both are
    shuffled by the key and a salt made of the column `by`, so that a hot key is SALTS tasks.
    """
    if side.count() <= most:
        return big.join(F.broadcast(side), on, how)
    spread = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(spread, [*on, "_salt"], how).drop("_salt")


class IdFilter:
    """A Bloom filter over 64-bit hashes, of a size that is known beforehand."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def size(n: int, most: int = FILTER_BITS) -> int:
        return min(most, max(1 << 10, 1 << (12 * n - 1).bit_length()))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may be in: False is certain."""
        h = h.view(np.uint64)
        mask = np.uint64(len(self.words) * 64 - 1)
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        out = np.ones(len(h), bool)
        for k in range(FILTER_HASHES):
            at = low + np.uint64(k) * high & mask
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def id_hash(c) -> Column:
    return F.xxhash64(c.cast("bigint"))


def id_filter(ids: DataFrame, most: int = FILTER_BITS, hashed: bool = False) -> IdFilter:
    """Of a written table of one column of ids, or of hashes of 64 bits (`hashed`). Bits are put together by words in the cluster; the driver gets the words, 32 MB at most."""
    (name,) = ids.columns
    bits = IdFilter.size(ids.count(), most)
    h = ids.select((F.col(name) if hashed else id_hash(F.col(name))).alias("h")).select(F.col("h").bitwiseAND(0xFFFFFFFF).alias("l"), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1)).alias("u"))
    at = h.select(F.explode(F.array(*((F.col("l") + k * F.col("u")).bitwiseAND(bits - 1) for k in range(FILTER_HASHES)))).alias("p"))
    found = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    if found.num_rows:
        words[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return IdFilter(words.view(np.uint64))


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """`docs` without the rows whose `key` is in `gone`, a written table of one column of distinct ids.

    Rows that a filter of the ids shows to stay are not shuffled; those that may go meet `gone` itself, so the result is exact.
    Rows with a NULL key stay.
    """
    held = docs.sparkSession.sparkContext.broadcast(id_filter(gone))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(held.value.maybe(h.to_numpy(np.int64)))

    (name,) = gone.columns
    may = F.col(key).isNotNull() & maybe(id_hash(F.col(key)))
    kept = docs.where(~may)
    return kept.union(docs.where(may).join(gone, docs[key].cast("bigint") == gone[name], "left_anti"))


def sliced(batches, n: int):
    """Record batches of at most n rows."""
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


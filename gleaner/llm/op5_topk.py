"""Exact top-k search by Fagin's threshold algorithm: a set of queries against all vectors.

Vectors are scaled to length 1 (cosine), and stay where they are read: a task takes its vectors in blocks. A block is
turned to its principal axes, which changes no product but puts what its vectors share into few dimensions, and is
sorted by each of them. Lists are read from both ends, to ever greater depth; what is met for the first time is
scored. The bound on what is unread is the largest product with a vector of length 1 whose values don't pass those at
the present depth, in each dimension. A query whose k-th score the bound can't beat is done with the block; its k-th
score goes along from block to block, so that a block may be done before any of it is scored. All queries of a block
are treated at once, as products of matrices. The k best of each task are merged by a window.

Queries are sent to the tasks ASKED at a time, a size that doesn't grow with the data; each such chunk is a job that reads
the vectors once, and only results are shuffled. The work is that of queries times vectors in the worst case: vectors
without structure in many dimensions (see README for depths measured) give the bound nothing to stop at.

Scores are compared after rounding to 6 digits, equal ones by vec_id. Defined results: vectors that are NULL, hold a NULL or
NaN or infinity, or have length 0, and those with a NULL vec_id, neither ask nor answer. Rows with the same vec_id are
one vector (the least array). A vector isn't its own neighbour; only vectors of as many dimensions compare. With
fewer than k others, all of them are given. An empty table, or no query, gives no rows. Other columns, of whatever names,
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.llm.common import materialize, table

K = 10
BLOCK = 16_384
#: Queries that are sent at a time.
ASKED = 65_536
#: Queries of the registered query: ids divisible by this.
EACH = 50
#: The first depth, and by how much it grows.
STEP, GROWTH = 8, 4
#: Scores held at a time.
TILE = 1 << 22
DIGITS = 6


def vectors(df: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, unit vector in doubles, dimensions."""
    e = F.col("e")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    clean = df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    one = clean.groupBy("vec_id").agg(F.min("e").alias("e")).withColumn("norm", norm)
    fine = one.where((F.col("norm") > 0) & ~F.isnan("norm") & (F.col("norm") < float("inf")))
    return fine.select("vec_id", F.transform(e, lambda x: x / F.col("norm")).alias("e"), F.size("e").alias("dims"))


class Best:
    """The k best of each query so far: scores descending, equal ones by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def take(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Adds a matrix of scores: queries `who` by vectors `ids`, none of which they had before."""
        least = self.scores[who, -1]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        q, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(q):
            return
        some, q = np.unique(q, return_inverse=True)
        rows = who[some]
        all_q = np.concatenate([np.repeat(np.arange(len(rows)), self.k), q])
        all_s = np.concatenate([self.scores[rows].ravel(), scores[some[q], at]])
        all_i = np.concatenate([self.ids[rows].ravel(), ids[at]])
        order = np.lexsort((all_i, -all_s, all_q))
        first = np.searchsorted(all_q[order], np.arange(len(rows)))
        keep = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.scores[rows] = all_s[keep].reshape(-1, self.k)
        self.ids[rows] = all_i[keep].reshape(-1, self.k)


def bound(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No less than the largest product of each query with a vector of length 1 within [low, high].

    For any m > 0, m / 2 + the sum of max(q x - m x^2 / 2) over x in [low, high] is such a bound; the least of several is taken.
    """
    best = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low
    length = np.linalg.norm(q, axis=1, keepdims=True)
    for m in 2.0 ** np.arange(-4, 3.0):
        x = np.clip(q / (m * length), low, high)
        best = np.minimum(best, m * length[:, 0] / 2 + (q * x - m * length / 2 * x * x).sum(1))
    return best


class Lists:
    """A block of vectors with a sorted list for each of its principal axes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
        self.ids, self.x = ids, x @ self.axes
        self.order = np.argsort(self.x, axis=0)
        self.sorted = np.take_along_axis(self.x, self.order, axis=0)

    def search(self, me: np.ndarray, queries: np.ndarray, best: Best) -> np.ndarray:
        """Brings `best` up to date; the depth that was read for each query, 0 where the bound excluded the whole block."""
        n, q = len(self.ids), queries @ self.axes
        seen, depths = np.zeros(n, bool), np.zeros(len(q), np.int64)
        todo, depth = np.arange(len(q)), 0
        while len(todo) and depth < n:
            low, high = self.sorted[max(depth - 1, 0)], self.sorted[n - max(depth, 1)]
            todo = todo[bound(q[todo], low, high) >= best.scores[todo, -1] - 10.0**-DIGITS]
            depth = min(n, max(STEP, depth * GROWTH))
            met = np.zeros(n, bool)
            met[self.order[:depth].ravel()] = True
            met[self.order[n - depth :].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            depths[todo] = depth
            step = max(1, TILE // max(1, len(new)))
            for a in range(0, len(todo) if len(new) else 0, step):
                who = todo[a : a + step]
                scores = np.round(q[who] @ self.x[new].T, DIGITS) + 0.0
                own, at = np.nonzero(me[who][:, None] == self.ids[new]) if len(who) * len(new) < 1 << 16 else _own(me[who], self.ids[new])
                scores[own, at] = -np.inf
                best.take(who, self.ids[new], scores)
            if seen.all():
                break
        return depths


def _own(me: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids)
    at = np.minimum(np.searchsorted(ids[order], me), len(ids) - 1)
    found = np.flatnonzero(ids[order[at]] == me)
    return found, order[at[found]]


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of as many dimensions each, of about `block` rows."""
    held: dict[int, list] = {}
    for b in batches:
        dims = b.column(2).to_numpy()
        for d in np.unique(dims).tolist():
            own = b.filter(pa.array(dims == d))
            held.setdefault(d, []).append((own.column(0).to_numpy(), own.column(1).flatten().to_numpy().reshape(-1, d)))
            if sum(len(i) for i, _ in held[d]) >= block:
                yield tuple(map(np.concatenate, zip(*held.pop(d))))
    for parts in held.values():
        yield tuple(map(np.concatenate, zip(*parts)))


def _answers(base: DataFrame, asked: pa.Table, k: int, block: int) -> DataFrame:
    """The k best of each task for the queries, which are sent along."""
    shared = base.sparkSession.sparkContext.broadcast({d: (i, x) for i, x in _blocks(iter(asked.combine_chunks().to_batches()), 1 << 62) for d in [x.shape[1]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for ids, x in _blocks(batches, block):
            if x.shape[1] not in shared.value:
                continue
            me, q = shared.value[x.shape[1]]
            Lists(ids, x).search(me, q, best.setdefault(x.shape[1], Best(len(me), k)))
        for d, b in best.items():
            for a in range(0, len(b.scores), 1 << 13):
                scores, ids = b.scores[a : a + (1 << 13)], b.ids[a : a + (1 << 13)]
                has = np.isfinite(scores)
                me = np.repeat(shared.value[d][0][a : a + (1 << 13)], has.sum(1))
                yield pa.RecordBatch.from_arrays([pa.array(me), pa.array(ids[has]), pa.array(scores[has])], ["vec_id", "neighbour", "score"])

    return base.mapInArrow(run, "vec_id bigint, neighbour bigint, score double")


def top_k(df: DataFrame, queries: Column | None = None, k: int = K, block: int = BLOCK, asked: int = ASKED, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, rank, neighbour, score, for the vectors of which `queries`, a condition on vec_id, holds (all, without one)."""
    base = materialize(vectors(df, key, column), "vectors")
    asks = base if queries is None else base.where(queries)
    chunks = max(1, -(-asks.count() // asked))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(chunks))
    found = []
    for i in range(chunks):
        answers = _answers(base, asks.where(own == i).toArrow(), k, block)
        w = Window.partitionBy("vec_id").orderBy(F.desc("score"), "neighbour")
        best = answers.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("vec_id", "rank", "neighbour", "score")
        found.append(best if chunks == 1 else materialize(best, "answers"))
    return reduce(DataFrame.union, found)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by EACH asks all vectors."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EACH == 0)


SQL = f"""
WITH b AS (SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
 u AS (SELECT vec_id, e, len(e) AS dims FROM b),
 s AS (SELECT a.vec_id, z.vec_id AS neighbour, round(list_cosine_similarity(a.e, z.e), {DIGITS}) + 0.0 AS score FROM u a JOIN u z ON a.dims = z.dims AND a.vec_id <> z.vec_id WHERE a.vec_id % {EACH} = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, neighbour) AS rank FROM s)
SELECT vec_id, rank::INT AS rank, neighbour, score FROM r WHERE rank <= {K}
"""

"""Near duplicates: Jaccard join of word n-gram sets by chosen paths.

Every document is the set of its word N-grams. Documents of equal sets form a class with one representative (the least
doc_id). Representatives are embedded by WIDTH minhashes of 8 bits, whose tokens are (coordinate, value). In
each of several runs a document starts at a root and, at each level, follows every token of its own that the node's
hash samples with probability 1 / (THRESHOLD * WIDTH): a pair of similarity at or over THRESHOLD shares a child node
in expectation at every level. Nodes of level START are found without a shuffle and shuffled by node, as (node,
document) only. Nodes of one document end there; the others get their sketches and are split further in the
task that holds them, until a bucket is small, LEVELS is reached or the bucket is dense (its mean similarity is
over the threshold, so that splitting can't help); then all its pairs are compared by sketch, in tiles. A bucket of
more than LOCAL documents is never brought together: its documents find their children row by row and are shuffled by
these, level by level. The buckets of one least document are told in one task; if they hold more than TOGETHER documents, pairs of
blocks of these are the tasks, and where buckets repeat one another all pairs of a block are compared once, so a task's
memory does not grow with its group. RUNS follows from the survival probability of a pair at the threshold down to LEVELS and the target recall.

Surviving candidates are verified on whole texts: a filter of their ids keeps other texts from being shuffled;
documents with a least partner in common meet in one task, each with its set once (more than TOGETHER of them
as pairs of blocks; the pairs of a large group by rows of bits), and the exact Jaccard of every candidate pair decides. No cap is set on
partners or candidates.

Result of the query: one row for each document, with class_id, the least doc_id of the group of documents that links
connect, and n_links, the number of other documents at or over THRESHOLD. Links between representatives count with the
sizes of their classes, so copies aren't expanded into pairs. `near_pairs` gives the pairs themselves in a compact form:
all between representatives, and each other member of a class with its representative at 1.0.

Defined results: NULL and empty texts are linked to nothing; NULL doc_ids have no row. A text of fewer than N words has one
n-gram, all its words. Very long texts count whole. A pair of exactly THRESHOLD is one. Of equal sets the least doc_id
represents. Rows of one doc_id are one document; if their texts differ, the best pair counts, and the document is compared
as itself, in no class; its equals are paired with it once. An empty table has no pairs. Columns but doc_id and text,
of whatever names, aren't read by the join; the stage keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from gleaner.llm.common import id_filter, id_hash, lasting, looked_up, materialize, release, scratch, sliced, table, without
from gleaner.llm.ngrams import minhash, mix, shingles

N = 3
THRESHOLD = 0.6
WIDTH = 64
START = 3
LEVELS = 7
SMALL = 64
RECALL = 0.97
#: Standard errors of the sketch's estimate that a candidate may lie under the threshold.
SLACK = 3.0
PART = 1000
#: Rows of a bucket that one task may split further; larger ones are split by many tasks.
LOCAL = 16_384
#: Documents that are compared or verified together; more are so by pairs of blocks.
TOGETHER = 1024
#: Pairs of a task from which they are verified by bits, and that wait for it at most.
MANY = 64
WAIT = 1 << 18
#: Nodes that are counted at a time.
OFTEN = 1 << 20


def least_matches(threshold: float) -> int:
    """Equal coordinates that a candidate needs."""
    j = threshold + (1 - threshold) / 256
    return math.floor(WIDTH * j - SLACK * math.sqrt(WIDTH * j * (1 - j)))


def survival(matches: int, levels: int) -> float:
    """Probability that a pair at the threshold with so many equal coordinates still shares a node."""
    p = 1.0
    for _ in range(levels):
        p = 1 - (1 - p / (THRESHOLD * WIDTH)) ** matches
    return p


def recall_of(runs: int, levels: int) -> float:
    """Expected recall of pairs at the threshold that must survive so many levels, over the spread of their equal coordinates."""
    j = THRESHOLD + (1 - THRESHOLD) / 256
    return sum(math.comb(WIDTH, m) * j**m * (1 - j) ** (WIDTH - m) * (1 - (1 - survival(m, levels)) ** runs) for m in range(least_matches(THRESHOLD), WIDTH + 1))


def runs_for(recall: float, levels: int) -> int:
    return next(r for r in range(1, 1000) if recall_of(r, levels) >= recall)


#: For the deepest level: a pair whose common tokens are those of a large bucket is compared there and no sooner.
RUNS = runs_for(RECALL, LEVELS)


def sketches(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, key of the set, sketch; documents with an empty set have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PART):
                p = b.slice(at, PART)
                sets, sizes = shingles(p.column(1), n)
                if not len(sets):
                    continue
                sketch = (minhash(sets, sizes, WIDTH) & 255).astype(np.uint8)
                full = np.flatnonzero(sizes)
                ends = np.cumsum(sizes)
                keys = [xxhash.xxh3_128_digest(sets[ends[i] - sizes[i] : ends[i]].tobytes()) for i in full]
                rows = pa.array([s.tobytes() for s in sketch[full]], pa.binary())
                yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(full)), pa.array(keys, pa.binary()), rows], ["doc_id", "set_key", "sketch"])

    clean = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null and text <> ''")
    return clean.mapInArrow(run, "doc_id bigint, set_key binary, sketch binary")


def children(nodes: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each (node, sketch row): the row numbers and node hashes of the children."""
    # a run and level are part of the node's hash, so each node samples tokens anew
    coordinate = np.arange(sketch.shape[1], dtype=np.uint64) << np.uint64(8)
    rows, found = [], []
    limit = np.uint64(int(2**64 / (threshold * WIDTH)))
    for a in range(0, len(nodes), 1 << 14):
        h = mix(mix(nodes[a : a + (1 << 14), None]) ^ mix(coordinate[None] + sketch[a : a + (1 << 14)] + np.uint64(1)))
        r, c = np.nonzero(h < limit)
        rows.append(r + a)
        found.append(mix(h[r, c] + np.uint64(0x632BE59BD9B4E019)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(found)


def nodes(reps: DataFrame, threshold: float, levels: int, runs: int) -> DataFrame:
    """(node, doc_id) at the first level that is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4000):
                p = b.slice(at, 4000)
                sketch = _matrix(p.column(1))
                row = np.tile(np.arange(p.num_rows), runs)
                node = np.repeat(mix(np.arange(1, runs + 1, dtype=np.uint64)), p.num_rows)
                for _ in range(levels):
                    took, node = children(node, sketch[row], threshold)
                    row = row[took]
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), p.column(0).take(pa.array(row))], ["node", "doc_id"])

    return reps.select("doc_id", "sketch").mapInArrow(run, "node bigint, doc_id bigint")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def compared(sketch: np.ndarray, rows: np.ndarray, least: int, side: np.ndarray | None = None, tile: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of `rows` with so many equal coordinates, a tile at a time; where sides are given, only those of a row of either side."""
    left, right = (rows, rows) if side is None else (rows[side[rows] == 0], rows[side[rows] == 1])
    for a in range(0, len(left), tile):
        for b in range(a if side is None else 0, len(right), tile):
            x, y = sketch[left[a : a + tile]], sketch[right[b : b + tile]]
            same = np.zeros((len(x), len(y)), np.uint8)
            for c in range(sketch.shape[1]):
                same += x[:, c, None] == y[None, :, c]
            i, j = np.nonzero(same >= least)
            if side is None:
                i, j = (k[i + a < j + b] for k in (i, j))
            yield left[i + a], right[j + b]


def compare(sketch: np.ndarray, least: int, tile: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows with so many equal coordinates."""
    left, right = zip(*compared(sketch, np.arange(len(sketch)), least, tile=tile))
    return np.concatenate(left), np.concatenate(right)


def density(sketch: np.ndarray) -> float:
    """Mean share of equal coordinates of the pairs of a bucket."""
    m = len(sketch)
    same = sum(float((np.bincount(sketch[:, c], minlength=256).astype(float) ** 2).sum()) - m for c in range(sketch.shape[1]))
    return same / (sketch.shape[1] * m * (m - 1))


def whole(sketch: np.ndarray, depth: int, threshold: float, small: int, levels: int) -> bool:
    """Whether a bucket is compared as it is."""
    return len(sketch) <= small or depth >= levels or density(sketch) >= threshold


def split(
    node: np.uint64, sketch: np.ndarray, level: int, threshold: float, small: int, levels: int, least: int, side: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a bucket, recursively."""
    todo = [(node, np.arange(len(sketch)), level)]
    while todo:
        at, rows, depth = todo.pop()
        if whole(sketch[rows], depth, threshold, small, levels):
            yield from compared(sketch, rows, least, side)
            continue
        took, below = children(np.full(len(rows), at), sketch[rows], threshold)
        order = np.argsort(below, kind="stable")
        below, took = below[order], took[order]
        cuts = [0, *(np.flatnonzero(below[1:] != below[:-1]) + 1).tolist(), len(below)]
        todo += [(below[a], rows[took[a:z]], depth + 1) for a, z in zip(cuts, cuts[1:]) if z - a > 1]


def candidates(
    reps: DataFrame, threshold: float = THRESHOLD, start: int = START, levels: int = LEVELS, small: int = SMALL, runs: int = RUNS, local: int = LOCAL, together: int = TOGETHER
) -> DataFrame:
    """Pairs a < b of representatives that share a bucket and whose sketches agree enough."""
    sketch = reps.select("doc_id", "sketch")
    found, level, ready = materialize(nodes(reps, threshold, start, runs), "nodes"), start, []
    while True:
        large = materialize(_often(found).groupBy("node").agg(F.sum("m").alias("m")).where(F.col("m") > local), "large")
        none = large.isEmpty()
        here = found if none else looked_up(found, large.select("node"), ["node"], "doc_id", "left_anti")
        own = Window.partitionBy("node")
        shared = here.withColumns({"m": F.count(F.lit(1)).over(own), "anchor": F.min("doc_id").over(own)}).where("m > 1")
        ready.append(shared.select("anchor", "node", "doc_id", F.lit(level).alias("level")))
        if none:
            break
        held = looked_up(found, large.select("node"), ["node"], "doc_id")
        if level >= levels:
            first = materialize(held.groupBy("node").agg(F.min("doc_id").alias("anchor")), "anchors")
            ready.append(looked_up(held, first, ["node"], "doc_id").select("anchor", "node", "doc_id", F.lit(levels).alias("level")))
            break
        found, level = materialize(_below(held.join(sketch, "doc_id").select("node", "doc_id", "sketch"), threshold), "nodes"), level + 1
    # nodes go where their least document's others are: there a pair that several runs found is told once, and a sketch is sent once
    lists = reduce(DataFrame.union, ready).repartition("doc_id").groupBy("doc_id", "anchor").agg(F.collect_list("node").alias("nodes"), F.collect_list("level").alias("levels"))
    met = _blocks(materialize(lists, "lists"), together).join(sketch, "doc_id").select("unit", "doc_id", "sketch", "nodes", "levels", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = Told()
        for t in _groups(sliced(batches, PART)):
            for a, b in _met(t, threshold, small, levels, least_matches(threshold)):
                yield from told.add(a, b)
        yield from told.rest()

    return met.repartition("unit").sortWithinPartitions("unit", "doc_id").mapInArrow(run, "a bigint, b bigint").distinct()


def _blocks(lists: DataFrame, together: int) -> DataFrame:
    """The documents of each anchor (a written table) with the task, `unit`, that tells their pairs.

    More than `together` documents are blocks: each goes to the units of its block with itself and with each other one. There `side` says
    which of the two blocks it is of, and only pairs of both are told; elsewhere it is NULL.
    """
    large = materialize(lists.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > together), "crowds")
    alone = (F.xxhash64("anchor").alias("unit"), "doc_id", "nodes", "levels", F.lit(None).cast("int").alias("side"))
    if large.isEmpty():
        return lists.select(*alone)
    n = F.ceil(F.coalesce("m", F.lit(1)) / together)
    own = looked_up(lists, large, ["anchor"], "doc_id", "left").withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("n")))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    unit = F.when(F.col("n") == 1, F.xxhash64("anchor")).otherwise(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") != F.col("other"), (F.col("own") > F.col("other")).cast("int"))
    return each.select(unit.alias("unit"), "doc_id", "nodes", "levels", side.alias("side"))


class Told:
    """Pairs (a, b) as batches, with a bounded number held to leave out those told before."""

    def __init__(self, most: int = 1 << 20):
        self.most, self.held, self.n = most, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(a):
            self.held.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            self.n += len(a)
        if self.n > self.most:
            p = self._once()
            # what is mostly repeated is held on
            if p.shape[1] > self.most // 2:
                yield from self.rest()
            else:
                self.held, self.n = [p], p.shape[1]

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            p = self._once()
            self.held, self.n = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])

    def _once(self) -> np.ndarray:
        p = np.concatenate(self.held, 1)
        self.held = [p]
        p = p[:, np.lexsort(p[::-1])]
        return p[:, np.concatenate([[True], (p[:, 1:] != p[:, :-1]).any(0)])]


def _met(t: pa.Table, threshold: float, small: int, levels: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents of whole units that share a bucket and whose sketches agree enough; some more than once.

    Where the buckets of a unit that are compared as they are have more pairs than the unit has, all pairs of the unit are compared, once.
    """
    unit, docs = (t.column(c).to_numpy() for c in ("unit", "doc_id"))
    sketch = _matrix(t.column("sketch").combine_chunks())
    side = t.column("side").combine_chunks().fill_null(2).to_numpy(zero_copy_only=False)
    lists = t.column("nodes").combine_chunks()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    node = lists.flatten().to_numpy().view(np.uint64)
    depth = t.column("levels").combine_chunks().flatten().to_numpy()
    # a node may be in several units
    place = np.cumsum(np.concatenate([[0], unit[1:] != unit[:-1]]))
    order = np.lexsort((node, place[row]))
    node, row, depth = node[order], row[order], depth[order]
    at = place[row]
    cut = np.concatenate([[0], np.flatnonzero((node[1:] != node[:-1]) | (at[1:] != at[:-1])) + 1, [len(node)]])
    size, of = np.diff(cut), at[cut[:-1]]
    firsts, members = np.unique(place, return_index=True)[1], np.bincount(place)
    done = np.zeros(len(members), bool)
    for u in np.flatnonzero(members > small):
        own = np.flatnonzero((of == u) & (size > 1))
        as_is = sum(size[k] * (size[k] - 1) // 2 for k in own if whole(sketch[row[cut[k] : cut[k + 1]]], int(depth[cut[k]]), threshold, small, levels))
        if as_is >= members[u] * (members[u] - 1) // 2:
            done[u] = True
            rows = np.arange(firsts[u], firsts[u] + members[u])
            for i, j in compared(sketch, rows, least, side if side[rows[0]] < 2 else None):
                yield docs[i], docs[j]
    left = ~done[of]
    for m in np.unique(size[(size > 1) & (size <= small) & left]):
        first = cut[:-1][(size == m) & left]
        i, j = np.triu_indices(m, 1)
        step = max(1, 200_000 // len(i))
        for a in range(0, len(first), step):
            f = first[a : a + step, None]
            x, y = row[(f + i).ravel()], row[(f + j).ravel()]
            if (apart := (side[x] == 2) | (side[x] != side[y])).sum() < len(x):
                x, y = x[apart], y[apart]
            good = (sketch[x] == sketch[y]).sum(1) >= least
            yield docs[x[good]], docs[y[good]]
    for k in np.flatnonzero((size > small) & left):
        rows = row[cut[k] : cut[k + 1]]
        for i, j in split(node[cut[k]], sketch[rows], int(depth[cut[k]]), threshold, small, levels, least, side[rows] if side[rows[0]] < 2 else None):
            yield docs[rows[i]], docs[rows[j]]


def _often(found: DataFrame) -> DataFrame:
    """Counts of nodes, OFTEN rows at a time, without those that are there once: what is left out of a node's count is a document of so many rows."""

    def counted(nodes: list[np.ndarray]) -> pa.RecordBatch:
        node, m = np.unique(np.concatenate(nodes), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(node[m > 1]), pa.array(m[m > 1])], ["node", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b.column(0).to_numpy().copy())
            n += b.num_rows
            if n >= OFTEN:
                yield counted(held)
                held, n = [], 0
        if n:
            yield counted(held)

    return found.select("node").mapInArrow(run, "node bigint, m bigint")


def _below(held: DataFrame, threshold: float) -> DataFrame:
    """The children of (node, doc_id, sketch), row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1 << 14):
            took, below = children(b.column(0).to_numpy().view(np.uint64), _matrix(b.column(2)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), b.column(1).take(pa.array(took))], ["node", "doc_id"])

    return held.mapInArrow(run, "node bigint, doc_id bigint")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole nodes: what a batch cuts off goes with the next."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).to_numpy()
        last = int(np.searchsorted(g, g[-1]))
        if last or (held and held[-1].column(0)[0].as_py() != g[0]):
            if last:
                held.append(b.slice(0, last))
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): the least vertex of its component.

    Alternating large and small stars: each round halves the depth of the trees, so the rounds grow with the logarithm of the
    largest component. Least neighbours are found by partial aggregation and written, so that a vertex of many edges is
    split where they are joined. Each round is written to the shared folder, the one before is deleted.
    """

    def digest(df: DataFrame):
        return df.select(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()

    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), tag)
    before = digest(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), tag)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), tag)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        then = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
        for done in (now, least, large, low):
            release(done)
        now, same = then, digest(then)
        if same == before:
            return now.select("u", F.col("v").alias("root")).union(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()).withColumnRenamed("u", "v")
        before = same


def placed(pairs: DataFrame, together: int) -> tuple[DataFrame, DataFrame]:
    """(unit, a, b): each pair with the task that verifies it; and (unit, doc_id): the documents that a task needs. Written tables.

    A pair goes to the least of a and its partners, which documents that are all alike have in common, so most are in one unit;
    a unit of more than `together` documents becomes pairs of blocks.
    """
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    at = materialize(pairs.join(least, "a").select("root", "a", "b"), "placed")
    needs = materialize(at.select("root", F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needs")
    large = materialize(needs.groupBy("root").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > together), "large")
    if large.isEmpty():
        return at.withColumnRenamed("root", "unit"), needs.withColumnRenamed("root", "unit")
    block = lambda c: F.when(F.col("m").isNotNull(), F.pmod(F.xxhash64(c), F.ceil(F.col("m") / together))).otherwise(0)
    at = looked_up(at, large, ["root"], "b", "left").select(F.xxhash64("root", F.least(block("a"), block("b")), F.greatest(block("a"), block("b"))).alias("unit"), "a", "b")
    at = materialize(at, "units")
    return at, materialize(at.select("unit", F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needs")


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, at_once: int = 1 << 19, columns: int = 4096, pairs: int = 1 << 13) -> np.ndarray:
    """Common members of sets[x] and sets[y], sorted sets of 32 bits, x and y differing: rows of bits, a range of members at a time."""
    common = np.zeros(len(x), np.int64)
    parts = sum(map(len, sets)) // at_once + 1
    bounds = np.linspace(0, 1 << 32, parts + 1).astype(np.uint64)
    cuts = np.array([np.searchsorted(s, bounds) for s in sets])
    for k in range(parts):
        own = np.repeat(np.arange(len(sets)), cuts[:, k + 1] - cuts[:, k])
        member, column, n = np.unique(np.concatenate([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)]), return_inverse=True, return_counts=True)
        # what one set alone has is common to none
        several = n > 1
        keep = several[column]
        own, column = own[keep], (np.cumsum(several) - 1)[column[keep]]
        for first in range(0, int(several.sum()), columns):
            here = (column >= first) & (column < first + columns)
            has = np.zeros((len(sets), columns), bool)
            has[own[here], column[here] - first] = True
            bits = np.packbits(has, axis=1).view(np.uint64)
            for at in range(0, len(x), pairs):
                common[at : at + pairs] += np.bitwise_count(bits[x[at : at + pairs]] & bits[y[at : at + pairs]]).sum(1, dtype=np.int64)
    return common


def similarities(held: dict[int, list[np.ndarray]], a: np.ndarray, b: np.ndarray, many: int = MANY) -> np.ndarray:
    """Exact Jaccard of pairs of documents by their sorted sets; of several sets of a document the best counts."""
    out = np.zeros(len(a))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    sets = [held[i] for i in ids.tolist()]
    single = np.array([len(s) == 1 for s in sets])
    fast = np.flatnonzero(single[x] & single[y]) if len(a) >= many else np.zeros(0, np.int64)
    if len(fast):
        size = np.array([len(s[0]) for s in sets])
        common = overlaps([s[0] for s in sets], x[fast], y[fast])
        out[fast] = common / (size[x[fast]] + size[y[fast]] - common)
    for k in np.setdiff1d(np.arange(len(a)), fast).tolist():
        for s in sets[x[k]]:
            for l in sets[y[k]]:
                s_, l_ = (s, l) if len(s) <= len(l) else (l, s)
                found = np.minimum(np.searchsorted(l_, s_), len(l_) - 1)
                common = int((l_[found] == s_).sum())
                out[k] = max(out[k], common / (len(s_) + len(l_) - common))
    return out


def verified(docs: DataFrame, pairs: DataFrame, n: int = N, threshold: float = THRESHOLD, together: int = TOGETHER) -> DataFrame:
    """The candidates (a written table) whose sets' exact Jaccard is at or over the threshold."""
    units, needs = placed(pairs, together)
    wanted = materialize(needs.select("doc_id").distinct(), "wanted")
    held = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))
    clean = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null and text <> ''")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(held.value.maybe(b.column(0).to_numpy())))
            for p in sliced([b], PART):
                found, sizes = shingles(p.column(2), n)
                ends = np.cumsum(sizes)
                rows = pa.array([found[z - s : z].tobytes() for s, z in zip(sizes, ends)], pa.binary())
                yield pa.RecordBatch.from_arrays([p.column(1), rows], ["doc_id", "grams"])

    drawn = clean.select(id_hash(F.col("doc_id")).alias("h"), "doc_id", "text").mapInArrow(sets, "doc_id bigint, grams binary")
    own = drawn.join(needs, "doc_id").select("unit", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("bigint").alias("b"), "grams")
    rows = own.union(units.select("unit", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("grams")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        unit, wait, n_wait = None, [], 0

        def told() -> pa.RecordBatch:
            a, b = np.concatenate(wait, 1)
            j = similarities(held, a, b)
            good = j >= threshold
            return pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good]), pa.array(j[good])], ["doc_a", "doc_b", "jaccard"])

        for batch in batches:
            units, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = np.flatnonzero((units[1:] != units[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for at, end in zip([0, *cut.tolist()], [*cut.tolist(), len(units)]):
                if at == end:
                    continue
                if wait and (units[at] != unit or n_wait >= WAIT):
                    yield told()
                    wait, n_wait = [], 0
                if units[at] != unit:
                    held, unit = {}, units[at]
                b = batch.slice(at, end - at)
                if kinds[at] == 0:
                    for d, g in zip(b.column(2).to_pylist(), b.column(4)):
                        held.setdefault(d, []).append(np.frombuffer(g.as_py(), np.uint32))
                else:
                    wait.append(np.stack([b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)]))
                    n_wait += end - at
        if wait:
            yield told()

    return rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(check, "doc_a bigint, doc_b bigint, jaccard double")


def classes_of(drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep) twice: of the documents of one set, and of those of several.

    rep is the least document of one set that has the set; where there is none, the least that has it.
    """
    sets = materialize(drawn.select("doc_id", "set_key").distinct(), "sets")
    several = materialize(sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "several")
    many = looked_up(sets, several.withColumn("many", F.lit(True)), ["doc_id"], "doc_id", "left")
    single = F.when(F.col("many").isNull(), F.col("doc_id"))
    least = materialize(many.groupBy("set_key").agg(F.coalesce(F.min(single), F.min("doc_id")).alias("rep")), "least")
    # a written table, so that a class of many copies is split where it is joined
    found = many.join(least, "set_key").select("doc_id", "rep", "many")
    return found.where("many is null").drop("many"), found.where("many").drop("many")


def graph(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, runs: int = RUNS, small: int = SMALL, local: int = LOCAL, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """Links between representatives (doc_a < doc_b, jaccard), and (doc_id, rep) of the documents of one set; written tables."""
    with scratch():
        drawn = materialize(sketches(docs, n), "sketches")
        one, many = map(materialize, classes_of(drawn), ("classes", "many"))
        stand = one.select("rep").union(many.select("doc_id")).distinct().withColumnRenamed("rep", "doc_id")
        with scratch():
            reps = materialize(drawn.join(stand, "doc_id").dropDuplicates(["doc_id", "set_key"]).select("doc_id", "sketch"), "reps")
            pairs = lasting(materialize(candidates(reps, threshold, small=small, runs=runs, local=local, together=together).where("a < b"), "candidates"))
        with scratch():
            found = lasting(materialize(verified(docs, pairs, n, threshold, together), "verified"))
        if not many.isEmpty():  # only documents of several sets can be in a pair twice
            own = many.where("doc_id <> rep").select(F.least("doc_id", "rep").alias("doc_a"), F.greatest("doc_id", "rep").alias("doc_b"), F.lit(1.0).alias("jaccard"))
            found = found.union(own).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))
        return lasting(materialize(found, "links")), lasting(one)


def near_pairs(docs: DataFrame, **how) -> DataFrame:
    """Pairs between representatives, and each other member of a class with its own."""
    links, one = graph(docs, **how)
    return links.union(one.where("doc_id <> rep").select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")))


def classed(links: DataFrame, one: DataFrame) -> DataFrame:
    """(doc_id, rep, class_id) of all documents that have a copy or a link; rep is the document itself where it has several sets."""
    with scratch():
        roots = lasting(materialize(components(links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")), "groups").withColumnsRenamed({"v": "rep", "root": "class_id"}), "roots"))
    several = roots.join(one.select("rep"), "rep", "left_anti").select(F.col("rep").alias("doc_id"), "rep", "class_id")
    # roots is a written table, so that a class of many copies is split where it is joined
    return one.join(roots, "rep", "left").select("doc_id", "rep", F.coalesce("class_id", "rep").alias("class_id")).union(several)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_links(table(spark, sf_dir, "documents"))


def counted_links(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id and n_links of every document."""
    links, one = graph(docs, **how)
    size = materialize(one.groupBy("rep").agg(F.count(F.lit(1)).alias("size")), "sizes")
    ends = links.select(F.col("doc_a").alias("x"), F.col("doc_b").alias("rep")).union(links.select(F.col("doc_b").alias("x"), F.col("doc_a").alias("rep")))
    degree = ends.join(size, "rep", "left").groupBy(F.col("x").alias("rep")).agg(F.sum(F.coalesce("size", F.lit(1))).alias("degree"))
    per = materialize(size.join(degree, "rep", "full").select("rep", (F.coalesce("size", F.lit(1)) - 1 + F.coalesce("degree", F.lit(0))).alias("n_links")), "degrees")
    linked = classed(links, one).join(per, "rep").select("doc_id", "class_id", "n_links")
    every = docs.select(F.col("doc_id").cast("bigint")).where("doc_id is not null").distinct()
    return every.join(linked, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (component of near duplicates) stays: that of the least doc_id.

    Rows that share a doc_id are one document, of which one row stays (the least text). Rows with a NULL doc_id all stay. Only rows that may go are
    shuffled: a filter of the ids that go lets the others pass.
    """
    links = classed(*graph(docs))
    key = F.col("doc_id").cast("bigint")
    again = materialize(docs.where("doc_id is not null").groupBy(key.alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated")
    gone = materialize(links.where("doc_id <> class_id").select(F.col("doc_id").alias("id")).distinct(), "gone")
    if again.isEmpty():
        return without(docs, gone)
    both = materialize(gone.union(again).distinct(), "apart")
    # one row of each repeated doc_id; the least by text and a hash of what can be hashed, aggregated before it is shuffled
    stay = materialize(again.join(gone, "id", "left_anti"), "stay")
    plain = [f"`{f.name}`" for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map", "variant"))]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.where("doc_id is not null").select(key.alias("id"), whole, F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*plain)).alias("o"))
    first = looked_up(rows, stay, ["id"], "id").groupBy("id").agg(F.min_by("doc", "o").alias("doc")).select("doc.*")
    return without(docs, both).union(first)

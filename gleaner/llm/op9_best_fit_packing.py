"""Best-fit packing by minimum bin slack.

Documents become sequences of tokens; one longer than a bin is cut into full bins and a remainder. Pieces are spread
over packing groups by a hash; each group is packed on its own: the longest piece left opens a bin, a dynamic
programme over the lengths still available (a bitset of reachable sums, one shift per power of two of a length's
multiplicity) finds the fullest combination that fits beside it, and those pieces leave the group.

Only (doc_id, piece, length) is shuffled, never text. The number of groups follows the number of pieces, so a task's
work is bounded at any size.

Defined results: NULL and empty texts have no tokens and are in no bin. Repeated rows are packed each for itself; a NULL doc_id
is packed as NULL. A very long text becomes many pieces. Equal lengths are taken in order of doc_id and piece. An empty table gives no bins. Columns but
doc_id and text, of whatever names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bpe import TOKENIZERS, VOCABULARY, BatchEncoder
from gleaner.llm.common import materialize, sliced, table

CAPACITY = 2048
GROUP = 8192
PART = 1000


def token_lengths(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the number of tokens of its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BatchEncoder(folder, vocabulary)
        for b in sliced(batches, PART):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(coder.lengths(b.column(1)), pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths (with repetition, at most counts of each) whose sum is the largest that fits in `room`.

    `lengths` is descending. Stops as soon as the room can be filled exactly.
    """
    reach, steps, full = 1, [], (1 << (room + 1)) - 1
    goal = 1 << room
    for x in lengths:
        if x > room:
            continue
        left, part = min(counts[x], room // x), 1
        while left:
            take = min(part, left)
            steps.append((reach, x, take))
            reach |= (reach << (x * take)) & full
            left -= take
            part *= 2
        if reach & goal:
            break
    best = reach.bit_length() - 1
    chosen = []
    for before, x, take in reversed(steps):
        if not before >> best & 1:
            chosen += [x] * take
            best -= x * take
    return chosen


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of `sizes` by bin. Equal sizes are taken in order of position."""
    at: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        at.setdefault(sizes[i], []).append(i)
    counts = {x: len(v) for x, v in at.items()}
    lengths = sorted(counts, reverse=True)
    bins = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = [first]
        if counts[first] == 0:
            lengths.pop(0)
        if capacity > first:
            more = fullest(counts, lengths, capacity - first)
            chosen += more
            for x in more:
                counts[x] -= 1
            if more:
                lengths = [x for x in lengths if counts[x]]
        bins.append([at[x].pop() for x in chosen])
    return bins


def packed(lengths: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Bins: bin_id, doc_ids, pieces, starts and lengths of what they hold, and tokens used."""
    cut = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n_tokens - 1) div {capacity}"))
    pieces = lengths.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(cut).alias("piece"))
    pieces = pieces.withColumn("length", F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity))
    n = pieces.count()
    groups = max(1, -(-n // group))
    keyed = pieces.select(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("g"), "doc_id", "piece", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            g = t.column("g")[0].as_py()
            docs, nth, size = (t.column(c).combine_chunks() for c in ("doc_id", "piece", "length"))
            bins = pack(size.to_pylist(), capacity)
            flat = np.fromiter((i for b in bins for i in b), np.int64, len(size))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bins])]).astype(np.int32))
            took = pa.array(flat)

            def lists(a: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(ends, a.take(took))

            sums = np.add.reduceat(size.to_numpy()[flat], np.asarray(ends)[:-1])
            starts = pa.array(nth.to_numpy() * capacity)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{g}-{i}" for i in range(len(bins))]), lists(docs), lists(nth), lists(starts), lists(size), pa.array(sums, pa.int64())],
                ["bin_id", "doc_ids", "pieces", "starts", "lengths", "used"],
            )

    schema = "bin_id string, doc_ids array<bigint>, pieces array<bigint>, starts array<bigint>, lengths array<bigint>, used bigint"
    return keyed.repartition("g").sortWithinPartitions("g", "length", "doc_id", "piece").mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of one group each, from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for a, z in zip(cuts, cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != g[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All bins. Lengths are written once: they are counted, then packed."""
    return packed(materialize(token_lengths(docs), "lengths"))

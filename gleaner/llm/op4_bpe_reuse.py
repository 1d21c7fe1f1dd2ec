"""BPE encoding with reuse of content-defined chunks, and decoding.

Texts are cut where a rolling hash of the last WINDOW bytes has MASK's bits zero, so that copied passages have
the same chunks wherever they stand. Chunk hashes are counted over all documents; a chunk found in several places is
encoded once. Documents get its ids by a join on the hash and encode only the text between. Where two parts meet, ids may differ from those of the whole text; a window about the join is
encoded again and grown until its outermost words agree with what is kept on either side. It ends at blanks between characters
that aren't white space, where every encoding has a boundary, so that ids beyond it can't change. Every borrowed chunk is compared with the text by its bytes, so a hash collision is only a chunk
encoded anew.

What is shuffled: hashes and places of chunks; the bytes of chunks that may be shared, once from each task that reads them; the ids of shared chunks; and the
texts of documents that have a shared chunk, once. Filters of bounded size (see common.IdFilter) tell which chunks
and documents have nothing to do with sharing: those documents are encoded where they are read. Ids are kept as 16-bit integers in
bytes.

Defined results: NULL and empty texts have no ids. NULL doc_ids are kept. Very long texts are encoded whole. Repeated rows give repeated
results. Of chunks with one hash and different bytes the least bytes are encoded once, the others where they stand. An empty table gives an empty result. Columns but
doc_id and text, of whatever names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bpe import TOKENIZERS, VOCABULARY, BatchEncoder, encoding
from gleaner.llm.common import id_filter, materialize, sliced, table

WINDOW = 32
#: A cut every 1024 bytes on average.
MASK = (1 << 10) - 1
#: Shorter chunks are encoded with the text about them: a join costs more than they do.
LEAST = 256
PART = 500
NO_ID = -(2**63)

_GEAR = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of a text's bytes, the last included; none inside a character."""
    n = len(data)
    if n <= LEAST:
        return np.array([n] if n else [], np.int64)
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    # h[i] is the sum of 2^(i-j) * gear[j] over the window, doubled up in log steps
    span = 1
    while span < WINDOW:
        moved = h[:-span] << np.uint64(span)
        h = np.concatenate([h[:span], h[span:] + moved])
        span *= 2
    good = (h >> np.uint64(40) & np.uint64(MASK)) == 0
    good[: WINDOW - 1] = False
    at = np.flatnonzero(good) + 1
    at = at[at < n]
    # not before a continuation byte
    at = at[(raw[at] & 0xC0) != 0x80]
    return np.append(at, n)


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each chunk of at least LEAST bytes."""
    ends = cuts(data).tolist()
    return [(a, z) for a, z in zip([0, *ends], ends) if z - a >= LEAST]


def keyed(docs: DataFrame) -> DataFrame:
    """The text with a key: doc_id and a hash of the text, so that neither NULL nor repeated doc_ids mix documents."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("th"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def places(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PART):
                p = b.slice(at, PART)
                doc, start, end, h = [], [], [], []
                for i, text in enumerate(p.column(2)):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    for a, z in chunks(data):
                        doc.append(i)
                        start.append(a)
                        end.append(z)
                        h.append(xxhash.xxh3_64_intdigest(data[a:z]))
                rows = pa.array(doc, pa.int64())
                yield pa.RecordBatch.from_arrays([p.column(0).take(rows), p.column(1).take(rows), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))], ["doc", "th", "start", "end", "h"])

    return keyed(docs).mapInArrow(run, "doc bigint, th bigint, start int, `end` int, h bigint")


class Joiner:
    """Puts parts of a text together."""

    def __init__(self, folder: str, vocabulary: str):
        self.encoding = encoding(folder, vocabulary)
        self.coder = BatchEncoder(folder, vocabulary)
        self.size = np.zeros(self.encoding.max_token_value + 1, np.int64)
        for x, i in self.encoding._mergeable_ranks.items():
            self.size[i] = len(x)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())

    def join(self, data: bytes, parts: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
        """Ids of the text from (start, end, ids) of parts that cover it."""
        ids = parts[0][2]
        ends = parts[0][0] + np.cumsum(self.size[ids])
        for start, end, more in parts[1:]:
            far = start + np.cumsum(self.size[more])
            ids, ends = self.mend(data, start, end, ids, ends, more, far)
        return ids

    def mend(self, data: bytes, at: int, upto: int, ids: np.ndarray, ends: np.ndarray, more: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of data[:upto] from those before and after `at`.

        The window runs from one sure boundary to another. Its outermost words are in it to be compared: while they
        don't agree with what either side has there, it grows.
        """
        k = 1
        while True:
            left, right = before(data, at, k + 1), after(data, at, upto, k + 1)
            a, z = left[-1], right[-1]
            new = np.array(self.encoding.encode_ordinary(data[a:z].decode()), np.int32)
            new_ends = a + np.cumsum(self.size[new])
            i, j = place(ends, a), place(far, z, at)
            if i is not None and j is not None and self.agree(new, new_ends, ids, ends, a, left[0], a) and self.agree(new, new_ends, more, far, right[0], z, a, at):
                return np.concatenate([ids[:i], new, more[j:]]), np.concatenate([ends[:i], new_ends, far[j:]])
            k *= 4

    @staticmethod
    def agree(new, new_ends, old, old_ends, a, z, new_base, old_base=0) -> bool:
        """Whether both have the same ids over [a, z). At an end of the text there is nothing to compare."""
        if a == z:
            return True
        where = place(new_ends, a, new_base), place(new_ends, z, new_base), place(old_ends, a, old_base), place(old_ends, z, old_base)
        return None not in where and np.array_equal(new[where[0] : where[1]], old[where[2] : where[3]])


def place(ends: np.ndarray, p: int, base: int = 0) -> int | None:
    """The number of ids that end at or before p, if one ends there (or p is where they begin)."""
    if p == base:
        return 0
    i = int(np.searchsorted(ends, p))
    return i + 1 if i < len(ends) and ends[i] == p else None


def sure(data: bytes, p: int) -> bool:
    """Whether a token surely begins at p: a blank between characters that aren't white space."""
    if data[p] != 32:
        return False
    b, c = data[p - 1], data[p + 1]
    return (33 <= b <= 126 or (b & 0xC0 == 0x80 and p > 1 and 0xC3 <= data[p - 2] <= 0xDF)) and (33 <= c <= 126 or 0xC3 <= c <= 0xDF)


def before(data: bytes, at: int, n: int) -> list[int]:
    """The n nearest sure boundaries before `at`, from the nearest; the start of the text where there are fewer."""
    out, p = [], at - 1
    while len(out) < n:
        p = data.rfind(b" ", 1, p) if p > 1 else -1
        if p < 0:
            return out + [0] * (n - len(out))
        if sure(data, p):
            out.append(p)
    return out


def after(data: bytes, at: int, upto: int, n: int) -> list[int]:
    """The n nearest sure boundaries within (at, upto), from the nearest; `upto` where there are fewer."""
    out, p = [], at
    while len(out) < n:
        p = data.find(b" ", p + 1, upto - 1)
        if p < 0:
            return out + [upto] * (n - len(out))
        if sure(data, p):
            out.append(p)
    return out


def pack_ids(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes()


def unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2").astype(np.int32)


def chunk_ids(docs: DataFrame, hot: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """(h, ids) of the chunks whose hashes are in `hot`, a written table; a few others may be among them."""
    held = docs.sparkSession.sparkContext.broadcast(id_filter(hot, hashed=True))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in sliced(batches, PART):
            h, parts = [], []
            for text in b.column(0):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                for a, z in chunks(data):
                    h.append(xxhash.xxh3_64_intdigest(data[a:z]))
                    parts.append((data, a, z))
            hashes = np.array(h, np.uint64).view(np.int64)
            keep = [i for i in np.flatnonzero(held.value.maybe(hashes)).tolist() if h[i] not in seen and not seen.add(h[i])]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[keep]), pa.array([d[a:z].decode() for d, a, z in map(parts.__getitem__, keep)], pa.string())], ["h", "chunk"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BatchEncoder(folder, vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _packed(coder, b.column(1))], ["h", "ids"])

    once = docs.select("text").mapInArrow(cut_out, "h bigint, chunk string").groupBy("h").agg(F.min("chunk").alias("chunk"))
    return once.mapInArrow(encode, "h bigint, ids binary")


def _packed(coder: BatchEncoder, texts: pa.Array) -> pa.Array:
    ids, n = coder.encode(texts)
    ends = np.cumsum(n)
    return pa.array([pack_ids(ids[z - k : z]) for k, z in zip(n, ends)], pa.binary())


def encoded(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens and the ids (16-bit, little-endian) of every document."""
    if encoding(folder, vocabulary).max_token_value >= 1 << 16:
        raise ValueError("ids of this vocabulary don't fit in 16 bits")
    found = materialize(places(docs), "places")
    place = F.struct("doc", "th", "start")
    hot = found.groupBy("h").agg(F.min(place).alias("o"), F.max(place).alias("z")).where("o <> z").select("h")
    hot = materialize(hot, "shared")  # a written table, as is the next, so that a chunk of many documents is split where it is joined
    lent = materialize(chunk_ids(docs, hot, folder, vocabulary), "lent")
    shared = found.join(hot, "h", "left_semi").select("h", "doc", "th", "start", "end").distinct()
    part = F.struct("start", "end", "ids")
    lists = shared.join(lent, "h").groupBy("doc", "th").agg(F.array_sort(F.collect_list(part)).alias("l"))
    key = F.xxhash64("doc", "th").alias("key")
    users = materialize(shared.select(key).distinct(), "users")
    held = docs.sparkSession.sparkContext.broadcast(id_filter(users, hashed=True))
    text = keyed(docs).select(F.xxhash64("doc", "th").alias("k"), "doc", "th", "text")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BatchEncoder(folder, vocabulary)
        for b in sliced(batches, PART):
            b = b.filter(pa.array(~held.value.maybe(b.column(0).to_numpy())))
            ids = _packed(coder, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([len(x) // 2 for x in ids.to_pylist()], pa.int64()), ids], ["doc", "n_tokens", "ids"])

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(held.value.maybe(b.column(0).to_numpy()))).select(["doc", "th", "text"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner(folder, vocabulary)
        for b in sliced(batches, PART):
            yield _assemble(joiner, b)

    out = text.select("k", "doc", "text").mapInArrow(alone, "doc bigint, n_tokens bigint, ids binary")
    met = text.mapInArrow(some, "doc bigint, th bigint, text string").join(lists, ["doc", "th"], "left").select("doc", "text", "l")
    out = out.union(met.mapInArrow(assemble, "doc bigint, n_tokens bigint, ids binary"))
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_tokens", "ids")


def _assemble(joiner: Joiner, p: pa.RecordBatch) -> pa.RecordBatch:
    gaps: list[str] = []
    plans = []
    for text, l in zip(p.column(1), p.column(2)):
        if not l.is_valid:
            plans.append(None)
            gaps.append(text.as_py())
            continue
        data = text.as_buffer().to_pybytes()
        parts, at = [], 0
        for x in l.as_py():
            ids = unpack_ids(x["ids"])
            a, z = x["start"], x["end"]
            if a < at or joiner.decode(ids) != data[a:z]:
                continue
            if a > at:
                parts.append([at, a, None])
                gaps.append(data[at:a].decode())
            parts.append([a, z, ids])
            at = z
        if at < len(data) or not parts:
            parts.append([at, len(data), None])
            gaps.append(data[at:].decode())
        plans.append((data, parts))
    ids, n = joiner.coder.encode(pa.array(gaps, pa.string()))
    ends = np.cumsum(n)
    made = iter([ids[z - k : z] for k, z in zip(n, ends)])
    rows = []
    for plan in plans:
        if plan is None:
            rows.append(next(made))
        else:
            data, parts = plan
            rows.append(joiner.join(data, [(a, z, next(made) if i is None else i) for a, z, i in parts]))
    return pa.RecordBatch.from_arrays([p.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array([pack_ids(x) for x in rows], pa.binary())], ["doc", "n_tokens", "ids"])


def decoded(df: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text from ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(folder, vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode_bytes(unpack_ids(x.as_py()).tolist()).decode() for x in b.column(1)], pa.string())], ["doc_id", "text"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op4_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))

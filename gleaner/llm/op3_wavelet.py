"""Token shards as wavelet matrices.

Documents are tokenised where they are read and their ids run into shards of about SHARD tokens, without a shuffle.
A shard is one compressed file: for each bit of the ids, from the highest, a bit-plane in the order that the planes
above it sort the tokens into (zeros first, stably), in blocks of BLOCK bits that are compressed each for itself, with
counts of ones before each; then the documents' ids and ends. Any token can be read (access), a token counted before any position
(rank) and its k-th occurrence found (select) from one block, or two, of each plane; no other is read or opened. Many
positions at once go plane by plane.

The query writes the shards and reads them back: of each document the first token, how often the document has it, and
where last, by access, rank and select in the shard's file. The list of shards that the tasks return says which files
count, so a lost or repeated task leaves at most a file that no list names.

Defined results: NULL and empty texts hold no tokens but keep their place among the documents (their first token is NULL,
counted 0 times); NULL doc_ids are kept as NULL. Documents longer than SHARD make one larger shard. Repeated rows are stored each for itself,
in the order they are read. An empty table gives no shards. Columns but doc_id and text, of whatever names, aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bpe import TOKENIZERS, VOCABULARY, BatchEncoder
from gleaner.llm.common import fresh_path, materialize, sliced, table

SHARD = 1 << 21
BLOCK = 1 << 16
MAGIC = b"GWM2"
#: Opened blocks that are kept for single steps.
KEPT = 64
SCHEMA = "shard string, n_docs bigint, n_tokens bigint, bits int, n_bytes bigint"


def build(ids: np.ndarray, docs: np.ndarray | None = None, known: np.ndarray | None = None, ends: np.ndarray | None = None, level: int = 3) -> bytes:
    """The file of a shard. docs, known, ends: ids of the documents, whether each is one (not NULL), and where their tokens end."""
    n, z = len(ids), zstandard.ZstdCompressor(level=level)
    bits, blocks = max(1, int(ids.max()).bit_length()) if n else 1, max(1, -(-n // BLOCK))
    now = ids.astype(np.uint32 if bits > 16 else np.uint16)
    zeros, counts, sizes, body = [], [], [], []
    for b in range(bits - 1, -1, -1):
        ones = (now >> b & 1).astype(bool)
        raw = np.zeros(blocks * BLOCK // 8, np.uint8)
        packed = np.packbits(ones, bitorder="little")
        raw[: len(packed)] = packed
        per = np.bitwise_count(raw.view("<u8")).reshape(blocks, -1).sum(1)
        zeros.append(n - int(per.sum()))
        counts.append(np.cumsum(per) - per)
        for x in raw.reshape(blocks, -1):
            part = z.compress(x.tobytes())
            body.append(part if len(part) < BLOCK // 8 else x.tobytes())
            sizes.append(len(body[-1]))
        now = np.concatenate([now[~ones], now[ones]])
    docs, ends = (np.zeros(0, np.int64) if x is None else x for x in (docs, ends))
    known = np.ones(len(docs), bool) if known is None else known
    tail = z.compress(np.concatenate([docs, known.astype(np.int64), np.diff(ends, prepend=0)]).astype("<i8").tobytes())
    head = z.compress(b"".join([np.array([n, bits, len(docs), len(tail)], "<u8").tobytes(), np.array(zeros, "<u8").tobytes(), np.concatenate(counts).astype("<u8").tobytes(), np.array(sizes, "<u4").tobytes()]))
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, tail, *body])


class Wavelet:
    """A shard, of which `read(start, size)` gives bytes as they are needed; or its whole file."""

    def __init__(self, file: bytes | Callable[[int, int], bytes]):
        self.read = file if callable(file) else lambda a, n: file[a : a + n]
        start = self.read(0, 12)
        if start[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int.from_bytes(start[4:], "little")
        raw = zstandard.ZstdDecompressor().decompress(self.read(12, size))
        self.n, self.bits, self.n_docs, tail = map(int, np.frombuffer(raw, "<u8", 4))
        self.zeros = np.frombuffer(raw, "<u8", self.bits, 32).astype(np.int64).tolist()
        blocks = max(1, -(-self.n // BLOCK))
        at = 32 + 8 * self.bits
        self.counts = np.frombuffer(raw, "<u8", self.bits * blocks, at).astype(np.int64).reshape(self.bits, blocks)
        sizes = np.frombuffer(raw, "<u4", self.bits * blocks, at + 8 * self.bits * blocks).astype(np.int64)
        self.starts = 12 + size + tail + np.concatenate([[0], np.cumsum(sizes)])
        self._tail = (12 + size, tail)
        self._open: dict[int, np.ndarray] = {}

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """ids and ends of the documents."""
        x = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.read(*self._tail)), "<i8").reshape(3, -1)
        return [d if k else None for d, k in zip(x[0].tolist(), x[1].tolist())], np.cumsum(x[2])

    def _block(self, plane: int, b: int) -> np.ndarray:
        k = plane * self.counts.shape[1] + b
        if k not in self._open:
            if len(self._open) >= KEPT:
                self._open.pop(next(iter(self._open)))
            raw = self.read(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))
            self._open[k] = np.frombuffer(raw if len(raw) == BLOCK // 8 else zstandard.ZstdDecompressor().decompress(raw), "<u8")
        return self._open[k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones before i."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        b, w = i // BLOCK, i % BLOCK // 64
        words = self._block(plane, b)
        return int(self.counts[plane, b]) + int(np.bitwise_count(words[:w]).sum()) + (int(words[w]) & ((1 << i % 64) - 1)).bit_count()

    def _find(self, plane: int, k: int, bit: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        before = self.counts[plane] if bit else np.arange(self.counts.shape[1]) * BLOCK - self.counts[plane]
        b = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(plane, b).view(np.uint8), bitorder="little")
        return b * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[b])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p, zero in enumerate(self.zeros):
            bit = int(self._block(p, i // BLOCK)[i % BLOCK // 64]) >> i % 64 & 1
            ones = self._ones(p, i)
            i = zero + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's run begins on the lowest level, and its end for those before i."""
        a, z = 0, i
        for p, zero in enumerate(self.zeros):
            x, y = self._ones(p, a), self._ones(p, z)
            a, z = (zero + x, zero + y) if token >> self.bits - 1 - p & 1 else (a - x, z - y)
        return a, z

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of the token before position i, or in all."""
        if token < 0 or token >> self.bits or not self.n:
            return 0
        a, z = self._range(token, self.n if i is None else min(max(i, 0), self.n))
        return z - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0), or -1."""
        if k < 0 or k >= self.rank(token):
            return -1
        at = self._range(token, 0)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> self.bits - 1 - p & 1
            at = self._find(p, at - self.zeros[p] if bit else at, bit)
        return at

    def _plane(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        """A whole plane: its bits, and the ones before each position, n included."""
        bits = np.concatenate([np.unpackbits(self._block(p, b).view(np.uint8), bitorder="little") for b in range(self.counts.shape[1])])[: self.n]
        return bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    def follow(self, tokens: np.ndarray | None, *at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Tokens and places on the lowest level of positions on the highest, many at once; along `tokens`, or the positions' own."""
        own = np.zeros(len(at[0]), np.int64)
        for p, zero in enumerate(self.zeros):
            bits, before = self._plane(p)
            bit = bits[at[0]].astype(np.int64) if tokens is None else tokens >> self.bits - 1 - p & 1
            at = tuple(np.where(bit == 1, zero + before[x], x - before[x]) for x in at)
            own = own << 1 | bit
        return own, *at

    def climb(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Positions on the highest level of places of tokens on the lowest, many at once."""
        for p in range(self.bits - 1, -1, -1):
            bits, _ = self._plane(p)
            ones, zeros = np.flatnonzero(bits), np.flatnonzero(bits == 0)
            bit = tokens >> self.bits - 1 - p & 1
            out = np.empty(len(at), np.int64)
            out[bit == 1], out[bit == 0] = ones[at[bit == 1] - self.zeros[p]], zeros[at[bit == 0]]
            at = out
        return at

    def decode(self) -> np.ndarray:
        """All tokens."""
        return self.follow(None, np.arange(self.n))[0].astype(np.uint32)


def write_shards(docs: DataFrame, folder: str, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """Writes a file for each shard into a folder that all executors share, and gives their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BatchEncoder(tokenizers, vocabulary)
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        held, ids, lengths, n, out = [], [], [], 0, []

        def flush() -> None:
            nonlocal held, ids, lengths, n
            tokens, doc = np.concatenate(ids), pa.concat_arrays(held)
            file = build(tokens, doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), np.cumsum(np.concatenate(lengths)))
            name = f"shard-{uuid.uuid4().hex}.gwm"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(file)
            out.append((name, len(doc), len(tokens), max(1, int(tokens.max()).bit_length()) if len(tokens) else 1, len(file)))
            held, ids, lengths, n = [], [], [], 0

        for part in sliced(batches, 1000):
            found, count = coder.encode(part.column(1))
            doc, done, ends = part.column(0), 0, np.cumsum(count)
            while done < len(count):
                # the documents that fit, one at least where the shard is empty
                first = int(ends[done - 1]) if done else 0
                upto = int(np.searchsorted(ends, first + shard - n, side="right"))
                upto = max(upto, done + (not held))
                if upto > done:
                    held.append(doc.slice(done, upto - done))
                    ids.append(found[first : ends[upto - 1]])
                    lengths.append(count[done:upto])
                    n += int(ends[upto - 1]) - first
                    done = upto
                if done < len(count):
                    flush()
        if held:
            flush()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["shard", "n_docs", "n_tokens", "bits", "n_bytes"])

    return materialize(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA), "shards")


def opened(listed: DataFrame, folder: str, f: Callable[[str, Wavelet], pa.RecordBatch], schema: str) -> DataFrame:
    """What f makes of each listed shard, of whose file only what f asks for is read. A shard is a task, or shares one."""
    n = listed.count()
    tasks = max(1, min(n, 8 * int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as file:
                    yield f(name, Wavelet(lambda a, k: file.read_at(k, a)))

    return listed.select("shard").repartition(tasks).mapInArrow(run, schema)


def count_token(listed: DataFrame, folder: str, token: int) -> DataFrame:
    """Occurrences of a token in each shard."""
    return opened(listed, folder, lambda name, w: pa.RecordBatch.from_pydict({"shard": [name], "n": [w.rank(token)]}), "shard string, n bigint")


def locate(listed: DataFrame, folder: str, token: int) -> DataFrame:
    """Every occurrence of a token: shard, doc_id, and its position in the document."""

    def found(name: str, w: Wavelet) -> pa.RecordBatch:
        k, first = w.rank(token), w._range(token, 0)[0] if 0 <= token and not token >> w.bits else 0
        at = w.climb(np.full(k, token), first + np.arange(k)) if k else np.zeros(0, np.int64)
        docs, ends = w.documents()
        nth = np.searchsorted(ends, at, side="right")
        return pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(docs, pa.int64()).take(pa.array(nth)), pa.array(at - np.concatenate([[0], ends])[nth])], ["shard", "doc_id", "position"])

    return opened(listed, folder, found, "shard string, doc_id bigint, position bigint")


def first_tokens(listed: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_tokens, first_token, n_first (how often the document has it), last_first (its last place in the document)."""

    def asked(name: str, w: Wavelet) -> pa.RecordBatch:
        docs, ends = w.documents()
        starts = np.concatenate([[0], ends])[:-1]
        has = ends > starts
        token, begin = w.follow(None, starts[has])
        _, end = w.follow(token, ends[has])
        last = w.climb(token, end - 1) - starts[has]
        some = pa.array(np.where(has, np.cumsum(has) - 1, 0), mask=~has)
        take = lambda x: pa.array(x, pa.int64()).take(some)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - starts), take(token), take(end - begin).fill_null(0), take(last)], ["doc_id", "n_tokens", "first_token", "n_first", "last_first"])

    return opened(listed, folder, asked, "doc_id bigint, n_tokens bigint, first_token bigint, n_first bigint, last_first bigint")


def op3_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, read from the shards' files: its length, first token, how often it has that and where last."""
    folder = fresh_path(spark, "wavelet")
    return first_tokens(write_shards(table(spark, sf_dir, "documents"), folder), folder)

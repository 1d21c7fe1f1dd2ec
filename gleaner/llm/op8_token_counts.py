"""Token counts without token ids of documents.

Each distinct pre-token is encoded once, for its number of pieces. The most frequent of them (HEAD, a fixed bound)
form a broadcast table that settles most of every document where it is read; the rest of a document's pre-tokens, with
their frequencies, are joined to the table of distinct pre-tokens by a shuffle. Both parts are exact, whatever HEAD is:
it only moves pre-tokens between them, and takes the hot keys out of the join.

Pre-tokens are those of the tokenizer's own pattern. A batch is cut at blanks first (see bpe.py), and the pattern is applied once to
each distinct word; a pre-token is a word, a number, a run of signs or of white space, so none grows with a text.

Defined results: NULL and empty texts count 0. A NULL doc_id is counted as one document, NULL. Rows of the same doc_id are
one document: their counts are added. Very long texts are cut like others. Of equally frequent pre-tokens the lesser are in the
head first, which moves no count. An empty table gives an empty result. Columns but doc_id and text, of whatever names, aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.bpe import PATTERN, TOKENIZERS, VOCABULARY, encoding, filled, matches, ragged, words_of
from gleaner.llm.common import materialize, sliced, table

HEAD = 1 << 17
PART = 2000
CUT = regex.compile(PATTERN).findall


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens; for each distinct word its pre-tokens: all of them, where its own begin, how many; and the texts' words (see words_of)."""
    spaced, extra, codes, per = words_of(filled(texts))
    plain = matches(spaced, r"^\p{L}+$")
    whole = pc.binary_join_element_wise("", spaced, " ")
    found = list(map(CUT, [*whole.filter(pa.array(~plain)).to_pylist(), *extra.to_pylist()]))
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain), np.arange(len(spaced), len(spaced) + len(extra))])
    n_of = np.ones(len(order), np.int64)
    n_of[order[int(plain.sum()) :]] = np.fromiter(map(len, found), np.int64, len(found))
    start = np.zeros(len(order), np.int64)
    start[order] = np.cumsum(n_of[order]) - n_of[order]
    tokens = pa.concat_arrays([whole.filter(pa.array(plain)), pa.array(itertools.chain.from_iterable(found), whole.type)]).dictionary_encode()
    return tokens.dictionary, tokens.indices.to_numpy().astype(np.int64), start, n_of, codes, per


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens; (text, pre-token, count) without repetition, sorted."""
    tokens, own, start, n_of, codes, per = coded(texts)
    # each text's distinct words with their counts, then their pre-tokens
    pair, count = np.unique(np.repeat(np.arange(len(per)), per) * len(n_of) + codes, return_counts=True)
    text, word = pair // max(1, len(n_of)), pair % max(1, len(n_of))
    k, size = n_of[word], max(1, len(tokens))
    keys, at = np.unique(np.repeat(text, k) * size + own[ragged(start[word], k)], return_inverse=True)
    return tokens, keys // size, keys % size, np.bincount(at, np.repeat(count, k), len(keys)).astype(np.int64)


def distinct(docs: DataFrame) -> DataFrame:
    """Each distinct pre-token with its number of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, PART):
            tokens, own, start, n_of, codes, _ = coded(b.column(0))
            times = np.repeat(np.bincount(codes, minlength=len(n_of)), n_of)
            n = np.bincount(own[ragged(start, n_of)], times, len(tokens)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([tokens, pa.array(n)], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def with_pieces(tokens: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """Adds the number of pieces; each row is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(folder, vocabulary).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(one(x)) for x in b.column(0).to_pylist()], pa.int32())], ["token", "n", "pieces"])

    return tokens.mapInArrow(run, "token string, n bigint, pieces int")


def counted(docs: DataFrame, head: int = HEAD, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of all documents."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    known = materialize(with_pieces(distinct(docs), folder, vocabulary), "pretokens")
    top = known.orderBy(F.desc("n"), "token").limit(head).select("token", "pieces").toArrow()
    shared = spark.sparkContext.broadcast(top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        names = t.column(0).combine_chunks()
        pieces = np.append(t.column(1).to_numpy(), 0)
        for b in sliced(batches, PART):
            words, doc, code, n = cut(b.column(1))
            at = pc.index_in(words, value_set=names)
            at = np.where(pc.is_null(at).to_numpy(zero_copy_only=False), -1, pc.fill_null(at, 0).to_numpy())
            sums = np.bincount(doc, pieces[at][code] * n, b.num_rows).astype(np.int64)
            rest = at[code] < 0
            d, w = doc[rest], code[rest]
            ids = pc.take(b.column(0), pa.array(np.concatenate([np.arange(b.num_rows), d])))
            # a document's settled part has a key that no pre-token has (it mixes signs and digits), spread over the partitions
            own = pa.array([f"\x00\x00{x}" for x in b.column(0).to_pylist()], pa.string())
            keys = pa.concat_arrays([own, words.take(pa.array(w)).cast(pa.string())])
            yield pa.RecordBatch.from_arrays(
                [ids, keys, pa.array(np.concatenate([np.zeros(b.num_rows, np.int64), n[rest]])), pa.array(np.concatenate([sums, np.zeros(len(d), np.int64)]))],
                ["doc_id", "token", "n", "settled"],
            )

    parts = docs.mapInArrow(run, "doc_id bigint, token string, n bigint, settled bigint")
    joined = parts.join(known.select("token", "pieces"), "token", "left")
    return joined.groupBy("doc_id").agg(F.sum(F.col("settled") + F.coalesce(F.col("n") * F.col("pieces"), F.lit(0))).alias("n_tokens"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "documents"))

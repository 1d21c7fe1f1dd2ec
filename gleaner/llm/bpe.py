"""Byte-level BPE over whole Arrow batches, equal to the tokenizer's own encoding id for id.

The pre-tokenizer never lets a token run across a blank between two characters that aren't white space: the blank
opens the next token. So texts are cut at such blanks, each distinct word of the batch is encoded once, and the
ids are put together by array indexing. Words beside other blanks stay together with these.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

#: Where the public tokenizers lie; a parameter of every operator that needs one.
TOKENIZERS = os.environ.get("GLEANER_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space, and more: RE2's \s is ASCII, the rest is spelt out.
WHITE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


@functools.lru_cache(maxsize=2)
def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def opens_word(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> np.ndarray:
    """For each id, whether its bytes begin with a blank."""
    e = encoding(folder, vocabulary)
    return np.array([e.decode_single_token_bytes(i)[:1] == b" " if i in _ids(e) else False for i in range(e.max_token_value + 1)])


@functools.lru_cache(maxsize=2)
def _ids(e: tiktoken.Encoding) -> frozenset:
    return frozenset(e._mergeable_ranks.values())


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)


def matches(words: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False).astype(bool)


def words_of(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at each blank between characters that aren't white space.

    Distinct words that follow such a blank (given without it); other distinct strings, which are the texts' first words and what has
    loose blanks in it (with the blank before, where it isn't a first word); the number of each word in order (the others'
    follow on those of the former), and the words of each text. A text has one at least.
    """
    split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    values = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = values.dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lead = np.zeros(len(codes), bool)
    lead[offsets[:-1]] = True
    opens, closes = matches(distinct, f"^{WHITE}|^$"), matches(distinct, f"{WHITE}$|^$")
    glued = np.zeros(len(codes), bool)
    glued[1:] = (closes[codes[:-1]] | opens[codes[1:]]) & ~lead[1:]
    first = np.flatnonzero(~glued)
    size = np.diff(np.append(first, len(codes)))
    per = np.add.reduceat(~glued, offsets[:-1]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    head, more = lead[first], size > 1
    simple = ~head & ~more
    used, at = np.unique(codes[first[simple]], return_inverse=True)
    out = np.zeros(len(first), np.int64)
    out[simple] = at
    parts = values.take(pa.array(ragged(first[more], size[more]))).to_pylist()
    ends = np.cumsum(size[more])
    long = [("" if h else " ") + " ".join(parts[z - k : z]) for h, k, z in zip(head[more], size[more].tolist(), ends.tolist())]
    others = pa.concat_arrays([values.take(pa.array(first[head & ~more])), pa.array(long, values.type)]).dictionary_encode()
    out[np.concatenate([np.flatnonzero(head & ~more), np.flatnonzero(more)])] = others.indices.to_numpy() + len(used)
    return distinct.take(pa.array(used)), others.dictionary, out, per


class BatchEncoder:
    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        self.encoding = encoding(folder, vocabulary)
        self.opens = opens_word(folder, vocabulary)

    def spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of " " + word for each word (none has white space): all ids and the count of each."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids = np.asarray(self.encoding.encode_ordinary(" " + " ".join(words)), dtype=np.int32)
        first = np.flatnonzero(self.opens[ids])
        return ids, np.diff(np.append(first, len(ids)))

    def each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = list(map(self.encoding.encode_ordinary, pieces))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(counts.sum())), counts

    def pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts as lists of distinct words: (ids, id count of each word, first id of each, word numbers, words a text)."""
        spaced, extra, codes, per = words_of(texts)
        blank = matches(spaced, WHITE)
        plain, odd = np.flatnonzero(~blank), np.flatnonzero(blank)
        a_ids, a_n = self.spaced(spaced.take(pa.array(plain)).to_pylist())
        b_ids, b_n = self.each([" " + x for x in spaced.take(pa.array(odd)).to_pylist()])
        c_ids, c_n = self.each(extra.to_pylist())
        n = len(spaced)
        counts = np.zeros(n + len(c_n), np.int64)
        counts[plain], counts[odd], counts[n:] = a_n, b_n, c_n
        order = np.concatenate([plain, odd, np.arange(n, len(counts))])
        starts = np.zeros(len(counts), np.int64)
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate([a_ids, b_ids, c_ids]), counts, starts, codes, per

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and the number of ids of each. NULL and '' have none."""
        texts = filled(texts)
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ids, counts, starts, codes, per = self.pieces(texts)
        per_piece = counts[codes]
        return ids[ragged(starts[codes], per_piece)], _sums(per_piece, per)

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        texts = filled(texts)
        if not len(texts):
            return np.zeros(0, np.int64)
        _, counts, _, codes, per = self.pieces(texts)
        return _sums(counts[codes], per)


def _sums(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(per)
    return total[ends] - total[ends - per]


def filled(texts: pa.Array) -> pa.Array:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()) if texts.nbytes > 1 << 30 else texts.cast(pa.string()), "")

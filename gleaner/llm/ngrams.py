"""Normalised words and word n-grams of whole Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from gleaner.llm.bpe import filled

GAP = r"[^\p{L}\p{N}_]+"


def normal_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-case runs of letters, digits and _ of all texts, in order, dictionary-encoded, and the number of each text."""
    clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(filled(texts)), GAP, " "), " ")
    split = pc.split_pattern(clean, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    values = split.values.slice(offsets[0], offsets[-1] - offsets[0])
    per = np.diff(offsets)
    blank = pc.equal(clean, "").to_numpy(zero_copy_only=False)
    if blank.any():
        keep = np.repeat(~blank, per)
        values, per = values.filter(pa.array(keep)), np.where(blank, 0, per)
    return values.dictionary_encode(), per


def hash32(words: pa.Array, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh32_intdigest(w, seed) for w in words.to_pylist()), np.uint32, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words of each text, as a sorted set, one text after another, and the size of each set.

    A text with fewer than n words has one n-gram: all its words. One without words has none.
    """
    coded, per = normal_words(texts)
    hashes = hash32(coded.dictionary, 7).astype(np.uint64)
    h = hashes[coded.indices.to_numpy().astype(np.int64)] if len(coded) else np.zeros(0, np.uint64)
    ends = np.cumsum(per)
    starts = ends - per
    grams = np.where(per == 0, 0, np.maximum(per - n + 1, 1))
    total = int(grams.sum())
    if not total:
        return np.zeros(0, np.uint32), grams
    g_ends = np.cumsum(grams)
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - g_ends + grams, grams)
    last = np.repeat(ends, grams)
    acc = np.zeros(total, np.uint64)
    for k in range(n):
        i = at + k
        inside = i < last
        word = np.where(inside, h[np.minimum(i, len(h) - 1)] + np.uint64(1), np.uint64(0))
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + word)
    doc = np.repeat(np.arange(len(per), dtype=np.uint64), grams)
    keys = np.unique(doc << np.uint64(32) | (acc >> np.uint64(32)))
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(per))


def minhash(sets: np.ndarray, sizes: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n minhash values of each set (rows of empty sets are meaningless)."""
    r = np.random.default_rng(seed)
    xor = r.integers(0, 1 << 32, n, dtype=np.uint32)
    mul = r.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.zeros((len(sizes), n), np.uint32)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    for i in range(n):
        x = (sets ^ xor[i]) * mul[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out[full, i] = np.minimum.reduceat(x, starts)
    return out

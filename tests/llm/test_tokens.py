import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex

from gleaner.llm.bpe import PATTERN, BatchEncoder, encoding
from gleaner.llm import op3_wavelet as op3
from gleaner.llm.op3_wavelet import Wavelet, build
from gleaner.llm import op8_token_counts as op8
from gleaner.llm.op8_token_counts import counted
from gleaner.llm.op9_best_fit_packing import fullest, pack, packed, token_lengths

ALPHABET = ["a", "b", " ", " ", "\n", "'s", "'", "\t", "é", "1", " ", "　", "!", "the", "ing", ".", "\x1c", "\x85", "語", "🙂"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def texts(n=3000, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 14))) for _ in range(n)]


def odd_docs(spark, more=()):
    rows = [(1, "a b  c"), (2, None), (3, ""), (None, "who knows"), (4, "the same text\nhere"), (4, "the same text\nhere"), (5, "long " * 20000), *more]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).selectExpr("*", "'x' as _gl_words", "'y' as token", "1L as length")


def test_batches_equal_the_tokenizer():
    all_texts = texts(20000) + [""]
    ids, n = BatchEncoder().encode(pa.array(all_texts + [None]))
    ends = np.concatenate([[0], np.cumsum(n)])
    want = [encoding().encode_ordinary(t) for t in all_texts] + [[]]
    assert [ids[a:z].tolist() for a, z in itertools.pairwise(ends)] == want
    assert BatchEncoder().lengths(pa.array(all_texts)).tolist() == [len(x) for x in want[:-1]]


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 100000])
def test_wavelet_round_trip(high):
    r = np.random.default_rng(high)
    for n in (0, 1, 63, 512, 5000):
        ids = r.integers(0, high, n).astype(np.int32)
        w = Wavelet(build(ids))
        assert w.decode().tolist() == ids.tolist()
        for i in r.integers(0, max(n, 1), 20) if n else []:
            assert w.access(int(i)) == ids[i]
            t = int(ids[i])
            at = np.flatnonzero(ids == t)
            assert w.rank(t) == len(at) and w.rank(t, int(i)) == (at < i).sum()
            assert w.select(t, int((at < i).sum())) == i and w.select(t, len(at)) == -1
        assert w.rank(1 << 20) == 0


def test_steps_open_few_blocks(monkeypatch):
    monkeypatch.setattr(op3, "BLOCK", 1024)
    ids = np.random.default_rng(5).zipf(1.3, 40_000).clip(0, 50_000).astype(np.int32)
    file, asked = build(ids), []
    w = Wavelet(lambda a, n: asked.append(n) or file[a : a + n])
    asked.clear()
    assert w.access(20_000) == ids[20_000] and len(asked) == w.bits
    for i in range(0, 40_000, 371):
        t = int(ids[i])
        assert w.access(i) == t and w.rank(t, i) == (ids[:i] == t).sum() and w.select(t, w.rank(t, i)) == i
    asked.clear()
    w.rank(int(ids[5]), 30_000)
    assert sum(asked) < len(file) / 10
    with pytest.raises(ValueError):
        Wavelet(b"something else")


def test_shards_hold_every_token(spark, tmp_path):
    docs = odd_docs(spark, [(100 + i, t) for i, t in enumerate(texts(300))])
    folder = f"file://{tmp_path}/shards"
    listed = op3.write_shards(docs, folder, shard=500)
    got = []
    for r in listed.collect():
        file = (tmp_path / "shards" / r.shard).read_bytes()
        w = Wavelet(file)
        tokens, (ids, ends) = w.decode(), w.documents()
        assert r.n_bytes == len(file) and r.n_tokens == len(tokens) == (ends[-1] if len(ends) else 0) and r.n_docs == len(ids)
        got += [(d, tokens[a:z].tolist()) for d, (a, z) in zip(ids, itertools.pairwise([0, *ends.tolist()]), strict=True)]
    want = [(r.doc_id, encoding().encode_ordinary(r.text or "")) for r in docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    token = encoding().encode_ordinary(" the")[0]
    found = sorted((str(r.doc_id), r.position) for r in op3.locate(listed, folder, token).collect())
    assert found == sorted((str(d), i) for d, t in want for i, x in enumerate(t) if x == token)
    assert sum(r.n for r in op3.count_token(listed, folder, token).collect()) == len(found)
    rows = sorted(map(str, map(tuple, op3.first_tokens(listed, folder).collect())))
    assert rows == sorted(str((d, len(t), t[0], t.count(t[0]), len(t) - 1 - t[::-1].index(t[0])) if t else (d, 0, None, 0, None)) for d, t in want)
    none = op3.write_shards(docs.limit(0), folder)
    assert none.count() == 0 and op3.first_tokens(none, folder).count() == 0


@pytest.mark.parametrize("head", [1, 5, 10**6])
def test_counts(spark, head):
    docs = odd_docs(spark, [(100 + i, t) for i, t in enumerate(texts(300))])
    want = {}
    for r in docs.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(encoding().encode_ordinary(r.text or ""))
    assert {r.doc_id: r.n_tokens for r in counted(docs, head).collect()} == want
    assert counted(docs.limit(0)).count() == 0


def test_pretokens_are_those_of_the_pattern():
    loose = ["Hello there.  This is\n\n  a web page , with   blanks.\n" * 3, " x", "x ", "  ", "", "a\tb  \n c", *texts(3000)]
    tokens, text, at, n = op8.cut(pa.array(loose))
    got = [{} for _ in loose]
    for i, t, k in zip(text.tolist(), tokens.take(pa.array(at)).to_pylist(), n.tolist()):
        got[i][t] = k
    assert got == [dict(Counter(regex.findall(PATTERN, x))) for x in loose]
    # no key is longer than a word, whatever white space every document has
    long = ["word  and\n word " * 5000] * 3
    assert max(map(len, op8.cut(pa.array(long))[0].to_pylist())) <= 5


def test_fullest_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randrange(1, 20): r.randrange(1, 4) for _ in range(r.randrange(0, 5))}
        room = r.randrange(1, 40)
        chosen = fullest(counts, sorted(counts, reverse=True), room)
        assert all(chosen.count(x) <= counts[x] for x in chosen)
        every = [x for x, c in counts.items() for _ in range(c)]
        best = max(sum(c) for k in range(len(every) + 1) for c in itertools.combinations(every, k) if sum(c) <= room)
        assert sum(chosen) == best


def test_each_bin_is_the_fullest():
    r = random.Random(4)
    sizes = [r.randrange(1, 30) for _ in range(14)]
    left = list(range(len(sizes)))
    for b in pack(sizes, 40):
        others = [i for i in left if i != b[0]]
        best = max(sum(sizes[i] for i in c) for k in range(len(others) + 1) for c in itertools.combinations(others, k) if sum(sizes[i] for i in c) <= 40 - sizes[b[0]])
        assert sum(sizes[i] for i in b) == best + sizes[b[0]]
        left = [i for i in left if i not in b]
    assert not left


def test_packing_holds_every_token_once(spark):
    docs = odd_docs(spark, [(100 + i, t) for i, t in enumerate(texts(300))])
    bins = packed(token_lengths(docs), capacity=64, group=50).collect()
    got = sorted((str(d), s, n) for b in bins for d, s, n in zip(b.doc_ids, b.starts, b.lengths))
    want = []
    for r in docs.collect():
        n = len(encoding().encode_ordinary(r.text or ""))
        want += [(str(r.doc_id), a, min(64, n - a)) for a in range(0, n, 64)]
    assert got == sorted(want)
    assert all(b.used == sum(b.lengths) <= 64 for b in bins)
    assert len({b.bin_id for b in bins}) == len(bins)
    assert packed(token_lengths(docs.limit(0))).count() == 0

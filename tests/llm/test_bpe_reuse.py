import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import op4_bpe_reuse as op4
from gleaner.llm.bpe import TOKENIZERS, VOCABULARY, encoding

PIECES = ["a", "b", " ", " ", " ", "\n", "'s", "'", "\t", "é", "1", " ", "　", "!", "the", "ing", ".", "語", "🙂", " don't", "  "]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.lists(st.integers(0, 60), max_size=5))
def test_joins_give_the_ids_of_the_whole(pieces, at):
    e = encoding()
    text = "".join(pieces)
    points = sorted({0, len(text), *(min(x, len(text)) for x in at)})
    data, parts = text.encode(), []
    for a, z in zip(points, points[1:]):
        x, y = len(text[:a].encode()), len(text[:z].encode())
        parts.append((x, y, np.array(e.encode_ordinary(text[a:z]), np.int32)))
    if parts:
        assert op4.Joiner(TOKENIZERS, VOCABULARY).join(data, parts).tolist() == e.encode_ordinary(text)


def test_cuts_follow_the_content():
    r = random.Random(1)
    passage = " ".join("".join(r.choice("abcdeé") for _ in range(6)) for _ in range(3000)).encode()
    one, two = passage, b"something before " * 7 + passage + b" after"
    a = {one[x:y] for x, y in op4.chunks(one)}
    b = {two[x:y] for x, y in op4.chunks(two)}
    assert len(a & b) >= len(a) - 2 > 5
    for data in (one, two):
        data.decode()
        for x, y in op4.chunks(data):
            data[x:y].decode()
        assert op4.cuts(data)[-1] == len(data)
    assert op4.cuts(b"").tolist() == [] and op4.chunks(b"short") == []


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghiéß") for _ in range(r.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(80):
        body = [" ".join(word() for _ in range(r.randrange(0, 300))) for _ in range(3)]
        body[1:1] = r.sample(passages, r.randrange(0, 3))
        rows.append((i, r.choice([" ", "\n", "", "  "]).join(body)))
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(5, rows[6][1]), rows[7], rows[7], (None, rows[8][1]), (None, "x"), (300, None), (301, ""), (302, passages[0] * 60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as doc", "2 as h", "3 as l", "map(1, 2) as ids")


def test_equal_to_the_tokenizer_and_back(spark, docs):
    got = op4.encoded(docs).collect()
    want = [(r.doc_id, encoding().encode_ordinary(r.text or "")) for r in docs.collect()]
    assert sorted((str(r.doc_id), op4.unpack_ids(r.ids).tolist()) for r in got) == sorted((str(i), x) for i, x in want)
    assert all(r.n_tokens == len(r.ids) // 2 for r in got)
    back = op4.decoded(op4.encoded(docs)).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert op4.encoded(docs.limit(0)).count() == 0

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gleaner.llm import op5_topk as op5
from gleaner.llm import op7_toxicity as op7

DOCS = "doc_id bigint, text string"


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 12))
    x[200:] = x[:100] + r.normal(size=(100, 12)) * 0.1
    x[50] = x[51]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0] * 11 + [None]), (None, [1.0] * 12), (904, [1.0, 2.0]), (905, [2.0, 1.0]), (5, x[5].tolist()), (906, [])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").selectExpr("*", "1 as e", "2 as unit", "3 as dims", "4 as norm")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, op5.DIGITS) + 0.0
    for asks, asked in ((None, 1 << 20), (None, 40), (F.col("vec_id") % 7 == 0, 1 << 20)):
        got = {}
        for row in op5.top_k(df, asks, k=5, block=64, asked=asked).collect():
            got.setdefault(row.vec_id, {})[row.rank] = (row.neighbour, row.score)
        for i in range(300):
            best = sorted((-s[i, j], j) for j in range(300) if j != i)[:5]
            if asks is None or i % 7 == 0:
                assert [got[i][k + 1] for k in range(5)] == [(j, -z) for z, j in best]
            else:
                assert i not in got
        if asks is None:
            assert got[904] == {1: (905, 0.8)} and not {900, 901, 902, 903, 906, None} & set(got)
    assert op5.top_k(df.limit(0)).count() == 0 and op5.top_k(df, F.lit(False)).count() == 0


def test_bound_is_one():
    r = np.random.default_rng(4)
    for _ in range(200):
        x = r.normal(size=(50, 6)) * r.uniform(0.1, 2, 6)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        q = r.normal(size=(5, 6))
        assert (op5.bound(q, x.min(0), x.max(0)) >= (q @ x.T).max(1) - 1e-12).all()


def test_bound_stops_early():
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 64)) * 0.9 ** np.arange(64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists, best = op5.Lists(np.arange(4000), x), op5.Best(50, 5)
    depths = lists.search(np.arange(50), x[:50], best)
    s = np.round(x @ x[:50].T, op5.DIGITS) + 0.0
    for i in range(50):
        assert best.ids[i].tolist() == sorted((j for j in range(4000) if j != i), key=lambda j: (-s[j, i], j))[:5]
    # groups far apart: once a query has its own group, the other groups' blocks are done unread
    centres = np.linalg.qr(r.normal(size=(64, 8)))[0].T
    best = op5.Best(20, 5)
    found = []
    for g in range(8):
        y = centres[g] + r.normal(size=(2000, 64)) * 0.05
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        if g == 0:
            me, q = np.arange(20), y[:20]
        found.append(op5.Lists(np.arange(2000) + g * 2000, y).search(me, q, best))
    assert not np.array(found[1:]).any() and (best.ids < 2000).all()
    assert depths.max() < 1000


def toxic_docs(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    out = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(5, 60))]
        kind = r.randrange(6)
        if kind == 0:
            w += ["dolt", "martians"]
        elif kind == 1:
            w += ["dolt"]
        elif kind == 2:
            w += ["martians"]
        elif kind == 3 and r.random() < 0.5:
            w += ["zorgl" + word()]
            kind = 0
        r.shuffle(w)
        out.append((i, " ".join(w), int(kind == 0)))
    return out


def test_pairs_count_more_than_their_terms(spark):
    known, new = toxic_docs(1500, 1), toxic_docs(600, 2)
    docs = spark.createDataFrame([x[:2] for x in known], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in known], "doc_id bigint, toxic int")
    m = op7.train(docs, labels)
    p = m.score(pa.array([t for _, t, _ in new])) >= 0.5
    y = np.array([y for *_, y in new]) == 1
    assert (p & y).sum() >= 0.95 * y.sum() and (p & ~y).sum() <= 0.02 * (~y).sum()
    flat = op7.Machine(m.term, m.w, np.zeros_like(m.v), m.w0).score(pa.array([t for _, t, _ in new])) >= 0.5
    assert ((flat != y).sum()) > (p != y).sum()


def test_logits_are_the_sum_over_pairs():
    r = np.random.default_rng(3)
    m = op7.Machine(np.arange(6, dtype=np.uint32), r.normal(size=6), r.normal(size=(6, op7.FACTORS)), 0.3)
    has = [sorted(r.choice(6, k, replace=False).tolist()) for k in (0, 1, 2, 4, 6)]
    doc, at = np.array([(i, t) for i, x in enumerate(has) for t in x]).T
    want = [m.w0 + sum(m.w[t] for t in x) + sum(float(m.v[s] @ m.v[t]) for k, s in enumerate(x) for t in x[k + 1 :]) for x in has]
    assert np.allclose(m.logits(doc, at, len(has)), want)


def test_terms_that_tell_only_in_pairs():
    def probe(n, seed):
        r = random.Random(seed)
        words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 8))) for _ in range(3000)]
        out = []
        for _ in range(n):
            w, u = [r.choice(words) for _ in range(r.randrange(30, 60))], r.random()
            kind = 1 if u < 0.04 else 2 if u < 0.2 else 0
            w += [["dolt"], ["martian"], [], [], [], [], [], [], [], []][r.randrange(10)] if kind == 0 else ["dolt", "martian"] if kind == 1 else [r.choice(["zorgl", "fnarf"])]
            r.shuffle(w)
            out.append((" ".join(w), kind))
        return out

    known, new = probe(6000, 1), probe(3000, 2)
    doc, term = op7.terms(pa.array([t for t, _ in known]))
    m = op7.fit(doc, term, np.array([float(k > 0) for _, k in known]))
    p, kind = m.score(pa.array([t for t, _ in new])) >= 0.5, np.array([k for _, k in new])
    assert p[kind == 1].mean() >= 0.9 and p[kind == 2].mean() >= 0.95 and p[kind == 0].mean() <= 0.01


def test_only_copies_are_left_out():
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(80)) for _ in range(50)]
    passage = " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(30))
    many = [x for t in texts for x in (t + " " + passage, t + " " + passage + " more", "")]
    assert op7.Copies().fresh(pa.array(many)).tolist() == sorted([3 * i for i in range(50)] + [3 * i + 2 for i in range(50)])


def test_odd_rows_and_missing_classes(spark, tmp_path):
    known = toxic_docs(600, 3)
    rows = [x[:2] for x in known] + [(None, "dolt martians"), (1000, None), (1001, ""), (1002, "dolt martians " + "plain " * 50000), (1002, "dolt martians")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as y", "2 as p_toxic", "3 as toxic")
    labels = spark.createDataFrame([(i, y) for i, _, y in known] + [(None, 1), (0, None)], "doc_id bigint, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = [r.doc_id for r in op7.op7_toxicity(spark, str(tmp_path)).collect()]
    assert got.count(1002) == 2 and None in got and not {1000, 1001} & set(got)
    for none in (labels.where("toxic = 0"), labels.limit(0), labels.where("toxic = 1")):
        m = op7.train(docs, none)
        assert op7.scored(docs, m).where("p_toxic >= 0.5").count() == 0
    assert op7.scored(docs.limit(0), m).count() == 0

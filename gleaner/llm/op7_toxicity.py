"""Toxicity by a factorization machine over hashed terms.

Terms are words and prefixes of words (which carry over to inflected forms), hashed to 32 bits; a document has a term
or not. Several words of one prefix are a further term. The machine's terms are those that tell something alone (log odds of
toxic of LEAST_ODDS, and SCREEN standard errors) and those of pairs that tell more together than both do alone: all
pairs of terms that LEAST_PAIR toxic documents have are counted, and a pair enters if toxic documents have it more often
than chance, if its log odds pass those of both terms together by LEAST_ODDS, and if so
many of the documents with both are toxic that this is SCREEN_PAIR standard errors off. So an insult and a group that are each as frequent in clean documents still meet in the machine:
logit = w0 + sum of w + sum over pairs of <v_i, v_j>.

It is fitted on a bounded sample of LABELLED labelled documents, taken by the least hash of their doc_id, in one
task; of copies within the sample (Jaccard similarity of word trigrams of COPY or more) one counts, lest the words of
one often-copied text become terms. Every document's whole text is scored where it is read; only the model, a few
thousand rows, is sent.

Defined results: NULL and empty texts have no terms and aren't flagged, unless every labelled document is toxic; very long ones are
scored whole. Without any toxic, or any clean, labelled document nothing is flagged. Repeated rows are scored each for
itself. Labels NULL are left out; several labels of a document are averaged, half toxic is toxic. Equal hashes of doc_ids are taken by
doc_id; a probability of exactly THRESHOLD is flagged. An empty table of documents gives no rows, one of labels flags nothing.
Columns but doc_id, text and toxic, of whatever names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import sliced, table
from gleaner.llm.ngrams import hash32, minhash, mix, normal_words, shingles

#: Bound of the sample that is fitted, in documents.
LABELLED = 10_000
PREFIXES = (4, 5, 6)
#: So many words of one prefix in a document are a term of their own.
FORMS = (2, 3)
FACTORS = 8
SCREEN = 3.3
SCREEN_PAIR = 5.0
LEAST = 4
LEAST_PAIR = 20
LEAST_ODDS = 1.5
COPY = 0.5
THRESHOLD = 0.5
PART = 1000


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) pairs without repetition."""
    coded, per = normal_words(texts)
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    n = max(1, len(words))
    pairs = np.unique(np.repeat(np.arange(len(per)), per) * n + codes)
    doc, code = pairs // n, pairs % n
    columns = [hash32(words)]
    length = pc.utf8_length(words).to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    for k in PREFIXES:
        heads = pc.utf8_slice_codeunits(words, 0, k).dictionary_encode()
        hashed = hash32(heads.dictionary, k)
        columns.append(np.where(length > k, hashed[heads.indices.to_numpy().astype(np.int64)], 0).astype(np.uint32) if len(words) else hashed)
    keys = [doc.astype(np.uint64) << np.uint64(32) | columns[0][code]]
    for k, c in zip(PREFIXES, columns[1:]):
        has = length[code] > k
        heads, forms = np.unique(doc[has].astype(np.uint64) << np.uint64(32) | c[code[has]], return_counts=True)
        keys += [heads] + [heads[forms >= m] ^ np.uint64(m * 0x9E3779B1 & 0xFFFFFFFF) for m in FORMS]
    found = np.unique(np.concatenate(keys))
    return (found >> np.uint64(32)).astype(np.int64), (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class Copies:
    """Tells texts that are no copies of earlier ones: those that share a minhash are compared."""

    def __init__(self):
        self.seen: tuple[dict, ...] = ({}, {}, {}, {})

    def fresh(self, texts: pa.Array) -> np.ndarray:
        sets, sizes = shingles(texts, 3)
        ends, keep = np.cumsum(sizes), []
        for i, row in enumerate(minhash(sets, sizes, len(self.seen)).tolist()):
            own = sets[ends[i] - sizes[i] : ends[i]]
            if sizes[i]:
                met = {id(x): x for k, s in zip(row, self.seen) for x in s.get(k, ())}
                if any(alike(own, x) >= COPY for x in met.values()):
                    continue
                for k, s in zip(row, self.seen):
                    s.setdefault(k, []).append(own)
            keep.append(i)
        return np.array(keep, np.int64)


def alike(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    s, l = (x, y) if len(x) <= len(y) else (y, x)
    if len(s) < COPY * len(l):
        return 0.0
    common = int((l[np.minimum(np.searchsorted(l, s), len(l) - 1)] == s).sum())
    return common / (len(x) + len(y) - common)


class Machine:
    """Terms (sorted), their weights and factors."""

    def __init__(self, term: np.ndarray, w: np.ndarray, v: np.ndarray, w0: float):
        self.term, self.w, self.v, self.w0 = term, w, v, w0

    def logits(self, doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        s = np.stack([np.bincount(doc, self.v[at, f], n) for f in range(self.v.shape[1])], 1)
        own = np.bincount(doc, (self.v[at] ** 2).sum(1), n)
        return self.w0 + np.bincount(doc, self.w[at], n) + 0.5 * ((s**2).sum(1) - own)

    def known(self, doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.term):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.term, term), len(self.term) - 1)
        has = self.term[at] == term
        return doc[has], at[has]

    def score(self, texts: pa.Array) -> np.ndarray:
        doc, at = self.known(*terms(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(doc, at, len(texts)), -30, 30)))


def log_odds(a, b, n1: float, n0: float) -> tuple[np.ndarray, np.ndarray]:
    """Of toxic with and without what `a` toxic and `b` clean documents have, and the standard error."""
    odds = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    return odds, np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def paired(doc: np.ndarray, at: np.ndarray, y: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The terms of pairs that tell more than both terms do alone."""
    n1, n0 = y.sum(), (1 - y).sum()
    a = np.bincount(at, y[doc], len(odds))
    # of terms that the same documents have, one is enough
    stamp = np.zeros(len(odds), np.uint64)
    np.add.at(stamp, at, mix(doc.astype(np.uint64) + np.uint64(1)))
    first = np.zeros(len(odds), bool)
    first[np.unique(stamp, return_index=True)[1]] = True
    term = np.flatnonzero((a >= LEAST_PAIR) & first)
    place = np.full(len(odds), -1)
    place[term] = np.arange(len(term))
    # the toxic documents, and as many clean ones, spread evenly
    some = np.flatnonzero(y == 0)[:: max(1, int(n0 / n1))]
    sides = [_matrix(doc, at, place, len(term), np.flatnonzero(y == 1)), _matrix(doc, at, place, len(term), some)]
    own, count = odds[term].astype(np.float32), a[term].astype(np.float32)
    left, right, toxic = [], [], []
    for k in range(0, len(term), 512):
        both, clean = (x[:, k : k + 512].T @ x for x in sides)
        chance = count[k : k + 512, None] * count / np.float32(n1)
        i, j = np.nonzero((both >= LEAST_PAIR) & (both > chance + 4 * np.sqrt(chance)) & (both / np.float32(n1) > 2 * clean / np.float32(len(some))))
        i, j = i[i + k < j], j[i + k < j]
        p, apart = both[i, j], own[i + k] + own[j]
        # by the clean documents looked at so far, and what wouldn't be enough without any
        fair = (log_odds(p, clean[i, j], n1, len(some))[0] > apart + LEAST_ODDS / 2) & (p >= SCREEN_PAIR**2 * n1 / n0 * np.exp(apart))
        left.append(i[fair] + k)
        right.append(j[fair])
        toxic.append(p[fair])
    left, right, toxic = np.concatenate([[], *left]).astype(int), np.concatenate([[], *right]).astype(int), np.concatenate([[], *toxic])
    found = np.zeros(len(odds), bool)
    if not len(left):
        return found
    # all clean documents of the pairs that are left
    some, where = np.unique(np.concatenate([left, right]), return_inverse=True)
    narrow = np.full(len(odds), -1)
    narrow[term[some]] = np.arange(len(some))
    has = np.zeros((len(some), len(y)), bool)
    use = narrow[at] >= 0
    has[narrow[at[use]], doc[use]] = True
    has = np.packbits(has[:, y == 0], axis=1)
    i, j = where[: len(left)], where[len(left) :]
    clean = np.concatenate([np.bitwise_count(has[i[k : k + 4096]] & has[j[k : k + 4096]]).sum(1) for k in range(0, len(i), 4096)]).astype(float)
    apart = own[left] + own[right]
    # toxic documents among those with both, against what the terms' odds add up to
    chance = 1 / (1 + np.exp(-(np.log(n1 / n0) + apart)))
    far = toxic - (toxic + clean) * chance >= SCREEN_PAIR * np.sqrt((toxic + clean) * chance * (1 - chance))
    more = far & (log_odds(toxic, clean, n1, n0)[0] - apart >= LEAST_ODDS)
    found[term[left[more]]] = True
    found[term[right[more]]] = True
    return found


def _matrix(doc: np.ndarray, at: np.ndarray, place: np.ndarray, width: int, docs: np.ndarray) -> np.ndarray:
    """Documents by terms, 1 where a document has a term."""
    row = np.full(int(max(doc.max(), docs.max())) + 1, -1)
    row[docs] = np.arange(len(docs))
    use = (row[doc] >= 0) & (place[at] >= 0)
    x = np.zeros((len(docs), width), np.float32)
    x[row[doc[use]], place[at[use]]] = 1
    return x


def fit(doc: np.ndarray, term: np.ndarray, y: np.ndarray, epochs: int = 150, rate: float = 0.4, ridge: float = 1e-5) -> Machine:
    """Screening of terms and of pairs, then full-batch Adagrad on the log loss."""
    n, n1 = len(y), y.sum()
    n0 = n - n1
    none = Machine(np.zeros(0, np.uint32), np.zeros(0), np.zeros((0, FACTORS)), -30.0)
    if not n1 or not n0:
        return none
    found, count = np.unique(term, return_counts=True)
    found = found[count >= LEAST]
    if not len(found):
        return none
    at = np.minimum(np.searchsorted(found, term), len(found) - 1)
    often = found[at] == term
    doc, at = doc[often], at[often]
    odds, error = log_odds(np.bincount(at, y[doc], len(found)), np.bincount(at, 1 - y[doc], len(found)), n1, n0)
    good = np.abs(odds) >= np.maximum(SCREEN * error, LEAST_ODDS)
    good |= paired(doc, at, y, odds)
    new = np.cumsum(good) - 1
    use = good[at]
    doc, at = doc[use], new[at[use]]
    k = int(good.sum())
    if not k:
        return none
    m = Machine(found[good], np.zeros(k), np.random.default_rng(0).normal(0, 0.01, (k, FACTORS)), float(np.log((n1 + 1) / (n0 + 1))))
    gw, gv, g0 = np.full(k, 1e-8), np.full((k, FACTORS), 1e-8), 1e-8
    weight = np.where(y == 1, min(4.0, n0 / n1), 1.0)
    for _ in range(epochs):
        s = np.stack([np.bincount(doc, m.v[at, f], n) for f in range(FACTORS)], 1)
        z = m.logits(doc, at, n)
        e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        d = e[doc]
        dw = np.bincount(at, d, k) + ridge * m.w / k
        dv = np.stack([np.bincount(at, d * (s[doc, f] - m.v[at, f]), k) for f in range(FACTORS)], 1) + ridge * m.v
        d0 = e.sum()
        gw += dw**2
        gv += dv**2
        g0 += d0**2
        m.w -= rate * dw / np.sqrt(gw)
        m.v -= 0.3 * rate * dv / np.sqrt(gv)
        m.w0 -= rate * d0 / np.sqrt(g0)
    return m


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Machine:
    """Fits in one task; the model alone comes to the driver."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("y")).where("y is not null")
    said = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # at most `bound` rows of two columns are broadcast, so that no text is shuffled
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(said), "doc_id").select("text", F.col("y").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies, docs_of, terms_of, y, n = Copies(), [], [], [], 0
        for part in sliced(batches, PART):
            keep = copies.fresh(part.column(0))
            doc, term = terms(part.column(0).take(pa.array(keep)))
            docs_of.append((doc + n).astype(np.int32))
            terms_of.append(term)
            y.append(part.column(1).to_numpy().astype(float)[keep])
            n += len(keep)
        if not n:
            return
        m = fit(np.concatenate(docs_of), np.concatenate(terms_of), np.concatenate(y))
        yield pa.RecordBatch.from_arrays([pa.array([m.term.tobytes()]), pa.array([m.w.tobytes()]), pa.array([m.v.tobytes()]), pa.array([m.w0])], ["term", "w", "v", "w0"])

    rows = sample.repartition(1).sortWithinPartitions("text", "y").mapInArrow(run, "term binary, w binary, v binary, w0 double").collect()
    if not rows:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0))
    r = rows[0]
    return Machine(np.frombuffer(r.term, np.uint32), np.frombuffer(r.w), np.frombuffer(r.v).reshape(-1, FACTORS), r.w0)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in sliced(batches, PART):
            yield pa.RecordBatch.from_arrays([p.column(0), pa.array(shared.value.score(p.column(1)))], ["doc_id", "p_toxic"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, p_toxic double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are flagged, with their probability. Documents that aren't flagged have no row."""
    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, machine).where(F.col("p_toxic") >= THRESHOLD).select("doc_id", F.round("p_toxic", 4).alias("p_toxic"))

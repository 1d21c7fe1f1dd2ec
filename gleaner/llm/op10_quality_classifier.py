"""Quality classifier: hierarchical empirical Bayes.

A naive Bayes model over binned text statistics, fitted on all labelled documents by grouped counts, gives each
document's evidence. Summed by host and by path it gives their posteriors (a labelled document counts with its
label, another with its probability): a host's rate is shrunk toward the global rate, a path's toward its host's, each
by a strength estimated from the spread between groups (method of moments). A document's final log odds are its
evidence plus those of its path.

host and section are parameters: any two columns. The table documents has no URL, so source stands in for the host, and
lang for the first part of the path.

Documents are counted once by host, path, bins and label (partial counts first, so a hot host moves few rows); both
model and posteriors follow from these cells. The table of paths is written and counted before it is joined back: up to
common.BROADCAST_ROWS paths are broadcast, beyond that documents are shuffled by path and a salt. The stage writes the
documents with their bins once, so that statistics aren't computed again for the join.

Defined results: texts that are NULL or have no words are rejected. Very long texts are judged whole. NULL hosts or sections
count as ''. Without labels the evidence is 0 and every other document is kept. A probability of exactly KEEP is kept. Repeated
rows count, and are judged, each for itself; several labels of a document are averaged, half good is good. An empty table
gives an empty result. Extra columns, of whatever names, are kept by the stage and clash with nothing, as the row is
carried as one struct.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_ROWS, looked_up, materialize, table
from gleaner.llm.textstats import STATS, STATS_SQL, with_stats

#: Upper bounds of the bins of each statistic: permille, and characters of ten words.
BINS = {"sym": (2, 10, 30, 100), "up": (30, 100, 250, 400), "rep": (300, 500, 650, 800), "adj": (20, 100, 250, 500), "len": (30, 50, 80, 120)}
SMOOTH = 1.0
KEEP = 0.5
STRENGTH = (1.0, 1e6)
#: A path's rate keeps this far from 0 and 1.
EDGE = 1e-6


def bin_of(name: str) -> F.Column:
    return sum((F.col(name) >= b).cast("int") for b in BINS[name])


def binned(docs: DataFrame, host: str = "source", section: str = "lang") -> DataFrame:
    """doc (the whole row), doc_id, host, path, words and the bins."""
    h = F.coalesce(F.col(host).cast("string"), F.lit(""))
    path = F.concat(h, F.lit("/"), F.coalesce(F.col(section).cast("string"), F.lit("")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    out = with_stats(docs.select(whole, F.col("doc_id"), h.alias("host"), path.alias("path"), F.col("text")))
    return out.withColumns({f"b_{n}": bin_of(n) for n in BINS}).drop("text", *(c for c in STATS if c != "words"))


def cells(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by host, path, bins and label (NULL where there is none)."""
    said = labels.groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("good")).where("good is not null and doc_id is not null")
    slim = features.select("doc_id", "host", "path", *(f"b_{n}" for n in BINS))
    return slim.join(said, "doc_id", "left").groupBy("host", "path", *(f"b_{n}" for n in BINS), "good").agg(F.count(F.lit(1)).alias("n"))


def fit(found: DataFrame) -> tuple[dict[str, list[float]], float]:
    """Log likelihood ratios by statistic and bin, and the log odds of good among the labelled. At most 25 rows reach the driver."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("f"), F.col(f"b_{n}").alias("b")) for n in BINS))).alias("x")
    known = found.where("good is not null").select("good", "n", pairs)
    counts = known.groupBy("x.f", "x.b").agg(F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("n0")).collect()
    at = {(r.f, r.b): (r.n1, r.n0) for r in counts}
    n1 = sum(v[0] for k, v in at.items() if k[0] == "sym")
    n0 = sum(v[1] for k, v in at.items() if k[0] == "sym")
    ratio = {}
    for name, bounds in BINS.items():
        k = len(bounds) + 1
        rows = [at.get((name, b), (0, 0)) for b in range(k)]
        ratio[name] = [math.log((a + SMOOTH) / (n1 + SMOOTH * k)) - math.log((z + SMOOTH) / (n0 + SMOOTH * k)) for a, z in rows]
    return ratio, math.log((n1 + 1) / (n0 + 1))


def evidence(ratio: dict[str, list[float]]) -> F.Column:
    return sum(F.get(F.array(*map(F.lit, v)), F.col(f"b_{n}")) for n, v in ratio.items())


def sigmoid(x) -> F.Column:
    return 1 / (1 + F.exp(-x))


def logit(p) -> F.Column:
    return F.log(p) - F.log(1 - p)


def strength(spread, rate, groups, n) -> F.Column:
    """Pseudo-count of a beta prior, from the spread between groups less what sampling explains."""
    between = F.greatest(spread / n - rate * (1 - rate) * groups / n, F.lit(1e-9))
    return F.least(F.greatest(rate * (1 - rate) / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def posteriors(found: DataFrame, ratio: dict[str, list[float]], base: float) -> DataFrame:
    """Per path: its rate and its host's, both shrunk."""
    p = F.when(F.col("good").isNull(), sigmoid(evidence(ratio) + base)).otherwise(F.col("good").cast("double"))
    paths = found.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum(F.col("n") * p).alias("s"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("tn"), F.sum("hs").alias("ts"), F.count(F.lit(1)).alias("th"))
    rated = hosts.crossJoin(F.broadcast(total)).withColumn("mu", F.col("ts") / F.col("tn"))
    spread = rated.groupBy("tn", "th", "mu").agg(F.sum(F.col("hn") * (F.col("hs") / F.col("hn") - F.col("mu")) ** 2).alias("v"))
    m = spread.select("mu", strength(F.col("v"), F.col("mu"), F.col("th"), F.col("tn")).alias("m"))
    hosts = hosts.crossJoin(F.broadcast(m)).withColumn("host_rate", (F.col("hs") + F.col("m") * F.col("mu")) / (F.col("hn") + F.col("m")))
    both = paths.join(hosts.select("host", "host_rate", "mu"), "host")
    d = F.col("s") / F.col("n") - F.col("host_rate")
    spread = both.groupBy("mu").agg(F.sum(F.col("n") * d * d).alias("v"), F.count(F.lit(1)).alias("g"), F.sum("n").alias("tn"))
    m2 = spread.select(strength(F.col("v"), F.col("mu"), F.col("g"), F.col("tn")).alias("m2"))
    rate = (F.col("s") + F.col("m2") * F.col("host_rate")) / (F.col("n") + F.col("m2"))
    return both.crossJoin(F.broadcast(m2)).select("host", "path", "host_rate", F.least(F.greatest(rate, F.lit(EDGE)), F.lit(1 - EDGE)).alias("path_rate"))


def judged(features: DataFrame, labels: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The written features with p, host_rate and path_rate."""
    found = materialize(cells(features, labels), "cells")
    ratio, base = fit(found)
    out = looked_up(features, materialize(posteriors(found, ratio, base), "paths"), ["host", "path"], "doc_id", most=most)
    p = sigmoid(evidence(ratio) + logit(F.col("path_rate")))
    return out.withColumn("p", F.when(F.col("words") > 0, p).otherwise(0.0))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their probability of being good and the rates of their host and path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judged(materialize(binned(docs).drop("doc"), "quality"), table(spark, sf_dir, "labels")).where(F.col("p") >= KEEP).select(
        "doc_id", F.round("p", 4).alias("p_quality"), F.round("host_rate", 4).alias("host_rate"), F.round("path_rate", 4).alias("path_rate")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, host: str = "source", section: str = "lang", most: int = BROADCAST_ROWS) -> DataFrame:
    """Documents that are kept, with all their columns."""
    features = materialize(binned(docs, host, section), "quality")
    return judged(features, table(spark, sf_dir, "labels"), most).where(F.col("p") >= KEEP).select("doc.*")


def _bin_sql(name: str) -> str:
    return " + ".join(f"({name} >= {b})::INT" for b in BINS[name])


def _strength_sql(spread: str, rate: str, groups: str, n: str) -> str:
    return f"least(greatest({rate} * (1 - {rate}) / greatest({spread} / {n} - {rate} * (1 - {rate}) * {groups} / {n}, 1e-9) - 1, {STRENGTH[0]}), {STRENGTH[1]})"


def sql_ctes(labels: str = "labels") -> str:
    long = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS f, {len(b) + 1} AS k, b_{n} AS b FROM ft" for n, b in BINS.items())
    grid = ", ".join(f"('{n}', {i}, {len(b) + 1})" for n, b in BINS.items() for i in range(len(b) + 1))
    llr = " + ".join(f"{n}.r" for n in BINS)
    joins = " ".join(f"JOIN ratio {n} ON {n}.f = '{n}' AND {n}.b = ft.b_{n}" for n in BINS)
    return f"""{STATS_SQL},
 ft AS (SELECT doc_id, words, coalesce(source, '') AS host, coalesce(source, '') || '/' || coalesce(lang, '') AS path,
               {", ".join(f"{_bin_sql(n)} AS b_{n}" for n in BINS)} FROM st),
 said AS (SELECT doc_id, avg(quality) >= 0.5 AS good FROM {labels} WHERE quality IS NOT NULL GROUP BY doc_id),
 lg AS (SELECT * FROM ({long})),
 cnt AS (SELECT f, b, count(*) FILTER (good) AS n1, count(*) FILTER (NOT good) AS n0 FROM lg JOIN said USING (doc_id) GROUP BY f, b),
 tot AS (SELECT coalesce(sum(n1), 0) AS t1, coalesce(sum(n0), 0) AS t0 FROM cnt WHERE f = 'sym'),
 grid(f, b, k) AS (VALUES {grid}),
 ratio AS (SELECT g.f, g.b, ln((coalesce(n1, 0) + {SMOOTH}::DOUBLE) / (t1 + {SMOOTH}::DOUBLE * k)) - ln((coalesce(n0, 0) + {SMOOTH}::DOUBLE) / (t0 + {SMOOTH}::DOUBLE * k)) AS r
           FROM grid g LEFT JOIN cnt USING (f, b) CROSS JOIN tot),
 ev AS (SELECT ft.*, {llr} AS e, ln((t1 + 1.0::DOUBLE) / (t0 + 1)) AS base FROM ft {joins} CROSS JOIN tot),
 paths AS (SELECT host, path, count(*) AS n, sum(CASE WHEN good IS NULL THEN 1 / (1 + exp(-(e + base))) ELSE good::INT END) AS s FROM ev LEFT JOIN said USING (doc_id) GROUP BY host, path),
 h0 AS (SELECT host, sum(n)::DOUBLE AS hn, sum(s) AS hs FROM paths GROUP BY host),
 t AS (SELECT sum(hn) AS tn, sum(hs) / sum(hn) AS mu, count(*) AS th FROM h0),
 m1 AS (SELECT mu, {_strength_sql("v", "mu", "th", "tn")} AS m FROM (SELECT tn, th, mu, sum(hn * pow(hs / hn - mu, 2)) AS v FROM h0, t GROUP BY ALL)),
 h1 AS (SELECT host, mu, (hs + m * mu) / (hn + m) AS host_rate FROM h0, m1),
 p0 AS (SELECT p.*, host_rate, mu FROM paths p JOIN h1 USING (host)),
 m2 AS (SELECT {_strength_sql("v", "mu", "g", "tn")} AS m2 FROM (SELECT mu, sum(n * pow(s / n - host_rate, 2)) AS v, count(*) AS g, sum(n)::DOUBLE AS tn FROM p0 GROUP BY mu)),
 p1 AS (SELECT host, path, host_rate, least(greatest((s + m2 * host_rate) / (n + m2), {EDGE}), 1 - {EDGE}) AS path_rate FROM p0, m2),
 jd AS (SELECT doc_id, CASE WHEN words > 0 THEN 1 / (1 + exp(-(e + ln(path_rate) - ln(1 - path_rate)))) ELSE 0 END AS p, host_rate, path_rate FROM ev JOIN p1 USING (host, path))
"""


SQL = f"WITH {sql_ctes()} SELECT doc_id, round(p, 4) AS p_quality, round(host_rate, 4) AS host_rate, round(path_rate, 4) AS path_rate FROM jd WHERE p >= {KEEP}"

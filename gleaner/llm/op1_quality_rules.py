"""Quality rules at the level of hosts.

Each document is held against rules on its text statistics. Failures are aggregated by host; each rule's rate is
shrunk by a beta prior whose mean and strength come from the hosts themselves (method of moments), so that a host of
few documents stays near the global rate. A host is bad when its shrunk rate of documents that fail any rule passes
BAD, and is trusted in a rule that hardly any of its documents fail (TRUSTED). A trusted host's document is forgiven
such a failure where it is over the rule's threshold, but not over the rule's definite one.
Rejected: all documents of a bad host, those that fail a rule in which their host isn't trusted, and those that fail
one definitely.

The hosts' table is written and counted before it is joined back: up to common.BROADCAST_ROWS hosts are broadcast, so that no
document moves; beyond that documents are shuffled by host and a salt. The stage writes the documents with their flags
once, so that statistics aren't computed again for the join.

Defined results: a text that is NULL or has no words fails the rule "empty", definitely. A NULL host counts as ''. Very long
texts are judged whole. A value that equals a threshold passes the rule. Repeated rows count, and are judged, each for itself. An
empty table gives an empty result. Extra columns, of whatever names, are kept by the stage and clash with nothing, as
the row is carried as one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import BROADCAST_ROWS, looked_up, materialize, table
from gleaner.llm.textstats import STATS, STATS_SQL, with_stats

#: Name: the condition, and that of a definite failure, in the columns chars, words, sym, up, rep and adj
#: (permille of characters or words). Both engines take them as they are.
RULES = {
    "empty": ("words = 0", "words = 0"),
    "symbols": ("sym > 30", "sym > 60"),
    "capitals": ("up > 400 and words >= 3", "up > 600 and words >= 3"),
    "repeats": ("rep > 650 and words >= 20", "rep > 850 and words >= 20"),
    "stutter": ("adj > 250 and words >= 10", "adj > 400 and words >= 10"),
}
BAD = 0.5
TRUSTED = 0.002
STRENGTH = (1.0, 1e6)


def checked(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc (the whole row), host and, for each rule, 0, 1 where the document fails it, 2 where definitely."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    out = with_stats(docs.select(whole, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text")))
    flags = {f"f_{n}": F.expr(f"case when {sure} then 2 when {fails} then 1 else 0 end") for n, (fails, sure) in RULES.items()}
    return out.withColumns(flags).withColumn("f_any", F.least(F.greatest(*flags), F.lit(1))).drop("text", *STATS)


def verdicts(flags: DataFrame) -> DataFrame:
    """Per host: its shrunk rate of any failure, whether it is bad, and in which rules it is trusted. The prior is one row."""
    names = [*RULES, "any"]
    hosts = flags.groupBy("host").agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(F.least(f"f_{x}", F.lit(1))).alias(f"k_{x}") for x in names))
    total = hosts.agg(F.sum("n").alias("tn"), F.count(F.lit(1)).alias("th"), *((F.sum(f"k_{x}") / F.sum("n")).alias(f"mu_{x}") for x in names))
    apart = hosts.crossJoin(F.broadcast(total)).groupBy("tn", "th", *(f"mu_{x}" for x in names)).agg(*(F.sum(F.col("n") * (F.col(f"k_{x}") / F.col("n") - F.col(f"mu_{x}")) ** 2).alias(f"v_{x}") for x in names))

    def strength(x: str) -> F.Column:
        mu = F.col(f"mu_{x}")
        between = F.greatest(F.col(f"v_{x}") / F.col("tn") - mu * (1 - mu) * F.col("th") / F.col("tn"), F.lit(1e-9))
        return F.least(F.greatest(mu * (1 - mu) / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))

    prior = apart.select(*(f"mu_{x}" for x in names), *(strength(x).alias(f"m_{x}") for x in names))
    rates = hosts.crossJoin(F.broadcast(prior)).select("host", *(((F.col(f"k_{x}") + F.col(f"mu_{x}") * F.col(f"m_{x}")) / (F.col("n") + F.col(f"m_{x}"))).alias(f"r_{x}") for x in names))
    return rates.select("host", "r_any", (F.col("r_any") > BAD).alias("bad"), *((F.col(f"r_{x}") < TRUSTED).alias(f"t_{x}") for x in RULES))


def kept(flags: DataFrame, by: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The written flags with their host's verdict, without the documents that are rejected."""
    rejected = F.col("bad")
    for x in RULES:
        rejected = rejected | (F.col(f"f_{x}") > F.when(F.col(f"t_{x}"), 1).otherwise(0))
    return looked_up(flags, materialize(verdicts(flags), "hosts"), ["host"], by, most=most).where(~rejected)


def judged(docs: DataFrame, host: str = "source", most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, host, n_failed and host_rate of the documents that are kept; only flags are written, no text."""
    flags = checked(docs, host).withColumn("doc_id", F.col("doc.doc_id")).drop("doc")
    failed = sum((F.col(f"f_{x}") > 0).cast("int") for x in RULES)
    return kept(materialize(flags, "rules"), "doc_id", most).select("doc_id", "host", failed.alias("n_failed"), F.round("r_any", 4).alias("host_rate"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with the number of rules they fail (forgiven ones) and their host's shrunk rate."""
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, host: str = "source", most: int = BROADCAST_ROWS) -> DataFrame:
    """Documents that are kept, with all their columns."""
    flags = materialize(checked(docs, host).withColumn("by", F.col("doc.doc_id")), "rules")
    return kept(flags, "by", most).select("doc.*")


def sql_ctes() -> str:
    names = [*RULES, "any"]
    flags = ", ".join(f"CASE WHEN {sure} THEN 2 WHEN {fails} THEN 1 ELSE 0 END AS f_{n}" for n, (fails, sure) in RULES.items())

    def m(x: str) -> str:
        return f"least(greatest(mu_{x} * (1 - mu_{x}) / greatest(v_{x} / tn - mu_{x} * (1 - mu_{x}) * th / tn, 1e-9) - 1, {STRENGTH[0]}), {STRENGTH[1]})"

    return f"""{STATS_SQL},
 f0 AS (SELECT doc_id, coalesce(source, '') AS host, {flags} FROM st),
 fl AS (SELECT *, least(greatest({", ".join(f"f_{n}" for n in RULES)}), 1) AS f_any FROM f0),
 ho AS (SELECT host, count(*)::DOUBLE AS n, {", ".join(f"sum(least(f_{x}, 1)) AS k_{x}" for x in names)} FROM fl GROUP BY host),
 tt AS (SELECT sum(n) AS tn, count(*) AS th, {", ".join(f"sum(k_{x}) / sum(n) AS mu_{x}" for x in names)} FROM ho),
 ap AS (SELECT tn, th, {", ".join(f"mu_{x}, sum(n * pow(k_{x} / n - mu_{x}, 2)) AS v_{x}" for x in names)} FROM ho, tt GROUP BY tn, th, {", ".join(f"mu_{x}" for x in names)}),
 pr AS (SELECT {", ".join(f"mu_{x}, {m(x)} AS m_{x}" for x in names)} FROM ap),
 rt AS (SELECT host, {", ".join(f"(k_{x} + mu_{x} * m_{x}) / (n + m_{x}) AS r_{x}" for x in names)} FROM ho, pr),
 kp AS (SELECT fl.*, r_any FROM fl JOIN rt USING (host)
        WHERE NOT (r_any > {BAD} OR {" OR ".join(f"f_{x} > (CASE WHEN r_{x} < {TRUSTED} THEN 1 ELSE 0 END)" for x in RULES)}))
"""


SQL = f"WITH {sql_ctes()} SELECT doc_id, host, {' + '.join(f'(f_{x} > 0)::INT' for x in RULES)} AS n_failed, round(r_any, 4) AS host_rate FROM kp"

"""robots.txt rules as a table, and the gate as a join on the origin."""

from __future__ import annotations

from urllib.parse import unquote
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.urls import part

RULES = "rules array<struct<path: string, allow: boolean>>, crawl_delay double"


def origin(url: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2))


def parsed_rules(body: Column, agent: str = "*") -> Column:
    """The rules that hold for `agent` in file order, and its delay; NULL for a file that couldn't be fetched."""

    @F.pandas_udf(RULES)
    def run(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for b in bodies:
            rp = RobotFileParser()
            rp.parse((b or "").splitlines())
            group = next((e for e in rp.entries if e.applies_to(agent)), rp.default_entry)
            delay = rp.crawl_delay(agent)
            rules = [{"path": unquote(r.path), "allow": r.allowance} for r in group.rulelines] if group else []
            out.append((None if b is None else rules, None if b is None or delay is None else float(delay)))
        return pd.DataFrame(out, columns=["rules", "crawl_delay"]).astype({"rules": object, "crawl_delay": "float64"})

    return run(body)


def rule_table(files: DataFrame, agent: str = "*") -> DataFrame:
    """(origin, rules, crawl_delay) of `files` (origin, body); one file per origin, the least body of several."""
    one = files.groupBy("origin").agg(F.min("body").alias("body"))
    return one.withColumn("_r", parsed_rules(F.col("body"), agent)).select("origin", "_r.*")


def target(url: Column) -> Column:
    """Path and query, decoded; '/' for none."""
    rest = F.concat(part(url, 3), F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise(""))
    decoded = F.coalesce(F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B"))), rest)
    return F.coalesce(F.nullif(decoded, F.lit("")), F.lit("/"))


def allowed(urls: DataFrame, rules: DataFrame, url: str = "url", enabled: bool = True) -> DataFrame:
    """`urls` with allowed and crawl_delay: the first rule that fits decides; without one, or a file, all is allowed.

    The rule table has one row per origin; the optimizer broadcasts it while that is small.
    """
    df = urls.withColumns({"_origin": origin(F.col(url)), "_target": target(F.col(url))})
    r = rules.select(F.col("origin").alias("_origin"), F.col("rules").alias("_rules"), "crawl_delay")
    df = df.join(r, "_origin", "left")
    fits = F.filter("_rules", lambda x: (x["path"] == "*") | F.col("_target").startswith(x["path"]))
    verdict = F.coalesce(F.get(fits, F.lit(0))["allow"], F.lit(True)) if enabled else F.lit(True)
    return df.withColumn("allowed", verdict).drop("_origin", "_target", "_rules")

"""From raw documents to packed training bins: quality classifier, quality rules, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the docs of the
next. All but the last return the columns of documents, extra ones included, of whatever names.

Defined results: documents without words (NULL, empty or blank texts) are rejected by the first stage. A NULL doc_id keeps its rows through all stages, and
is packed as NULL. Very long texts are judged whole, and cut into several bins at the end. Of rows that share a doc_id one
stays (the least text); of near duplicates the least doc_id. Ties at thresholds are kept. An empty table gives no bins.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import op1_quality_rules, op2_jaccard_join, op9_best_fit_packing, op10_quality_classifier
from gleaner.llm.common import materialize, release, table, tables_made

_left: list[DataFrame] = []


def _stage(f):
    """The stage, which first deletes what earlier ones wrote on their way, unless its docs still read it."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = "\n".join(docs.inputFiles()) if _left else ""
        for df in [x for x in _left if x._written.rpartition("/")[2] not in files]:
            _left.remove(df)
            if df.sparkSession is spark:
                release(df)
        with tables_made() as made:
            out = f(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


STAGES = [
    ("quality_classifier", _stage(op10_quality_classifier.stage)),
    ("quality_rules", _stage(op1_quality_rules.stage)),
    ("near_duplicates", _stage(op2_jaccard_join.stage)),
    ("best_fit_packing", _stage(op9_best_fit_packing.stage)),
]

#: SQL can't express the join of near duplicates and the packing; tests/llm/test_near.py has the pipeline against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

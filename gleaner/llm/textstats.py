"""Per-document text statistics in JVM expressions, and the same in DuckDB SQL.

All statistics are integers (counts and permille), so that both engines agree on every bit of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import words

NOT_SYMBOL = r"[^#$%&*|!{}<>~^=_]+"
NOT_UPPER = "[^A-ZÀ-ÖØ-Þ]+"

STATS = ("chars", "words", "sym", "up", "rep", "adj", "len")


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add character and word counts; symbols, capitals, repeated words and words equal to the one before, in permille; characters of ten words.

    NULL and empty texts have 0 everywhere. `docs` must have none of these names.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumns({"chars": F.length(body), "_ws": words(F.col(text))}).withColumn("words", F.size("_ws"))

    def per(part, whole, of: int = 1000):
        return F.expr(f"cast(({part}) * {of} div greatest({whole}, 1) as int)")

    counts = docs.withColumns(
        {
            "_s": F.length(F.regexp_replace(body, NOT_SYMBOL, "")),
            "_u": F.length(F.regexp_replace(body, NOT_UPPER, "")),
            "_d": F.size(F.array_distinct("_ws")),
            "_a": F.size(F.filter("_ws", lambda x, i: (i > 0) & (x == F.get(F.col("_ws"), i - 1)))),
        }
    )
    return counts.withColumns(
        {
            "sym": per("_s", "chars"),
            "up": per("_u", "chars"),
            "rep": per("words - _d", "words"),
            "adj": per("_a", "words"),
            "len": per("if(words = 0, 0, chars)", "words", 10),
        }
    ).drop("_ws", "_s", "_u", "_d", "_a")


STATS_SQL = r"""
 w AS (SELECT doc_id, text, lang, source, list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x: x <> '') AS ws,
              length(coalesce(text, '')) AS chars FROM documents),
 c AS (SELECT *, len(ws) AS words,
              length(regexp_replace(coalesce(text, ''), '[^#$%&*|!{}<>~^=_]+', '', 'g')) AS s,
              length(regexp_replace(coalesce(text, ''), '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS u,
              len(list_distinct(ws)) AS d,
              len(list_filter(ws, lambda x, i: i > 1 AND x = ws[i - 1])) AS a FROM w),
 st AS (SELECT doc_id, text, lang, source, chars, words,
               s * 1000 // greatest(chars, 1) AS sym, u * 1000 // greatest(chars, 1) AS up,
               (words - d) * 1000 // greatest(words, 1) AS rep, a * 1000 // greatest(words, 1) AS adj,
               (CASE WHEN words = 0 THEN 0 ELSE chars END) * 10 // greatest(words, 1) AS len FROM c)
"""

import duckdb
import pytest

from gleaner.llm import op1_quality_rules as op1
from gleaner.llm import op10_quality_classifier as op10

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
GOOD = "the cat sat on a mat and looked at all of its many friends near an old brown door by the sea"
BAD = "BUY!! NOW!! BUY!! NOW!! " * 8


def rows():
    out = [(i, f"{GOOD} number {i}", "en", f"h{i % 3}", None) for i in range(60)]
    out += [(100 + i, BAD, "en", f"h{i % 3}", None) for i in range(9)]
    out += [(200 + i, BAD, "en", "spam", None) for i in range(40)] + [(250, GOOD, "en", "spam", None)]
    out += [(300, None, None, None, None), (301, "", "en", None, None), (None, GOOD, None, "h2", None), (302, "   ", "de", "h1", 3)]
    out += [(303, " ".join(f"word{i}" for i in range(40000)), "en", "h0", None), (304, GOOD, "en", "solo", None), (304, GOOD, "en", "solo", None)]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("quality")
    docs = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 as _host", "'x' as host", "'y' as p", "map('a', 1) as n", "1 as _gl_words", "2 as words", "3 as path", "4 as f_any", "5 as doc", "6 as _salt", "7 as good")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(i, 0, 0) for i in range(200, 230)] + [(200, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def by_sql(sf_dir, sql):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet/*.parquet'")
    return sorted(map(str, con.sql(sql).fetchall()))


@pytest.mark.parametrize("f, sql", [(op1.op1_quality_rules, op1.SQL), (op10.op10_quality_classifier, op10.SQL)])
def test_equals_sql(spark, tables, f, sql):
    got = [tuple(r) for r in f(spark, tables).collect()]
    assert sorted(map(str, got)) == by_sql(tables, sql)
    ids = [r[0] for r in got]
    assert {i for i in ids if i is not None and i < 60} == set(range(60))
    assert not {i for i in ids if i is not None and 100 <= i < 250}
    assert 300 not in ids and 301 not in ids and 302 not in ids
    assert ids.count(304) == 2 and 303 in ids and None in ids


@pytest.mark.parametrize("op", [op1, op10])
def test_stage_keeps_columns_and_agrees(spark, tables, op):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = op.stage(spark, docs, tables)
    assert kept.schema == docs.schema
    f = op.op1_quality_rules if op is op1 else op.op10_quality_classifier
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(r.doc_id) for r in f(spark, tables).collect())
    assert op.stage(spark, docs.limit(0), tables).count() == 0


def test_bad_host_goes_as_a_whole(spark, tables):
    assert 250 not in {r.doc_id for r in op1.op1_quality_rules(spark, tables).collect()}


def test_small_hosts_are_shrunk(spark, tables):
    docs = spark.createDataFrame([(i, GOOD if i % 2 else BAD, "en", f"h{i // 50}", None) for i in range(200)] + [(900, GOOD, "en", "one", None)], SCHEMA)
    rate = {r.host: r.r_any for r in op1.verdicts(op1.checked(docs)).collect()}
    assert 0.2 < rate["one"] < 0.5 and abs(rate["h0"] - 0.5) < 0.05


def test_trust_forgives_only_what_is_near(spark):
    near = GOOD + " ^^^^"
    rows = [(i, GOOD, "en", "clean", None) for i in range(3000)] + [(5000, near, "en", "clean", None), (5001, BAD, "en", "clean", None), (5002, "", "en", "clean", None)]
    rows += [(6000 + i, GOOD if i % 5 else near, "en", "mixed", None) for i in range(100)]
    got = {r.doc_id: r for r in op1.judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5000].n_failed == 1 and not {5001, 5002, 6000, 6005} & set(got) and len(got) == 3001 + 80


@pytest.mark.parametrize("op", [op1, op10])
def test_many_hosts_give_the_same_without_broadcast(spark, tables, op):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    a, b = (sorted(str(r) for r in op.stage(spark, docs, tables, most=m).select("doc_id", "source").collect()) for m in (0, 1000))
    assert a == b
    assert "source" in op.stage(spark, docs.drop("lang") if op is op1 else docs, tables, host="host").columns


def test_labels_move_their_site(spark, tables):
    docs = spark.createDataFrame([(i, GOOD, "en", f"h{i % 2}", None) for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id bigint, quality int, toxic int")
    rate = {r.host: r.host_rate for r in op10.judged(op10.binned(docs), labels).collect()}
    assert rate["h0"] < 0.35 and rate["h1"] > 0.65


def test_without_labels_all_with_words_stay(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    features = op10.binned(docs)
    assert op10.judged(features, none).where("p >= 0.5").count() == features.where("words > 0").count()

import random

from pyspark.sql import functions as F

from gleaner.llm import common


def test_filter_forgets_no_id(spark):
    r = random.Random(3)
    ids = [r.randrange(-(2**62), 2**62) for _ in range(2000)]
    held = common.materialize(spark.createDataFrame([(i,) for i in ids], "id bigint"), "ids")
    df = spark.createDataFrame([(i, i in set(ids)) for i in ids + [x + 1 for x in ids]], "doc_id bigint, inside boolean").select(common.id_hash(F.col("doc_id")).alias("h"), "inside").toPandas()
    for most in (common.FILTER_BITS, 1 << 12):
        maybe = common.id_filter(held, most).maybe(df.h.to_numpy())
        assert maybe[df.inside].all()
    assert common.id_filter(held).maybe(df.h.to_numpy())[~df.inside].mean() < 0.05
    assert not common.id_filter(held.limit(0)).maybe(df.h.to_numpy()).any()


def test_rows_are_left_out_whatever_the_filter(spark):
    df = spark.createDataFrame([(i % 90, {"k": i}) for i in range(200)] + [(None, None)], "doc_id bigint, id map<string, bigint>")
    gone = common.materialize(spark.range(0, 90, 3), "gone")
    got = [r.doc_id for r in common.without(df, gone).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [i % 90 for i in range(200) if i % 90 % 3] + [None]))


def test_look_up_with_and_without_broadcast(spark):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, n bigint")
    side = common.materialize(spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3)], "k string, v int"), "side")
    for how, n in (("inner", 202), ("left", 300), ("left_anti", 98)):
        a, b = (sorted(map(str, common.looked_up(big, side, ["k"], "n", how, most).collect())) for most in (0, 10))
        assert a == b and len(a) == n


def test_scratch_deletes_all_but_what_lasts(spark):
    with common.scratch():
        a = common.materialize(spark.range(3), "a")
        b = common.lasting(common.materialize(a.select((F.col("id") + 1).alias("id")), "b"))
    assert b.count() == 3
    path = spark._jvm.org.apache.hadoop.fs.Path(a._written)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

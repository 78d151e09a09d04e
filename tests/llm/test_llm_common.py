import helpers as H
import pytest
from pyspark.sql import functions as F

from trailspark.llm import common


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_union_find(spark, seed):
    rng = H.rng(seed)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    edges += [(k, k + 1) for k in range(200, 260)] + [(300, k) for k in range(301, 340)] + [(7, 7)]
    df = spark.createDataFrame(edges + edges[:10] + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(df, "a", "b").collect()}
    pairs = {frozenset(e) for e in edges}
    want = H.components({x for e in edges for x in e}, lambda a, b: frozenset((a, b)) in pairs)
    assert got == {k: v for k, v in want.items() if k != v}


def test_components_of_texts_and_of_nothing(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert {r.node: r.component for r in common.connected_components(df, "a", "b").collect()} == {"b": "a", "c": "a"}
    assert common.connected_components(df.limit(0), "a", "b").count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(5).withColumn("x", F.array(F.lit(None).cast("int")))
    got = common.materialize(df)
    assert got.schema.simpleString() == df.schema.simpleString() and got.count() == 5


def test_folds_follow_crc32(spark):
    import zlib
    rows = spark.range(50).select("id", common.doc_fold("id").alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in rows)
    assert spark.sql("select cast(null as long) doc_id").select(common.doc_fold()).first()[0] == 0

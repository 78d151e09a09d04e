import helpers as H
import pytest
from pyspark.sql import functions as F

from trailspark.llm import shard


def sharded(df, **kw):
    return shard.assign_shards(df.withColumn("__size", shard.text_size()).withColumn("__key", shard.record_key()), **kw)


@pytest.mark.parametrize("kind", ["plain", "copies", "heavy"])
def test_near_equal_bytes_and_gapless_slots(spark, kind):
    rng = H.rng(4)
    texts = H.odd_texts()[:-1] + [" ".join(H.words(rng, rng.randrange(1, 200))) for _ in range(900)]
    if kind == "copies":  # a third of all rows are one text
        texts += ["the same text " * 40] * 450
    if kind == "heavy":
        texts += ["x" * 40_000]
    rows = sharded(H.documents(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    by = {}
    for r in rows:
        assert r["__size"] == len((r.text or "").encode()) + 1
        by.setdefault(r["__shard"], []).append(r)
    sizes = [sum(r["__size"] for r in g) for g in by.values()]
    assert set(by) == set(range(8)) and max(sizes) - min(sizes) <= 2 * max(r["__size"] for r in rows)
    for g in by.values():
        assert sorted(r["__slot"] for r in g) == list(range(len(g)))
    if kind == "copies":
        assert len({r["__shard"] for r in rows if r.text == texts[-1]}) <= 5


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (None, None, 0), (2, "", 0)], "doc_id long, text string, shard int")
    rows = sharded(df).collect()
    assert len(rows) == 4 and len({(r["__shard"], r["__slot"]) for r in rows}) == 4 and {r.shard for r in rows} == {0}
    assert sharded(df.limit(0)).count() == 0


def test_same_data_same_shards(spark):
    df = H.documents(spark, [f"text {k % 50} " * (k % 7 + 1) for k in range(300)])
    where = lambda d: {r.doc_id: (r["__shard"], r["__slot"]) for r in sharded(d).collect()}
    assert where(df) == where(df.repartition(5).orderBy(F.rand(1)))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(shard, "SAMPLES_PER_RANGE", 1)  # poor splitters
    df = H.documents(spark, [f"{k} " * 20 for k in range(1500)])
    rows = sharded(df).groupBy("__shard").agg(F.sum("__size").alias("b")).collect()
    assert max(r.b for r in rows) - min(r.b for r in rows) < 300


def test_copies_without_id_are_divisible(spark, monkeypatch):
    monkeypatch.setattr(shard, "CHUNK_BITS", 8)
    copies = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    others = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    df = copies.unionByName(others).unionByName(others.limit(3)).repartition(6)
    seen, plain = [], shard._Ranges.fill

    def fill(self, narrow):
        plain(self, narrow)
        seen.append(self.bytes)

    monkeypatch.setattr(shard._Ranges, "fill", fill)
    rows = sharded(df).collect()
    total = sum(r["__size"] for r in rows)
    assert len(rows) == 22_003 and seen[-1].sum() == total
    assert seen[-1].max() <= 1.5 * max(shard.OVERFULL * total / shard.MIN_RANGES, total / shard.MIN_RANGES + 50)
    by = {}
    for r in rows:
        by.setdefault(r["__shard"], []).append(r)
    sizes = [sum(r["__size"] for r in g) for g in by.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r["__size"] for r in rows)
    assert all(sorted(r["__slot"] for r in g) == list(range(len(g))) for g in by.values())


def test_copies_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(shard, "CHUNK_BITS", 3)
    from trailspark.llm.common import materialize
    rows = materialize(spark.range(500).repartition(4).select(
        F.when(F.col("id") < 300, 7).otherwise(F.col("id") % 150).alias("__key"), F.lit(1).alias("__tie"), F.monotonically_increasing_id().alias("__uid")))
    got = {r["__uid"]: r["__number"] for r in shard._copy_numbers(rows).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["__key"], []).append(r["__uid"])
    assert set(got) == {u for g in groups.values() if len(g) > 1 for u in g}
    assert all(sorted(got[u] for u in g) == list(range(len(g))) for g in groups.values() if len(g) > 1)

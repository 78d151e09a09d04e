import re

import helpers as H
import pytest
import xxhash
from pyspark.sql import functions as F

from trailspark.llm import simhash


def reference(text, shingle=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", H.lower(text or ""))
    sh = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] if len(w) >= shingle else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def texts():
    rng = H.rng()
    base = [" ".join(H.words(rng, 200)) for _ in range(6)]
    near = []
    for _ in range(40):  # a large group of near copies
        w = base[0].split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return H.odd_texts() + base + near + [base[1]] * 20 + [base[2].upper()] + ["only two", "only  two\n"]


@pytest.mark.parametrize("limit", [512, 1])
def test_components_equal_brute_force(spark, texts, limit):
    got = {r.doc_id: r for r in simhash.near_duplicates(H.documents(spark, texts), bucket_limit=limit).withColumn("hex", simhash.hex64(F.col("fp"))).collect()}
    fp = {i: reference(t) for i, t in enumerate(texts)}
    want = H.components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert len(got) == len(texts)
    for i in fp:
        assert got[i].hex == f"{fp[i]:016x}" and got[i].component_id == want[i]


@pytest.mark.parametrize(("bits", "limit"), [(0, 512), (1, 512), (1, 1), (2, 2)])
def test_links_of_crafted_fingerprints(spark, bits, limit):
    rng = H.rng(3)
    values = {0, 1, 3, 7, -1, -2, -(1 << 63), (1 << 63) - 1}
    for _ in range(30):
        x = rng.randrange(-(1 << 63), 1 << 63)
        values |= {x, x ^ 1, x ^ (1 << 40), x ^ (5 << 20)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    from trailspark.llm.common import connected_components
    comp = {r.node: r.component for r in connected_components(simhash.link_fingerprints(df, bits, limit), "a", "b").collect()}
    want = H.components(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= bits)
    assert {v: comp.get(v, v) for v in values} == want


def test_repeated_rows_null_ids_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d", 9), (1, "a b c d", 9), (None, "a b c d", 9), (2, None, 9)], "doc_id long, text string, fp long")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 2), (True, 0, 1)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_thresholds_meet_the_general_pigeonhole_principle(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("fp"))
    parts = simhash.plan_partitions(df, 2)
    assert sum(len(b) for b, _ in parts) <= 64 and len({x for b, _ in parts for x in b}) == sum(len(b) for b, _ in parts)
    assert sum(t + 1 for _, t in parts) >= 3  # errors of at most two bits can't fill all of them

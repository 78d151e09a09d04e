import re

import corpus_pipeline as P
import helpers as H
import pytest
import xxhash
from pyspark.sql import functions as F

from trailspark.llm import queries

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows on a small fixture with planted copies and passages."""
    rng = H.rng(9)
    item = " ".join(H.words(rng, 30))
    en = ["The " + " ".join(rng.choice(["the", "thing", "onthe", "and", "that"]) + rng.choice("abcdefgh") for _ in range(rng.randrange(40, 90))) for _ in range(60)]
    de = [" ".join(rng.choice(["schö", "ein", "zwüs", "ach"]) + rng.choice("klmnopqr") for _ in range(rng.randrange(40, 90))) for _ in range(30)]
    texts = [*en, *de, en[0], en[0], en[1] + " extra", None, "", "... 123 ...", en[2] + " " + item, item.upper()]
    langs = ["en"] * 60 + ["de"] * 30 + ["en"] * 3 + [None] * 3 + ["en"] * 2
    folder = str(tmp_path_factory.mktemp("sf"))
    H.documents(spark, texts, langs, [f"s{k % 3}" for k in range(len(texts))]).withColumn("extra", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, f) in enumerate(P.STAGES):
        done = f(spark, docs, folder)
        done.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((name, {r.doc_id: r for r in docs.collect()}, after.columns, after.collect()))
        docs = after
    return folder, item, out


def test_language_stage_drops_only_undetermined(stages):
    _, before, columns, after = stages[2][0]
    assert columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
    assert {r.doc_id for r in after} == {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}


def test_dedup_stage_keeps_the_first_of_each_component(stages):
    _, before, _, after = stages[2][1]

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", H.lower(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = {i: fp(r.text) for i, r in before.items()}
    want = H.components(f, lambda a, b: (f[a] ^ f[b]).bit_count() <= 2)
    assert sorted(r.doc_id for r in after) == [i for i in want if want[i] == i] and len(after) < len(before)


def test_dedup_stage_with_null_and_repeated_ids(spark):
    rng = H.rng(4)
    texts = [" ".join(H.words(rng, 60)) for _ in range(12)]
    rows = [*[(None, t) for t in texts[:6]], (None, texts[0]), (None, texts[0]), (None, texts[1].upper()),  # no id, two texts with copies
            (5, texts[6]), (None, texts[6]), (4, texts[6].upper()), (4, texts[6].upper()),  # a copy without an id, the first one repeated
            (7, texts[7]), (7, texts[8]), (7, texts[8].upper()), (8, texts[7]),  # two texts under one id
            (9, texts[9]), (2, texts[10])]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}", None) for k, (i, t) in enumerate(rows)], H.DOCS).repartition(3)
    got = P.near_dedup(spark, docs, "").collect()
    assert docs.columns == P.near_dedup(spark, docs, "").columns
    want = [*[(None, t.lower()) for t in texts[:6]], (4, texts[6]), (7, texts[7]), (7, texts[8]), (9, texts[9]), (2, texts[10])]
    order = lambda rows: sorted(rows, key=str)
    assert order((r.doc_id, r.text.lower()) for r in got) == order(want)
    again = P.near_dedup(spark, docs.orderBy(F.desc("source"), "text").repartition(2), "").collect()
    assert order(map(tuple, again)) == order(map(tuple, got))  # whatever the order of the rows


def test_decontamination_stage_drops_documents_with_passages(stages):
    _, before, _, after = stages[2][2]
    item = re.findall(WORD, stages[1].lower())
    windows = {tuple(item[k:k + 10]) for k in range(len(item) - 9)}

    def dirty(t):
        w = re.findall(WORD, H.lower(t))
        return any(tuple(w[k:k + 10]) in windows for k in range(len(w)))

    assert {r.doc_id for r in after} == {i for i, r in before.items() if not dirty(r.text)} and len(after) < len(before)


def test_mixture_stage_samples_unchanged_rows(stages):
    _, before, _, after = stages[2][3]
    assert 0 < len(after) <= len(before) and all(before[r.doc_id] == r for r in after)


def test_sharding_stage_places_all_rows(stages):
    _, before, columns, after = stages[2][4]
    assert sorted(r.doc_id for r in after) == sorted(before) and columns[-2:] == ["shard", "slot"]
    for s in {r.shard for r in after}:
        slots = sorted(r.slot for r in after if r.shard == s)
        assert slots == list(range(len(slots)))


def test_run_equals_the_stages_one_by_one(spark, stages):
    got = P.run(spark, stages[0]).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in stages[2][4][3])


def test_stages_survive_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], H.DOCS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, f in P.STAGES:
        assert f(spark, docs, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    assert {int(m[1]) for m in (re.match(r"op(\d+)_", k) for k in queries.QUERIES) if m} == set(range(1, 14)) and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = lambda pdf: sorted(tuple(map(str, r)) for r in pdf[columns].itertuples(index=False))
    assert rows(got.toPandas()) == rows(want)

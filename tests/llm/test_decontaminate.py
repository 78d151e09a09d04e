import re

import helpers as H
import pytest
from pyspark.sql import functions as F

from trailspark.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, items, window):
    out = {}
    items = [(i, re.findall(WORD, H.lower(t or ""))) for i, t in items]
    for d, t in docs:
        w = re.findall(WORD, H.lower(t or ""))
        hit, ids = set(), set()
        for i, x in items:
            n = min(window, len(x))
            for s in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == x[s:s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(i))
        out[d] = (len(w), len(hit), sorted(ids))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = H.rng()
    items = [(k, " ".join(H.words(rng, rng.choice([1, 2, 3, 7, 10, 25, 60]), 60))) for k in range(12)]
    items += [(20, None), (21, " . "), (22, items[4][1]), (5, "Another Text of item 5, it's Élan!")]
    texts = []
    for k in range(25):
        w = H.words(rng, 80, 60)
        for _ in range(rng.randrange(3)):
            x = rng.choice(items)[1] or ""
            x = x.split()
            a = rng.randrange(len(x) + 1)
            w[10:10] = [z.upper() + rng.choice(["", ",", " -"]) for z in x[a:a + 14]]
        texts.append(" ".join(w))
    texts += [t for t in H.odd_texts() if len(t or "") < 1000] + [(items[10][1] + " ") * 3]
    return texts, items


@pytest.mark.parametrize("block_words", [400_000, 40])
def test_equal_brute_force(spark, tables, block_words):
    texts, items = tables
    docs = H.documents(spark, texts).withColumn("index", F.lit("kept"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_windows(docs, bench, block_words=block_words)
    assert got.columns[:6] == docs.columns
    rows = {r.doc_id: (r["__n_words"], r["__n_hit"], sorted(r["__items"])) for r in got.collect()}
    assert rows == brute(list(enumerate(texts)), items, 10)


def test_spans_cover_the_hits(spark, tables):
    texts, items = tables
    got = decontaminate.find_windows(H.documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in got:
        runs = [(s.start, s.end) for s in r["__spans"]]
        assert sum(e - a for a, e in runs) == r["__n_hit"] and runs == decontaminate.merge(runs)


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "b")], "item_id long, text string")
    for block in (400_000, 1):
        got = sorted(r["__n_hit"] for r in decontaminate.find_windows(docs, bench, block_words=block).collect())
        assert got == [1, 1, 1]
    assert decontaminate.find_windows(docs.limit(0), bench).count() == 0
    assert all(r["__n_hit"] == 0 and r["__items"] == [] for r in decontaminate.find_windows(docs, bench.limit(0)).collect())


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 15)
    rng = H.rng(8)
    item = H.words(rng, 64, 1000)
    docs = [(k, " ".join(item[k:k + 10])) for k in range(55)]
    got = decontaminate.find_windows(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert all(r["__n_hit"] == 10 for r in got)


def test_repeated_items_keep_blocks_bounded(spark, monkeypatch):
    rng = H.rng(31)
    item = " ".join(H.words(rng, 200))
    others = [" ".join(H.words(rng, 60)) for _ in range(40)]
    bench = spark.createDataFrame([("same", item)] * 400 + [(str(k), t) for k, t in enumerate(others)], "item_id string, text string")
    docs = H.documents(spark, [f"a b c {item} d", others[3], "nothing of it", None])
    sizes, plain = [], decontaminate.Index.__init__

    def init(self, rows, *rest):
        sizes.append(sum(len(w) for _, w in rows))
        plain(self, rows, *rest)

    monkeypatch.setattr(decontaminate.Index, "__init__", init)
    got = {r.doc_id: (r["__n_hit"], list(r["__items"])) for r in decontaminate.find_windows(docs, bench, block_words=1000).collect()}
    assert got == {0: (200, ["same"]), 1: (60, ["3"]), 2: (0, []), 3: (0, [])}
    assert sum(sizes) == 200 + 40 * 60 and max(sizes) < 2000

import os
from itertools import permutations

import duckdb
import helpers as H

from trailspark.llm import audit_sql, filteraudit, queries

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(doc_id, text, first):
    t = text or ""
    w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    return {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": doc_id is not None and first[t] is not None and doc_id > first[t]}


def brute(rows, good, toxic):
    """Every order, filter by filter, over the documents themselves."""
    first = {}
    for i, t, _ in rows:
        t = t or ""
        first[t] = min(x for x in (first.get(t), i) if x is not None) if first.get(t) is not None or i is not None else None
    out = []
    for part in {s or "" for _, _, s in rows}:
        docs = [(i, fails(i, t, first)) for i, t, s in rows if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        some = []
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if d[1][x]]
                left = [d for d in left if not d[1][x]]
                shapley[x] += len(gone)
                some.append((part, "".join(order), step, x, len(left), len(gone), sum(d[1][x] for d in docs) - len(gone),
                             sum(d[1][x] and sum(d[1].values()) == 1 for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)))
        out += [(*r[:3], *r[4:], shapley[r[3]]) for r in some]
    return sorted(out)


def rows_of(rng):
    base = H.odd_texts()[:-1] + ["# a", "ABC DEF", "ok " * 300, " ".join(f"w{k}" for k in range(250)), " ".join(f"w{k}" for k in range(230)) + " |",
                                 " x " * 250, "\x1c".join("abc"), " ".join(f"w{k}\tA" for k in range(210))]
    rows = [(k, rng.choice(base), rng.choice(["a", "a", "b", "", None])) for k in range(70)]
    return rows + [(90 + k, "only one " * k, "c") for k in range(3)]


def tables(spark, path, rows, labels):
    spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], H.DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_query_equals_all_orders_and_sql(spark, tmp_path):
    rng = H.rng(12)
    rows = rows_of(rng)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 95, 2)] + [(4, 1, 1), (4, 1, 1), (999, 1, 1)]
    tables(spark, tmp_path, rows, labels)
    out = queries.op13_filter_audit(spark, str(tmp_path))
    assert out.columns == COLUMNS
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute(rows, {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1})
    assert len(got) == 4 * 600
    con = duckdb.connect()
    for t in ("documents", "labels"):
        files = [f"{tmp_path}/{t}.parquet/{f}" for f in os.listdir(f"{tmp_path}/{t}.parquet") if f.endswith(".parquet")]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    assert sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({audit_sql.SQL})").fetchall()) == got


def test_null_and_repeated_ids(spark):
    rows = [(None, "x", "a"), (None, "x", "a"), (1, "x", "a"), (1, "x", "b"), (2, "x", "b"), (None, None, None), (7, "", "")]
    docs = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], H.DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in filteraudit.audit(filteraudit.failure_masks(docs, labels)).collect())
    assert got == brute(rows, {1}, set())
    copies = {(r.doc_id, r.part): r.mask >= 16 for r in filteraudit.failure_masks(docs, labels).collect()}
    assert copies == {(None, "a"): False, (1, "a"): False, (1, "b"): False, (2, "b"): True, (None, ""): False, (7, ""): False}
    assert filteraudit.audit(filteraudit.failure_masks(docs.limit(0), labels)).count() == 0


def test_potential_gives_shapley_values(spark):
    """Three filters with other names, counts by hand: 2 fail x only, 4 fail x and y, 6 fail all, 1 passes."""
    rows = [("p", 1, True, False)] * 2 + [("p", 3, False, True)] * 4 + [("p", 7, True, True)] * 6 + [("p", 0, True, True)]
    df = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): r for r in filteraudit.audit(df, "xyz").collect()}
    assert len(got) == 18 and {r.shapley for k, r in got.items() if k[0][k[1] - 1] == "x"} == {6 * 2 + 3 * 4 + 2 * 6}
    assert {r.shapley for k, r in got.items() if k[0][k[1] - 1] == "z"} == {2 * 6}
    r = got["zxy", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == (1, 6, 6, 2, 2, 4)

import helpers as H
import pytest
from pyspark.sql import functions as F

from trailspark.llm import linededup


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p:] == b[p + 1:] if len(a) < len(b) else a[p + 1:] == b[p + 1:]


def brute(docs):
    places = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        for k, x in enumerate((t or "").split("\n") if t is not None else []):
            if any(ord(c) > 32 and c != "\xa0" for c in x):
                places.setdefault(x, []).append((d, k))
    group = H.components(places, lambda a, b: min(len(a), len(b)) >= linededup.MIN_CHARS and within_one(a, b))
    classes = {}
    for x, root in group.items():
        classes.setdefault(root, []).extend(places[x])
    gone = {p for c in classes.values() for p in sorted(c)[1:]}
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in docs}


def fixture(seed):
    rng = H.rng(seed)
    lines = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["short", "shirt", "", "  ", "\xa0"]
    lines += ["x" * 25, "x" * 26, "x" * 27, "ab" * 15, "ba" * 15]

    def edited(x):
        k = rng.randrange(len(x) + 1)
        return rng.choice([x, x, x[:k] + "Z" + x[k:], x[:k] + x[k + 1:], x[:k] + "é" + x[k + 1:], x + "\r", x[1:]])

    texts = ["\n".join(edited(rng.choice(lines)) for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    return [(k, t) for k, t in enumerate(texts + H.odd_texts() + ["long " * 30_000 + "x", None, "", "\n\n", "same line of every document here\n" * 50])]


@pytest.mark.parametrize(("seed", "broadcast"), [(1, 1_000_000), (2, 0)])
def test_equal_brute_force(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(linededup, "MAX_BROADCAST_ROWS", broadcast)
    docs = fixture(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lines", F.lit("clash"))
    rows = linededup.dedup_lines(df).collect()
    assert {r.doc_id: r.text for r in rows} == brute(docs) and all(r.lines == "clash" for r in rows)
    for r in rows:
        assert r["__n_lines"] - r["__n_dropped"] == (0 if r.text is None else len(r.text.split("\n"))) or r["__n_dropped"] == r["__n_lines"]


def test_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a line\nb"), (1, "a line\nb"), (2, "b\na line"), (None, "b")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in linededup.dedup_lines(df).collect())
    assert got == [(0, "b"), (1, "a line"), (1, "a line"), (2, "")]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_null_and_repeated_ids_keep_their_own_lines(spark):
    common = "a line that many documents share, "
    rows = [(None, "u\nX"), (None, "X\nv"), (7, "p\nY"), (7, "Y\nq\nr"), (7, "s"),
            (None, f"one\n{common}1"), (None, f"{common}2\ntwo"), (3, f"three\nthree and\n{common}3"), (3, f"{common}4"), (None, None), (3, "")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    kept = [x for r in got for x in (r.text or "").split("\n") if x]
    once = ["u", "v", "X", "p", "q", "r", "s", "Y", "one", "two", "three", "three and"]
    assert sorted(x for x in kept if not x.startswith(common)) == sorted(once)
    shared = [r for r in got if common in (r.text or "")]
    assert len(shared) == 1 and shared[0].doc_id is None and sum(x.startswith(common) for x in kept) == 1  # a null id comes first
    assert all(r["__n_lines"] - r["__n_dropped"] in (0, len((r.text or "").split("\n"))) for r in got)


def test_links_are_verified_on_the_line_of_their_own_text(spark):
    a, b = "the first of two lines, x", "the first of two lines, y"
    # of the line numbers of id 1, text b is near only to the text in one of its rows
    rows = [(1, f"something quite different here\n{a}"), (1, f"no\nnothing of the kind at all"), (2, f"z\n{b}")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([*rows[:2], (2, "z")])

"""Row numbers, chunked cells and range slices against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from trailspark.operators import cleaning as C
from trailspark.operators import geo as G
from trailspark.operators import reports as R
from trailspark.sources import files as SF

pytestmark = pytest.mark.usefixtures("few_partitions")


def test_row_index_is_gapless_in_file_order(spark, tmp_path):
    want = []
    for name, n in (("b.csv", 3000), ("a.csv", 7), ("c.csv", 1)):
        (tmp_path / name).write_text("x,y\n" + "".join(f"{name[0]}{k},\"line\nbreak\"\n" for k in range(n)))
    for name, n in (("a.csv", 7), ("b.csv", 3000), ("c.csv", 1)):
        want += [f"{name[0]}{k}" for k in range(n)]
    rows = SF.with_row_index(SF.read_csv(spark, str(tmp_path)), "i").collect()
    assert [r.x for r in sorted(rows, key=lambda r: r.i)] == want and sorted(r.i for r in rows) == list(range(len(want)))


def test_row_index_over_the_splits_of_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{k:07d}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = spark.read.text(str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        rows = SF.with_row_index(df.withColumn("i", F.lit("old")), "i").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {int(r.value): r.i for r in rows} == {k: k for k in range(5000)}
    assert [r.i for r in SF.with_row_index(spark.range(10, 15).coalesce(1), "i").orderBy("id").collect()] == list(range(5))
    assert SF.with_row_index(spark.range(0), "i").count() == 0


def test_chunks_join_to_the_cell(spark):
    rng = random.Random(4)
    rows = [("hot", 1.0, 2.0, "w", k, "é" * rng.randrange(0, 40)) for k in range(900)]
    rows += [("b", None, None, None, k, f"entry {k}") for k in range(20)] + [("b", 1.0, None, None, 1, None), ("c", 1.0, 1.0, "w", 1, "x" * 900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "location_name string, latitude double, longitude double, top_topics string, journal_id long, journal_entry string")
    cells = {}
    for r in sorted(R.entry_cells(df, max_bytes=500).collect(), key=lambda r: r.chunk):
        assert len(r.journal_entries.encode()) < 500 + 900
        cells.setdefault((r.location_name, r.latitude), []).append(r.journal_entries)
    whole = {(r.location_name, r.latitude): r.journal_entries for r in R.join_entries(df.where("journal_entry IS NOT NULL")).collect()}
    assert {k: " | ".join(v) for k, v in cells.items()} == whole and len(cells["hot", 1.0]) > 40


def owner(clubs, x):
    own = [(o, c) for c, o, s, e in clubs if s <= x <= e]
    return min(own)[1] if own else None


@pytest.mark.parametrize("slice_bounds", [3, 17, 8192])
def test_slices_of_ranges_equal_all_ranges(spark, slice_bounds):
    rng = random.Random(slice_bounds)
    clubs = [(f"c{k}", k, float(rng.randrange(0, 200)), float(rng.randrange(0, 200))) for k in range(60)]
    clubs += [("long", 70, -50.0, 400.0), ("point", -1, 33.0, 33.0), ("hot", 40, 100.0, 101.0)] + [(f"h{k}", 41 + k, 100.0, 100.0 + k) for k in range(20)]
    df = spark.createDataFrame(clubs, "trail_club string, club_order int, lat_start double, lat_end double")
    pieces = [tuple(r) for r in G.club_pieces(df, slice_bounds).collect()]
    for x in [k / 2 for k in range(-110, 830)] + [99.99999, 100.00001]:
        hit = [c for lo, hi, a, b, c in pieces if (lo < x or a and lo == x) and (x < hi or b and x == hi)]
        assert hit == [c for c in [owner(clubs, x)] if c is not None], x


def test_many_overlapping_ranges(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    n = 200_000
    start, order = rng.uniform(0, 1000, n), rng.permutation(n)
    end = start + np.where(rng.random(n) < 0.3, 600, 0.01) * rng.random(n)
    df = spark.range(n, numPartitions=4).mapInPandas(lambda it: (p.assign(trail_club=[f"c{order[i]}" for i in p["id"]], club_order=order[p["id"]],
                                                                          lat_start=start[p["id"]], lat_end=end[p["id"]])[["trail_club", "club_order", "lat_start", "lat_end"]] for p in it),
                                                     "trail_club string, club_order long, lat_start double, lat_end double")
    x = np.r_[rng.uniform(-1, 1610, 300), start[:50], end[:50]]
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "id long, latitude double")
    got = {r.id: r.trail_club for r in G.assign_clubs(rows, df, fill=None).collect()}
    for k, v in enumerate(x):
        inside = order[(start <= v) & (v <= end)]
        assert got[k] == (f"c{inside.min()}" if len(inside) else None)


@pytest.mark.parametrize("limit", [None, 0])
def test_tokens_by_table_and_by_join(spark, limit, monkeypatch):
    if limit is not None:
        monkeypatch.setattr(C, "TABLE_BYTES", limit)
    rows = [(1, "The CAT sat. the cat Dog"), (2, None), (3, "  "), (4, "Joe dog\tthe  sat"), (5, "zzz")]
    j = spark.createDataFrame(rows, "journal_id long, journal_story string")
    words = lambda *w: spark.createDataFrame([(x, 0, 0.0) for x in w], "word string, g int, k double")
    vocabulary, stop = words("the", "Cat", "dog", "sat", "joe", None, "x" * 50), words("sat", "Joe", "zz")
    got = {r.journal_id: r.journal_story for r in C.clean_tokens(j, stop, vocabulary).collect()}
    assert got == {1: "The CAT the cat Dog", 2: None, 3: None, 4: "Joe dog the", 5: None}
    mask = {r.journal_id: r.valid for r in C.valid_story_mask(j, words("the", "cat", "zzz", "sat", "Joe")).collect()}
    assert mask == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert {r.journal_id: r.valid for r in C.valid_story_mask(j, words("nothing").limit(0)).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True}
    dict_form = {r.journal_id: r.journal_story for r in C.clean_dict_substring(j, stop, vocabulary).collect()}
    assert dict_form == {1: "The CAT the cat Dog", 2: None, 3: None, 4: "dog the", 5: None}


@pytest.mark.parametrize("name", ["clean_tokens", "clean_keep_raw", "clean_dict_substring", "valid_story_mask"])
def test_rows_do_not_carry_the_word_table(spark, name):
    from trailspark.plans import registry
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _table#" not in plan  # a copy of the table in every row: rows times words

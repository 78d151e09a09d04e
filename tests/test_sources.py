"""File sources and sinks: CSV folders with differing headers (S3/U1), the
year from the file name (S4/Q15), alias map (S6) and partitioned writes (K4/K7)."""

import os
import tempfile

from pyspark.sql import functions as F

from trailspark.sources.files import canonical, combine_csv_folder, read_csv, with_file_stem, write_table


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_combine_folder_with_different_headers(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    _write(os.path.join(d, "a.csv"), "Hiker trail name,Latitude\nbob,35.5\nal,36\n")
    _write(os.path.join(d, "b.csv"), "Latitude,Journal Story,Hiker trail name\n37,\"multi\nline\",cy\n")
    _write(os.path.join(d, "c.csv"), "Hiker trail name,Latitude\n")          # header only
    _write(os.path.join(d, "notes.txt"), "ignored")
    df = canonical(combine_csv_folder(spark, d), required=["trail_name", "latitude"])
    got = sorted((r["trail_name"], r["latitude"], r["journal_story"]) for r in df.collect())
    assert got == [("al", "36", None), ("bob", "35.5", None), ("cy", "37", "multi\nline")]


def test_year_from_file_name_and_dated_text(spark):
    d = tempfile.mkdtemp(prefix="years-")
    _write(os.path.join(d, "2016.csv"), "Latitude,Longitude,Date\n35.1,-80.2,\"Mar 05, Sat\"\n,-80,\"Mar 06, Sun\"\n")
    _write(os.path.join(d, "2017.csv"), "Latitude,Longitude,date\n36.1,-81.2,\"Apr 01, Sat\"\n")
    frames = [canonical(with_file_stem(read_csv(spark, os.path.join(d, f))), ["latitude", "longitude", "date_text"])
              for f in ("2016.csv", "2017.csv")]
    df = frames[0].unionByName(frames[1]).dropna(how="any", subset=["latitude", "longitude"])
    out = sorted(r[0] for r in df.select(F.concat(F.col("date_text"), F.lit(", "), F.col("file_stem"))).collect())
    assert out == ["Apr 01, Sat, 2017", "Mar 05, Sat, 2016"]


def test_partitioned_write_and_counts(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="split-"), "by_label")
    df = spark.createDataFrame([(1, "joy"), (2, "fear"), (3, "joy"), (4, None)], "id int, label string")
    write_table(df.where(F.col("label").isNotNull()), out, partition_by=["label"])
    assert sorted(p for p in os.listdir(out) if p.startswith("label=")) == ["label=fear", "label=joy"]
    back = spark.read.parquet(out).groupBy("label").count()
    assert sorted((r["label"], r["count"]) for r in back.collect()) == [("fear", 1), ("joy", 2)]


def test_word_list_and_row_index(spark):
    from trailspark.sources.files import read_word_list, with_row_index
    d = tempfile.mkdtemp(prefix="words-")
    _write(os.path.join(d, "words.txt"), "Trail\ntrail\n  shelter \n\nbear\n")
    words = sorted(r["word"] for r in read_word_list(spark, os.path.join(d, "words.txt")).collect())
    assert words == ["bear", "shelter", "trail"]
    df = with_row_index(spark.createDataFrame([("a",), ("b",), ("c",)], "x string"), "row_id")
    ids = [r["row_id"] for r in df.collect()]
    assert len(set(ids)) == 3 and ids == [r["row_id"] for r in df.collect()]  # stable across reads


def test_append_checks_the_schema_and_overwrite_its_own_input(spark, tmp_path):
    import pytest
    for fmt in ("parquet", "csv"):
        p = str(tmp_path / fmt)
        a = spark.createDataFrame([(1, "x")], "id int, name string")
        write_table(a, p, fmt, mode="append")
        write_table(a, p, fmt, mode="append")
        assert spark.read.format(fmt).option("header", True).load(p).count() == 2
        with pytest.raises(ValueError):
            write_table(a.withColumnRenamed("name", "other"), p, fmt, mode="append")
        with pytest.raises(ValueError):
            write_table(spark.read.format(fmt).option("header", True).load(p), p, fmt)


def test_year_folders_from_file_names(spark, tmp_path):
    for year in (2015, 2016):
        (tmp_path / f"{year}.csv").write_text(f"latitude,date\n1.5,\"Jan 0{year - 2014}, Mon\"\n")
    df = with_file_stem(read_csv(spark, str(tmp_path / "*.csv")), "year")
    out = str(tmp_path / "by_year")
    write_table(df, out, partition_by=["year"])
    assert sorted(r["year"] for r in spark.read.parquet(out).collect()) == [2015, 2016]


def test_word_lists_of_any_length(spark):
    from pyspark.sql import functions as F

    from trailspark.operators import cleaning as C
    text = "w1 w22 w333 word w19999 tail"
    for n in (0, 1, 340, 2500, 20000):
        words = [f"w{k}" for k in range(n - 1, -1, -1)]
        stop = spark.createDataFrame([(w, 1, float(k)) for k, w in enumerate(words)], "word string, g int, k double")
        want = text
        for w in words:
            want = want.replace(w, "")
        got = C.clean_substring(spark.createDataFrame([(1, text)], "journal_id long, journal_story string"), stop).first()
        assert got["journal_story"] == (want.strip() or None), n
    blank = spark.createDataFrame([(1, "  "), (2, None)], "journal_id long, journal_story string")
    assert C.clean_substring(blank, stop).where(F.col("journal_story").isNotNull()).count() == 0


def test_sentiment_leaves_blank_stories_unscored(spark):
    from trailspark.operators import sentiment as SN
    train = spark.createDataFrame([("good fine day", 3), ("bad awful day", 0)], "text string, label int")
    j = spark.createDataFrame([(1, "fine good"), (2, "awful"), (3, "   "), (4, ""), (5, None)], "journal_id long, journal_story string")
    got = {r["journal_id"]: (r["sentiment"], r["journal_story"]) for r in SN.score(j, SN.train(train)).collect()}
    assert got == {1: (3, "fine good"), 2: (0, "awful"), 3: (None, "   "), 4: (None, ""), 5: (None, "")}
    assert spark.createDataFrame([([0.1, 0.7, 0.7],), ([],), (None,)], "s array<double>").select(SN.argmax("s").alias("i")).collect()[0]["i"] == 1


def test_null_valued_key_is_present(spark):
    from trailspark.functions.json import has_key
    df = spark.createDataFrame([('{"timezone": null}',), ('{"a": 1}',), (None,)], "p string")
    assert [r[0] for r in df.select(has_key("p", "timezone")).collect()] == [True, False, None]

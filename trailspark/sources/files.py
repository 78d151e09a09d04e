"""File sources and sinks: CSV/parquet folders, file-name columns, writes.

Spreadsheet (xlsx) files are not read: there is no Spark source for them;
convert to CSV or parquet first (see README).
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reference column names -> canonical names (FIXTURES.md 1.1).
ALIASES = {
    "Journal Index": "journal_id",
    "Hiker trail name": "trail_name",
    "Journal Story": "journal_story",
    "Trail club": "trail_club",
    "Trail Club": "trail_club",
    "Location Name": "location_name",
    "Shelter Name": "shelter_name",
    "Latitude": "latitude",
    "Longitude": "longitude",
    "label": "label",
    "emotional_label": "label",
    "State": "state",
    "Date": "date_text",
    "date": "date_text",
    "Sentiment": "sentiment",
    "Topic": "topic",
    "Topic Words": "topic_words",
}


def canonical(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    """Rename reference columns to canonical names; check required ones."""
    out = df.withColumnsRenamed({c: ALIASES[c] for c in df.columns if c in ALIASES and ALIASES[c] not in df.columns})
    missing = [c for c in (required or []) if c not in out.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; found {out.columns}")
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, glob: str = "*.csv") -> DataFrame:
    """CSV file or folder (only ``glob`` files), header row, multi-line cells.

    Without a schema every column is read as string (no inference pass);
    typed parsing is done by the operators with ``try_cast``.
    """
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    r = r.option("pathGlobFilter", glob)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def with_file_stem(df: DataFrame, name: str = "file_stem") -> DataFrame:
    """Part of the file name before the first '.' (e.g. the year)."""
    return df.withColumn(name, F.split(F.col("_metadata.file_name"), r"\.").getItem(0))


def combine_by_name(frames: list[DataFrame], source_col: str | None = "source_no") -> DataFrame:
    """Union by column name; missing columns become null.

    ``source_col`` numbers the inputs in list order, so (source_no, own key)
    replaces pandas' fresh 0..n-1 index without a global row numbering.
    """
    tagged = [f.withColumn(source_col, F.lit(i)) if source_col else f for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def combine_csv_folder(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """S3 + U1 for files whose headers differ.

    One distributed text scan finds the first line of every file; the distinct
    headers, not the files, decide how many scans follow: files that share
    a header are read together, then the scans are unioned by name.
    """
    lines = (spark.read.option("pathGlobFilter", glob).text(folder)
             .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                     F.col("value"), F.monotonically_increasing_id().alias("k")))
    first = (lines.where("start = 0").groupBy("path").agg(F.min_by("value", "k").alias("header"))
             .groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths")))
    groups = sorted((r["paths"] for r in first.collect()), key=lambda p: p[0])  # one row per distinct header
    if not groups:
        raise FileNotFoundError(f"no {glob} files in {folder}")
    frames = [spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(ps) for ps in groups]
    return combine_by_name(frames)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """K1-K6: write a whole table; ``partition_by`` gives one folder per key.

    Overwriting a folder that the plan reads is refused (K6): write elsewhere and swap.
    Appending to a table with other columns or types is refused (K3).
    """
    if mode == "overwrite":
        target = unquote(urlparse(path).path).rstrip("/") + "/"
        if any(unquote(urlparse(f).path).startswith(target) for f in df.inputFiles()):
            raise ValueError(f"{path} is read by the plan that would overwrite it")
    if mode == "append":
        _check_append(df, path, fmt)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":  # the form that read_csv reads: quotes doubled, white space kept
        w = w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.format(fmt).save(path)


def _check_append(df: DataFrame, path: str, fmt: str) -> None:
    from pyspark.errors import AnalysisException
    try:
        there = df.sparkSession.read.format(fmt).option("header", True).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return
        raise
    kinds = fmt != "csv"  # CSV has names only
    have = {f.name: f.dataType.simpleString() if kinds else "" for f in there.schema}
    new = {f.name: f.dataType.simpleString() if kinds else "" for f in df.schema}
    if have != new:
        raise ValueError(f"columns of the appended rows differ from the table's: {new} and {have}")


def read_word_list(spark: SparkSession, path: str, fmt: str = "text", column: str | None = None) -> DataFrame:
    """A user-supplied word list (one word per line, or one column of a
    table) as a lowercased, distinct ``word`` DataFrame."""
    if fmt == "text":
        df = spark.read.text(path).select(F.col("value").alias("word"))
    else:
        df = spark.read.format(fmt).option("header", True).load(path).select(F.col(column).alias("word"))
    w = F.lower(F.btrim(F.col("word")))
    return df.select(w.alias("word")).where(F.length("word") > 0).distinct()


def with_row_index(df: DataFrame, name: str = "journal_id") -> DataFrame:
    """Rows numbered 0 to n-1 in the order of file names and, inside a file, of its lines.

    Two passes: rows are written once with their place in the scan; counts per
    (file, split) are summed up, first inside each file and then over the files, and give every split the number of
    its first row.  Nothing is sorted, and a lost executor rereads the same numbers.  A table that is not read
    from files is numbered in the order of its partitions.  A column called ``name`` is replaced.
    """
    from pyspark.errors import AnalysisException
    from pyspark.sql import Window

    from trailspark.session import materialize
    rows = df.drop(name)
    try:
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))
    except AnalysisException:
        rows = rows.withColumns({"_file": F.lit(""), "_split": F.spark_partition_id().cast("long")})
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()))
    splits = rows.groupBy("_file", "_split").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_n")).select("_file", before(Window.orderBy("_file")).alias("_files_before"))
    starts = (splits.withColumn("_before", before(Window.partitionBy("_file").orderBy("_split"))).join(files, "_file")
              .select("_file", "_split", (F.col("_files_before") + F.col("_before") - F.col("_first")).alias("_offset")))
    return rows.join(starts, ["_file", "_split"]).select((F.col("_offset") + F.col("_at")).alias(name), *[c for c in df.columns if c != name])

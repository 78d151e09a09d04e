"""Text cleaning: stop lists (T4), substring removal (T1, T2), token filter
(T3) and the valid-story masks (F7, F8).

Word lists are DataFrames of any length.  Tokens are looked up inside their row, so stories are neither
exploded nor shuffled: a list becomes a hash table, an array of buckets of words (a scalar subquery), and a token
is compared with the words of its bucket.  Such a table reaches every task, so it is made only of lists that
measure at most ``TABLE_BYTES``.  A larger list stays where it is, and the places and tokens of the stories
are joined with it.  Both ways are in one plan; the measured size decides when it runs, and no job runs before
the result is used.  The removal of substrings (T1) needs the whole list, in order, in each task,
where Arrow batches of whole texts go through it.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.text import blank_to_null, tokens


def stop_list(journals: DataFrame, extras: DataFrame, name_col: str = "trail_name") -> DataFrame:
    """Ordered stop list ``(word, ord)``: distinct trail names in order
    of first appearance (by ``journal_id``), then the extra words.

    ``extras`` has a ``word`` column (and optionally ``ord``; else sorted).
    """
    names = (journals.where(F.col(name_col).isNotNull())
             .groupBy(F.col(name_col).alias("word")).agg(F.min("journal_id").alias("k"))
             .select("word", F.lit(0).alias("g"), F.col("k").cast("double").alias("k")))
    ex = extras.select("word", *(["ord"] if "ord" in extras.columns else []))
    ex_k = F.col("ord").cast("double") if "ord" in extras.columns else F.lit(0.0)
    ex = ex.select("word", F.lit(1).alias("g"), ex_k.alias("k"))
    both = names.unionByName(ex)
    # first occurrence of a word wins its position
    return (both.groupBy("word").agg(F.min(F.struct("g", "k")).alias("o"))
            .select("word", F.col("o.g").alias("g"), F.col("o.k").alias("k")))


# Words held at once in the lists that :func:`_removals` keeps for texts of the same bytes.
HELD_WORDS = 1_000_000


def _removals(words: list[bytes]) -> Callable[[bytes], bytes]:
    """A function that removes every word from a text, one after another.

    Removing never adds a byte, so words with a byte that the text lacks are passed over.
    """
    known, lists, held = sorted({c for w in words for c in w}), {}, 0
    letters = [(w, frozenset(w)) for w in words if w]

    def remove(text: bytes) -> bytes:
        nonlocal held
        some = bytes([c for c in known if c in text])
        able = lists.get(some)
        if able is None:
            if held > HELD_WORDS:
                lists.clear()
                held = 0
            found = frozenset(some)
            able = lists[some] = [w for w, need in letters if need <= found]
            held += len(able) + 1
        for w in able:
            text = text.replace(w, b"")
        return text

    return remove


def _remove_all(df: DataFrame, text, stop: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out`` = ``text`` after removing every stop word in order.

    The words are removed from the UTF-8 bytes inside the task.  The list comes with the first row of every partition, so it
    travels once and no job runs while the plan is built.
    """
    words = stop.agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "k", "word"))), lambda x: x["word"].cast("binary")).alias("w")).scalar()
    kept = [c for c in df.columns if c != out]
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    src = df.select(*kept, text.cast("binary").alias("_removed"), F.when(first, words).alias("_stop"))

    def run(batches):
        remove = None
        for b in batches:
            if remove is None and b.num_rows:
                remove = _removals(b.column(b.num_columns - 1)[0].as_py())
            texts = [None if t is None else remove(t) for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], pa.array(texts, b.schema.field(len(kept)).type)], [*kept, "_removed"])

    done = src.mapInArrow(run, src.drop("_stop").schema)
    names = df.columns if out in df.columns else [*df.columns, out]
    return done.select(*[F.col("_removed").cast("string").alias(out) if c == out else c for c in names])


def clean_substring(df: DataFrame, stop: DataFrame, col: str = "journal_story") -> DataFrame:
    """Remove each stop word as a substring (in list order), then strip;
    blank -> null."""
    return _remove_all(df, F.col(col), stop, col).withColumn(col, blank_to_null(F.col(col)))


def keep_raw(df: DataFrame, col: str = "journal_story", raw: str = "journal_story_raw") -> DataFrame:
    """The text as it was read, beside the column that cleaning overwrites."""
    return df.withColumn(raw, F.col(col))


# Bytes of words (and eight for each) up to which a list is sent to every task as a table.
TABLE_BYTES = 64 << 20
# Words in a bucket of a table, on average.
BUCKET_WORDS = 2


class WordTable:
    """A list of words for look-ups inside a row, while it is small, or by a join."""

    def __init__(self, words: DataFrame, limit: int | None = None):
        self.words = words.select("word").where(F.col("word").isNotNull()).distinct()
        limit = TABLE_BYTES if limit is None else limit
        size = self.words.agg(F.coalesce(F.sum(F.octet_length("word") + 8), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n"))
        self.small = size.select(F.col("bytes") <= limit)
        # no bucket of a list that is too large, so its table is empty
        buckets = size.select(F.when(F.col("bytes") <= limit, F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_WORDS))).alias("k"))
        self.buckets = buckets
        filled = self.words.withColumn("_k", buckets.scalar()).where(F.col("_k").isNotNull()).select(F.pmod(F.xxhash64("word"), F.col("_k")).alias("b"), "word")
        empty = buckets.where(F.col("k").isNotNull()).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("b"), F.lit(None).cast("string").alias("word"))
        rows = filled.unionByName(empty).groupBy("b").agg(F.collect_list("word").alias("w"))
        self.table = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("t"))

    def inside(self, df: DataFrame, out: str, test) -> DataFrame:
        """``df`` with ``out`` = ``test(has)``, where ``has(word)`` looks a word up in the table.

        The expression names the column of the table only once, so the optimiser puts the table itself in its place, a
        constant of the task; with a second use every row would carry a copy of the whole table.
        """
        has = lambda w: F.array_contains(F.get(F.col("_table"), F.pmod(F.xxhash64(w), F.col("_buckets")).cast("int")), w)
        return (df.withColumn("_table", self.table.scalar()).withColumn("_buckets", self.buckets.scalar())
                .withColumn(out, test(has)).drop("_table", "_buckets"))


def _filter_tokens(df: DataFrame, col: str, words: DataFrame, id_col: str = "journal_id", out: str = "_clean", limit: int | None = None) -> DataFrame:
    """``df`` with ``out``: the tokens of ``col`` whose lowercase form is in ``words``, rejoined with single spaces.

    Every row is kept; a null text gives an empty result.  Ids are unique (they bring the places of kept tokens back to
    their story if the list is too large for a table).
    """
    table = WordTable(words, limit)
    whole = F.coalesce(F.col(col), F.lit(""))
    inside = table.inside(df.where(table.small.scalar()), out, lambda has: F.array_join(
        F.filter(tokens(whole), lambda t: has(F.lower(t))), " "))
    large = df.where(~table.small.scalar())
    places = large.select(id_col, F.posexplode(F.transform(tokens(whole), F.lower)).alias("_pos", "word"))
    kept = places.join(table.words, "word", "left_semi").groupBy(id_col).agg(F.sort_array(F.collect_list("_pos")).alias("_kept"))
    joined = large.join(kept, id_col, "left").withColumn("_tokens", tokens(whole)).withColumn(out, F.array_join(
        F.transform(F.coalesce("_kept", F.array().cast("array<int>")), lambda k: F.get("_tokens", k)), " "))
    return inside.unionByName(joined.select(*inside.columns))


def clean_tokens(df: DataFrame, stop: DataFrame, vocabulary: DataFrame, col: str = "journal_story",
                 id_col: str = "journal_id") -> DataFrame:
    """Keep a token iff ``lower(token)`` is not a stop word and is in the
    vocabulary.  Stop words are compared as given (a capitalised name never
    matches a lowercased token, as in the reference); punctuation glued to a
    word makes it fail the vocabulary.  Rows left with nothing become null.
    """
    words = _lowered(vocabulary).join(stop.select("word"), "word", "left_anti")
    kept = _filter_tokens(df, col, words, id_col)
    return (kept.withColumn(col, F.when(F.col(col).isNotNull(), blank_to_null(F.col("_clean"))))
            .drop("_clean").select(*df.columns))


def _lowered(words: DataFrame) -> DataFrame:
    return words.select(F.lower("word").alias("word")).distinct()


def clean_dict_substring(df: DataFrame, stop: DataFrame, vocabulary: DataFrame, col: str = "journal_story",
                         id_col: str = "journal_id") -> DataFrame:
    """Keep vocabulary tokens (rejoined with spaces), then T1 substring
    removal; double spaces left inside stay, ends are stripped."""
    kept = _filter_tokens(df, col, _lowered(vocabulary), id_col)
    j = _remove_all(kept, F.col("_clean"), stop, "_rm")
    return (j.withColumn(col, F.when(F.col(col).isNotNull(), blank_to_null(F.col("_rm"))))
            .drop("_clean", "_rm").select(*df.columns))


def valid_story_mask(df: DataFrame, stop: DataFrame, col: str = "journal_story", lowercase: bool = True,
                     id_col: str = "journal_id") -> DataFrame:
    """F8 (``lowercase``) / F7 stop-word part: a story is valid when it is
    non-null and some token (lowercased for F8) is not a stop word.
    Adds boolean ``valid``.  F7 also needs the language test (T5)."""
    form = (lambda t: F.lower(t)) if lowercase else (lambda t: t)
    table = WordTable(stop)
    inside = table.inside(df.where(table.small.scalar()), "valid", lambda has: F.coalesce(
        F.exists(tokens(col), lambda t: ~has(form(t))), F.lit(False)))
    large = df.where(~table.small.scalar())
    distinct = F.array_distinct(F.transform(tokens(col), form))
    toks = large.where(F.col(col).isNotNull()).select(id_col, F.explode(distinct).alias("word"))
    ok = toks.join(table.words, "word", "left_anti").select(id_col).distinct().withColumn("valid", F.lit(True))
    return inside.unionByName(large.join(ok, id_col, "left").withColumn("valid", F.coalesce("valid", F.lit(False))).select(*inside.columns))

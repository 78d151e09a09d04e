"""T5 language detection: character-trigram naive Bayes (Cavnar & Trenkle
style n-gram profiles) trained and applied as DataFrame jobs.

Training counts the trigrams of a batch of texts inside the task and adds the counts up by ``(lang, gram)``.  The most
frequent grams of the profile (at most ``HEAD_ROWS`` rows) go to the tasks as an array, where whole texts are scored;
grams outside it leave the task and meet the rest of the profile in a join, so the profile may grow without bound.
Texts are not shuffled.  Other grams (the words of T16) are exploded, joined and summed per ``(doc, class)``.
Whole texts are used; any number of languages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trailspark.session import cut_lineage, materialize

# Rows of a profile that are sent to every task.
HEAD_ROWS = 2_000_000
# Bytes of texts (one text at least) whose trigrams are held at once, and trigrams that are counted in an array.
SLICE_BYTES = 1 << 22
ARRAY_GRAMS = 1 << 22


def _padded(text) -> Column:
    """The lowercased letters-only text, padded with spaces; '' for a text without a trigram."""
    t = F.col(text) if isinstance(text, str) else text
    s = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}]+", " ")), F.lit(" "))
    return F.when(F.length(s) >= 4, s).otherwise(F.lit(""))


def trigrams(text) -> Column:
    """Trigrams of the lowercased letters-only text, padded with spaces."""
    # one regex pass: a zero-width lookahead yields every overlapping trigram
    return F.regexp_extract_all(_padded(text), F.lit("(?=(.{3}))"), 1)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    group = (np.cumsum(size) - size) // SLICE_BYTES
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(size) else []
    for a, b in zip(first, [*first[1:], len(size)], strict=True):
        yield batch.slice(a, b - a)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams of padded texts: per text their number, per trigram its place in the distinct ones, and these as lines of
    three characters."""
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    length = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.maximum(length - 2, 0)
    if not len(chars):
        return n, np.zeros(0, np.int64), np.zeros((0, 3), np.uint32)
    letters = np.flatnonzero(np.bincount(chars)).astype(np.uint32)
    code = np.zeros(int(letters[-1]) + 1, np.int64)
    code[letters] = np.arange(len(letters))
    code, a = code[chars], len(letters)
    key = (code[:-2] * a + code[1:-1]) * a + code[2:]
    inside = np.ones(len(key) + 2, bool)
    ends = np.cumsum(length)[length > 0]
    inside[ends - 1] = inside[ends - 2] = False
    key = key[inside[:-2]]
    if a ** 3 <= ARRAY_GRAMS:
        found = np.flatnonzero(np.bincount(key, minlength=a ** 3))
        place = np.zeros(a ** 3, np.int64)
        place[found] = np.arange(len(found))
        at = place[key]
    else:
        found, at = np.unique(key, return_inverse=True)
    return n, at, letters[np.stack([found // (a * a), found // a % a, found % a], axis=1)]


def _strings(grams: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(grams).view("<U3").ravel().tolist(), pa.string())


def _numbers(grams: np.ndarray) -> np.ndarray:
    g = grams.astype(np.int64)
    return (g[:, 0] << 42) | (g[:, 1] << 21) | g[:, 2]


def _count_trigrams(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, gram, c)``: a row per slice of texts, language and distinct trigram."""
    def run(batches):
        for batch in batches:
            for part in _slices(batch, 1):
                langs = part.column(0).dictionary_encode()
                n, at, grams = _grams(part.column(1))
                by = np.repeat(langs.indices.to_numpy().astype(np.int64), n) * len(grams) + at
                c = np.bincount(by, minlength=len(langs.dictionary) * len(grams))
                some = np.flatnonzero(c)
                lang, gram = np.divmod(some, max(1, len(grams)))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), _strings(grams).take(pa.array(gram)), pa.array(c[some], pa.int64())],
                                                 names=["lang", "gram", "c"])

    rows = labelled.select(F.col(lang_col).alias("lang"), _padded(text_col).alias("t"))
    return rows.mapInArrow(run, rows.select("lang", F.col("t").alias("gram"), F.lit(0).cast("long").alias("c")).schema)


def train_profile(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                  grams: Callable[..., Column] = trigrams) -> tuple[DataFrame, DataFrame]:
    """Returns ``(profile, langs)``: ``(lang, gram, delta)`` and per-language
    ``(lang, base, prior)``.

    ``logp(g|L) = ln((c+1) / (N_L + V))`` (add-one smoothing); ``delta`` is
    ``logp - ln(1 / (N_L + V))`` so unseen grams contribute 0 and the
    per-document score is ``prior + n_grams * base + sum(delta)``.
    """
    labelled = docs.where(F.col(lang_col).isNotNull())
    if grams is trigrams:
        parts = _count_trigrams(labelled, text_col, lang_col)
    else:
        parts = labelled.select(F.col(lang_col).alias("lang"), F.explode(grams(text_col)).alias("gram"), F.lit(1).alias("c"))
    counts = parts.groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    # the profile is small and read four times below: checkpoint it once
    counts = cut_lineage(counts)
    vocab = counts.select("gram").distinct().agg(F.count(F.lit(1)).alias("v")).scalar()
    totals = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    ndocs = labelled.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("d"))
    all_docs = labelled.agg(F.count(F.lit(1))).scalar()
    langs = (totals.join(ndocs, "lang")
             .select("lang", F.log(F.lit(1.0) / (F.col("n") + vocab)).alias("base"),
                     F.log(F.col("d") / all_docs).alias("prior"), "n"))
    profile = counts.join(langs.select("lang", "n"), "lang").select(
        "lang", "gram", (F.log((F.col("c") + 1.0) / (F.col("n") + vocab)) - F.log(1.0 / (F.col("n") + vocab)))
        .alias("delta"))
    return profile, langs.select("lang", "base", "prior")


def _best(scored: DataFrame, keep: list[str], score: Callable[[Column, Column], Column]) -> DataFrame:
    """``keep`` and ``lang_pred``: of the languages ``_all``, the one with the highest score; ties: the first."""
    candidates = F.transform("_all", lambda x, i: F.struct(score(x, i).alias("score"), (-i).alias("neg"), x["lang"].alias("lang")))
    return scored.select(*keep, F.when(F.col("n") > 0, F.array_max(candidates)["lang"]).alias("lang_pred"))


def detect(docs: DataFrame, profile: DataFrame, langs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           grams: Callable[..., Column] = trigrams, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, keep..., lang_pred)``: best language per document; null when the text
    has no gram (the reference's detector fails there -> not English).

    Every language is a candidate for every document through its base score.
    """
    every = langs.agg(F.array_sort(F.collect_list(F.struct("lang", "base", "prior"))).alias("every"))
    if grams is trigrams:
        return _detect_trigrams(docs.select(id_col, *keep, _padded(text_col).alias("_t")), profile, every)
    # a gram meets one profile row that holds its deltas for all languages
    by_gram = profile.groupBy("gram").agg(F.collect_list(F.struct("lang", "delta")).alias("deltas"))  # at most one per language
    g = docs.select(id_col, F.explode(grams(text_col)).alias("gram"))
    n = g.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    sums = (g.join(by_gram, "gram").select(id_col, F.explode("deltas").alias("x"))
            .groupBy(id_col, F.col("x.lang").alias("lang")).agg(F.sum("x.delta").alias("d")))
    per_doc = sums.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("lang", "d"))).alias("d"))  # at most one per language
    scored = n.join(per_doc, id_col, "left").withColumn("_all", every.scalar())
    best = _best(scored, [id_col], lambda x, i: x["prior"] + F.col("n") * x["base"] + F.coalesce(F.element_at(F.col("d"), x["lang"]), F.lit(0.0)))
    return docs.select(id_col, *keep).join(best, id_col, "left")


def _head(profile: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the grams with the largest weights, at most ``HEAD_ROWS``, and the other rows if there are any."""
    weight = F.floor(8 * F.max("delta"))  # levels of weights, a few hundred
    by_gram = profile.groupBy("gram").agg(weight.alias("l"), F.count(F.lit(1)).alias("n"))
    total, least, cut = 0, None, False
    for r in by_gram.groupBy("l").agg(F.sum("n").alias("n")).orderBy(F.desc("l")).collect():
        total += r["n"]
        cut = total > HEAD_ROWS
        if cut:
            break
        least = r["l"]
    if not cut:
        return profile, None
    rare = by_gram.where(F.col("l") < least if least is not None else F.lit(True)).select("gram")
    return profile.join(rare, "gram", "left_anti"), profile.join(rare, "gram", "left_semi")


def _detect_trigrams(docs: DataFrame, profile: DataFrame, every: DataFrame) -> DataFrame:
    """:func:`detect` of the padded texts in the last column ``_t``; the other columns are kept."""
    spark, kept = docs.sparkSession, docs.columns[:-1]
    found = every.first()["every"]
    order = {r["lang"]: i for i, r in enumerate(found)}
    base, prior = np.array([r["base"] for r in found], float), np.array([r["prior"] for r in found], float)
    head, tail = _head(profile)
    rows = head.select("gram", "lang", "delta").toArrow()  # at most HEAD_ROWS
    texts = rows.column("gram").combine_chunks()
    keys = _numbers(np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, 3))
    known, line = np.unique(keys, return_inverse=True)
    delta = np.zeros((len(known) + 1, len(found)))  # the last line is that of a gram outside the head
    delta[line, [order[x] for x in rows.column("lang").to_pylist()]] = rows.column("delta").to_numpy()
    model, rest = spark.sparkContext.broadcast((known, delta, base, prior)), tail is not None

    def run(batches):
        known, delta, base, prior = model.value
        serial = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _slices(batch, len(kept)):
                n, at, grams = _grams(part.column(len(kept)))
                number = _numbers(grams)
                line = np.searchsorted(known, number)
                line[line == len(known)] = 0
                line = np.where(known[line] == number, line, len(known)) if len(known) else np.zeros(len(number), np.int64)
                score = prior + n[:, None] * base
                some = np.flatnonzero(n)
                if len(some):
                    score[some] += np.add.reduceat(delta[line][at], (np.cumsum(n) - n)[some], axis=0)
                ends = np.arange(0, score.size + 1, max(1, len(base)), dtype=np.int32) if len(base) else np.zeros(len(n) + 1, np.int32)
                columns = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, score.ravel())]
                if rest:
                    far = line[at] == len(known)
                    count = np.add.reduceat(np.r_[far, False].astype(np.int32), np.r_[0, np.cumsum(n)][:-1]) * (n > 0)
                    columns += [pa.array(serial + np.arange(len(n)), pa.int64()),
                                pa.ListArray.from_arrays(np.r_[0, np.cumsum(count)].astype(np.int32), _strings(grams).take(pa.array(at[far])))]
                    serial += len(n)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*kept, *names])

    names = ["n", "score", *(["_uid", "_rest"] if rest else [])]
    schema = StructType([*docs.schema.fields[:-1], *[StructField(x.name, x.dataType) for x in spark.range(0).select(
        F.col("id").alias("n"), F.array(F.lit(0.0)).alias("score"), F.col("id").alias("_uid"), F.array(F.lit("")).alias("_rest")).schema.fields[:len(names)]]])
    scored = docs.mapInArrow(run, schema).withColumn("_all", every.scalar())
    if not rest:
        return _best(scored, kept, lambda x, i: F.get("score", i))
    scored = materialize(scored)
    sums = (scored.select("_uid", F.explode("_rest").alias("gram")).join(tail, "gram").groupBy("_uid", "lang").agg(F.sum("delta").alias("d")))
    per_doc = sums.groupBy("_uid").agg(F.map_from_entries(F.collect_list(F.struct("lang", "d"))).alias("d"))  # at most one per language
    return _best(scored.join(per_doc, "_uid", "left"), kept, lambda x, i: F.get("score", i) + F.coalesce(F.element_at(F.col("d"), x["lang"]), F.lit(0.0)))


def is_english(pred: DataFrame, lang_col: str = "lang_pred", english: str = "en") -> DataFrame:
    return pred.withColumn("is_english", F.coalesce(F.col(lang_col) == english, F.lit(False)))

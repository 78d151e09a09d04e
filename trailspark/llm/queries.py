"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from trailspark.llm import audit_sql, decontaminate, embeddings, filteraudit, langid, linededup, lm, mixing, runs, shard, simhash, tokenids, toxicity, url_sql, urlfilter
from trailspark.llm.common import doc_fold, documents, materialize


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in all documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("__items")), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.classify(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", langid.held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that repeat an earlier one, at most one edit apart."""
    kept = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
                       F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: three-word shingles, two bits."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", simhash.hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(doc_fold() != 1))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", (doc_fold() == 1).alias("held_out"), F.col("__toxicity").alias("score"),
        (F.col("__toxicity") >= 0.7).cast("int").alias("predicted"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 likelihood of every document under the recurrent model and the unigram base."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    train = docs.where(doc_fold(folds=10) != 0)
    counts = lm.count_words(train)
    model = lm.fit(train, counts)
    return lm.score(docs, counts, model).select(
        "doc_id", (doc_fold(folds=10) == 0).alias("held_out"), "n_tokens", "n_known",
        F.lit(counts.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    narrow = materialize(documents(spark, sf_dir).select(
        "doc_id", shard.text_size().alias("__size"), shard.record_key().alias("__key"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")))
    return shard.assign_shards(narrow).select(
        "doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling of all documents to tempered source, language and topic shares."""
    docs = documents(spark, sf_dir)
    narrow = materialize(docs.select("doc_id", *[c.alias(k) for k, c in mixing.features(docs).items()]))
    return mixing.mix(narrow).select(
        "doc_id", F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"),
        F.col("__tokens").alias("tokens"), F.round("__weight", 6).alias("weight"), F.round("__probability", 6).alias("probability"),
        F.col("__sampled").alias("sampled"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of a label at cosine 0.98."""
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document from the packed files that were written."""
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    return tokenids.read_ids(tokenids.write_ids(documents(spark, sf_dir), vocabulary, end_id=2, by_word=True))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, some of which get repeats planted."""
    docs = documents(spark, sf_dir).select("doc_id", runs.planted().alias("text"))
    best = F.col("__best")
    return runs.detect_runs(docs, digest=True).select(
        "doc_id", F.col("__n_runs").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * __best.length div __best.period").alias("exponent_milli"),
        F.col("__runs_sha256").alias("runs_sha256"), F.col("__collapsed_sha256").alias("collapsed_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all 120 orders, for every source."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filteraudit.audit(filteraudit.failure_masks(docs, labels))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_sharding": op8_sharding,
    "op9_mixing": op9_mixing,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_token_ids": op11_token_ids,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
    "pipeline": corpus_pipeline.run,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1_SQL = rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
occ AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, s, n, item_id FROM occ JOIN win USING (n, k)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_COUNTS = {k: " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) / {len(w)}.0" for w in words)
           for k, words in mixing.TOPIC_SEEDS.items()}
_RAKE = "".join(f"""
  r{i} AS (SELECT * REPLACE (fit * t_{m} / sum(fit) OVER (PARTITION BY {m}) AS fit) FROM r{i - 1}),"""
                for i, m in enumerate(["source", "lang", "topic"] * mixing.ROUNDS, 1))

OP9_SQL = f"""
WITH raw AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents),
counted AS (
  SELECT doc_id, source, lang, md5(t) AS h, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens,
    [{", ".join(f"({c})" for c in _COUNTS.values())}] AS n FROM raw),
d AS MATERIALIZED (
  SELECT doc_id, source, lang, tokens, h,
    CASE WHEN list_max(n) <= 0 THEN '{mixing.NO_TOPIC}' ELSE [{", ".join(f"'{k}'" for k in _COUNTS)}][list_position(n, list_max(n))] END AS topic
  FROM counted),
cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY ALL HAVING sum(tokens) > 0),
{"".join(f"""m_{m} AS (SELECT {m}, pow(sum(tokens), {mixing.TEMPER}) AS p FROM cells GROUP BY {m}),
""" for m in ("source", "lang", "topic"))}r0 AS MATERIALIZED (
  SELECT c.source, c.lang, c.topic, c.tokens, CAST(c.tokens AS DOUBLE) AS fit,
    s.p / (SELECT sum(p) FROM m_source) AS t_source, l.p / (SELECT sum(p) FROM m_lang) AS t_lang, o.p / (SELECT sum(p) FROM m_topic) AS t_topic
  FROM cells c JOIN m_source s USING (source) JOIN m_lang l USING (lang) JOIN m_topic o USING (topic)),{_RAKE}
fitted AS MATERIALIZED (
  SELECT source, lang, topic, tokens, (fit / (SELECT sum(fit) FROM r{3 * mixing.ROUNDS})) / (tokens / (SELECT sum(tokens) FROM cells)) AS weight
  FROM r{3 * mixing.ROUNDS}),
rates AS (
  SELECT weight, ({mixing.KEEP} * (SELECT sum(tokens) FROM fitted) - sum(tokens) OVER (ORDER BY weight DESC, source, lang, topic) + tokens)
    / sum(tokens * weight) OVER (ORDER BY weight DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM fitted WHERE weight > 0),
best AS (SELECT rate FROM rates WHERE rate * weight <= 1 ORDER BY weight DESC LIMIT 1),
joined AS (
  SELECT doc_id, source, lang, topic, tokens, h, coalesce(weight, 0.0) AS weight,
    least(1.0, coalesce(weight, 0.0) * (SELECT rate FROM best)) AS probability
  FROM d LEFT JOIN (SELECT source, lang, topic, weight FROM fitted) USING (source, lang, topic))
SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
  CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/' || h)[1:13] AS BIGINT) / 4503599627370496.0 < probability AS sampled
FROM joined
"""

OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len([c for c in x if c IS NULL OR NOT isfinite(c)]) = 0
    AND list_dot_product(x, x) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach(node, seen) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN comp ON comp.node = vec_id LEFT JOIN n ON n.a = vec_id
"""

SQL: dict[str, str] = {
    "op1_decontamination": OP1_SQL,
    "op2_url_filter": url_sql.SQL,
    "op9_mixing": OP9_SQL,
    "op10_embedding_dedup": OP10_SQL,
    "op13_filter_audit": audit_sql.SQL,
}

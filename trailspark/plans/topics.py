"""Registered topic / language / sentiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trailspark.operators import cleaning as C
from trailspark.operators import language as L
from trailspark.operators import merging as M
from trailspark.operators import sentiment as SN
from trailspark.operators import topics as T
from trailspark.session import cut_lineage, materialize
from trailspark.sources import tables as S


def _stop(spark, sf_dir):
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "trail_name"])
    extras = S.stop_words(spark, sf_dir).where(F.col("version") == 1).select("word")
    return C.stop_list(j, extras)


def _docs(spark, sf_dir):
    return S.read_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])


def term_counts(spark, sf_dir):
    """Term frequency per source with the version-1 stop list."""
    return T.term_counts(_docs(spark, sf_dir), "source", "text", _stop(spark, sf_dir))


def term_counts_bigrams(spark, sf_dir):
    """T8+T9: unigram and bigram frequency per source, stop words removed first."""
    return T.term_counts(_docs(spark, sf_dir), "source", "text", _stop(spark, sf_dir), ngram_range=(1, 2))


def topic_words_ctfidf(spark, sf_dir):
    """Top-10 c-TF-IDF words per source."""
    return T.ctfidf(term_counts(spark, sf_dir), "source", 10)


def topic_bar(spark, sf_dir):
    """10 largest classes with their top-5 words and weights."""
    docs = _docs(spark, sf_dir)
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    return T.topic_bar(T.ctfidf(term_counts(spark, sf_dir), "source", 5), sizes, "source", 10, 5)


def topic_similarity(spark, sf_dir):
    """Cosine similarity of topic centroids (embeddings.label as topic)."""
    e = S.read_table(spark, sf_dir, "embeddings", ["embedding", "label"])
    return T.cosine_matrix(T.centroids(e, "label", "embedding"), "label", "centroid")


def detect_language(spark, sf_dir):
    """T5: trigram naive Bayes trained on documents.lang, applied to all documents."""
    docs = S.read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    profile, langs = L.train_profile(docs)
    return L.is_english(L.detect(docs, profile, langs))


# ---------------------------------------------------------------------------
# fitted topic model on the journals.  ``target`` is the number of topics asked
# for (the reference asks for 30 to 800); the number of clusters follows from it.

TARGET = 30
MIN_SIZE = 5


def _stories(spark, sf_dir, *extra):
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "journal_story", *extra])
    return j.where(F.col("journal_story").isNotNull())


def _fitted(stories, target):
    """``(journal_id, cluster, vector, topic)`` of one fit, written once."""
    fitted = T.fit_clusters(stories, "journal_id", target)
    return cut_lineage(fitted.join(T.label_topics(fitted, "journal_id", MIN_SIZE).select("journal_id", "topic"), "journal_id"))


def topic_fit(spark, sf_dir, target: int = TARGET):
    """K-means topics, small clusters -> -1, ids by size."""
    return _fitted(_stories(spark, sf_dir), target).select("journal_id", "topic")


def topic_target_search(spark, sf_dir, target: int = TARGET):
    """The coarsest cut of one divisive tree, and the largest minimum topic size, that give ``target`` topics."""
    return T.search_topics(_stories(spark, sf_dir), "journal_id", target).select("journal_id", "topic", "min_topic_size")


def topic_reduce(spark, sf_dir, target: int = TARGET, nr_topics: int = 4):
    """The hierarchy of the fitted topics, cut where nr_topics (with -1) are left."""
    fitted = _fitted(_stories(spark, sf_dir), target)
    return T.reduce_to(fitted.select("journal_id", "topic"), T.topic_vectors(fitted, "journal_id"), "journal_id", nr_topics)


def topic_reduce_auto(spark, sf_dir, target: int = TARGET, min_similarity: float = 0.5):
    """T12 ``auto``: the most similar topics merged while they are similar enough."""
    fitted = _fitted(_stories(spark, sf_dir), target)
    log = M.merge_log(T.topic_vectors(fitted, "journal_id"), min_similarity)
    return T.reduce_topics(fitted.select("journal_id", "topic"), log, "journal_id")


def topic_hierarchy(spark, sf_dir, target: int = TARGET):
    """Merge log from all topics down to one."""
    return M.merge_log(T.topic_vectors(_fitted(_stories(spark, sf_dir), target), "journal_id"))


def _given(spark, sf_dir):
    """Given vectors and their topics: the rows of ``embeddings``."""
    return S.read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])


def topic_hierarchy_given(spark, sf_dir):
    """T18 over given topics and vectors: the merge log of the labels of ``embeddings``."""
    e = _given(spark, sf_dir).where(F.col("label").isNotNull())
    return M.merge_log(T.topic_vectors(e, "vec_id", "label", "embedding"))


def topic_reduce_given(spark, sf_dir, nr_topics: int = 4):
    """T12 over given topics and vectors: every vector with its label after the merges, ids by size."""
    e = _given(spark, sf_dir).where(F.col("label").isNotNull())
    return T.reduce_to(e.select("vec_id", F.col("label").alias("topic")), T.topic_vectors(e, "vec_id", "label", "embedding"), "vec_id", nr_topics)


# Given vectors of journals: the vector of the same number.  Rounds are few, so that the SQL can write them out.
GROUP_ROUNDS = 4
GROUP_TOPICS = 3


def _group_topics(journals, groups, min_rows):
    """T15 on given vectors: topics of at least two rows in every group of at least ``min_rows``, ids by size in the group."""
    clusters = T.fit_group_clusters(journals, "journal_id", groups, GROUP_TOPICS, GROUP_TOPICS, None, "embedding", min_rows, GROUP_ROUNDS)
    return T.label_topics(clusters, "journal_id", 2, "cluster", groups)


def _with_vectors(spark, sf_dir, journals):
    return journals.join(_given(spark, sf_dir).select(F.col("vec_id").alias("journal_id"), "embedding"), "journal_id")


def topic_per_group_vectors(spark, sf_dir):
    """A model of its own per club, on the given vectors; clubs of fewer than ten vectors are skipped."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "trail_club"])
    return _group_topics(_with_vectors(spark, sf_dir, j), ("trail_club",), 10).select("journal_id", "trail_club", "topic")


def emotion_location_vectors(spark, sf_dir):
    """A model of its own per (label, location) with at least two entries, on the given vectors: size and first
    entry of every topic."""
    j = S.journals(spark, sf_dir, with_label=True, columns=["journal_id", "label", "location_name"])
    t = _group_topics(_with_vectors(spark, sf_dir, j), ("label", "location_name"), 2)
    return t.groupBy("label", "location_name", "topic").agg(F.count(F.lit(1)).alias("n_journals"), F.min("journal_id").alias("first_journal"))


def topic_density_given(spark, sf_dir):
    """T10 by density over given vectors: clusters of neighbouring core rows, and -1 for what none reaches."""
    return T.density_topics(_given(spark, sf_dir), "vec_id", "embedding", 0.35, 5)


def topic_label_given(spark, sf_dir):
    """T10 over a given cluster column: the labels of the embeddings."""
    e = S.read_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    return T.label_topics(e, "vec_id", 45, "label")


def topic_per_group_given(spark, sf_dir):
    """T15 over a given cluster column: document languages as clusters inside each source."""
    d = S.read_table(spark, sf_dir, "documents", ["doc_id", "source", "lang"])
    return T.label_topics(d, "doc_id", 5, "lang", ("source",))


def topic_group_skipped(spark, sf_dir):
    """Clubs with too few journals to be clustered on their own."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "trail_club"])
    return T.skipped_groups(j, "trail_club", 60)


def _words(spark, sf_dir, docs, cls="topic", stop=None):
    """Words of every topic.  The counts are written once, since three steps read them and the texts are dear to read again."""
    counts = materialize(T.term_counts(docs, cls, "journal_story", _stop(spark, sf_dir) if stop is None else stop))
    return T.topic_words(T.ctfidf(counts, cls), cls)


def topic_assign(spark, sf_dir, target: int = TARGET):
    """Whole-corpus topics and c-TF-IDF words on every journal (-1 when none)."""
    j = S.journals(spark, sf_dir, with_label=False,
                   columns=["journal_id", "journal_story", "trail_club", "location_name"])
    assign = topic_fit(spark, sf_dir, target)
    return T.assign_topics(j, assign, _words(spark, sf_dir, j.join(assign, "journal_id")))


# A group's fit gets a cluster per so many rows, and at most MOST_PER_GROUP.
ROWS_PER_TOPIC = 20
MOST_PER_GROUP = 10
FIT_ROUNDS = 8


def _own_topics(stories, groups, min_rows):
    """Topics of a fit of its own for every group, ids by size in the group: ``(journal_id, groups..., topic)``."""
    k = F.greatest(F.lit(2), F.floor(F.col("n") / ROWS_PER_TOPIC)).cast("int")
    clusters = T.fit_group_clusters(stories, "journal_id", groups, k, MOST_PER_GROUP, min_rows=min_rows, rounds=FIT_ROUNDS)
    return materialize(T.label_topics(clusters, "journal_id", 2, "cluster", groups).select("journal_id", "topic"))


def topic_per_group(spark, sf_dir):
    """A topic model of its own per club, ids by size in the club, words keyed by (club, topic); every journal
    is kept, one without a club or story has no topic."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "journal_story", "trail_club"])
    labels = _own_topics(_stories(spark, sf_dir, "trail_club"), ("trail_club",), 2)
    c = j.join(labels, "journal_id", "left")
    c = c.withColumn("club_topic", F.when(F.col("topic").isNotNull(), F.concat_ws(":", "trail_club", F.col("topic").cast("string"))))
    words = _words(spark, sf_dir, c, "club_topic")
    return c.join(words, "club_topic", "left").select("journal_id", "trail_club", "topic", "topic_words")


def topic_assign_given(spark, sf_dir):
    """Q20/T14, dictionary form, over given topics: stories cut down to the vocabulary and freed of names (T2), c-TF-IDF words of
    each topic of ``embeddings`` over them, topic and words on every journal (-1 and '' when none)."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "journal_story", "trail_name", "trail_club"])
    extras = S.stop_words(spark, sf_dir).where(F.col("version") == 2).select("word")
    cleaned = C.clean_dict_substring(j, C.stop_list(j, extras), S.english_vocabulary(spark, sf_dir))
    assign = _given(spark, sf_dir).select(F.col("vec_id").alias("journal_id"), F.col("label").alias("topic"))
    cleaned = materialize(cleaned.join(assign, "journal_id").select("journal_id", "journal_story", "topic"))  # cleaned once
    words = _words(spark, sf_dir, cleaned)
    return T.assign_topics(j.select("journal_id", "trail_club"), assign, words).select("journal_id", "trail_club", "topic", "topic_words")


def valid_english_story(spark, sf_dir):
    """stories with a token that is no stop word (as written), detected as English."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "journal_story"])
    docs = S.read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    masked = C.valid_story_mask(j, _stop(spark, sf_dir), lowercase=False)
    found = L.is_english(L.detect(masked, *L.train_profile(docs), id_col="journal_id", text_col="journal_story", keep=("valid",)))
    return found.select("journal_id", (F.col("valid") & F.col("is_english")).alias("valid"))


def sentiment_weekly(spark, sf_dir):
    """Q21 -> X13 -> Q11/A16: weekly mean of the sentiment over parsed journal dates."""
    from trailspark.operators import timeseries as TS
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "date_text"])
    scored = TS.parse_dates(j).join(sentiment_score(spark, sf_dir), "journal_id")
    return TS.weekly_mean(scored, "date", "sentiment")


def sentiment_score(spark, sf_dir):
    """Sentiment class per journal, learned from the labels.

    The labels give quality and toxicity; the class is 2 + quality - 2 * toxic,
    from 0 (toxic) to 3 (good), on the reference's scale of 0 to 4.
    """
    docs = S.read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = S.read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    train = docs.join(labels, "doc_id").withColumn(
        "label", (F.lit(2) + F.col("quality") - 2 * F.col("toxic")).cast("int"))
    model = SN.train(train, "text", "label")
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "journal_story"])
    return SN.score(j, model).select("journal_id", "sentiment")


def emotion_location_topics(spark, sf_dir):
    """Q7 on fitted topics: a topic model of its own per (label, location) with at least two entries, its c-TF-IDF words,
    and the summary of each."""
    from trailspark.operators.reports import emotion_location_summary
    j = S.journals(spark, sf_dir, with_label=True, columns=["journal_id", "journal_story", "trail_club", "location_name", "label"])
    labels = _own_topics(j.where(F.col("journal_story").isNotNull()).select("journal_id", "journal_story", "label", "location_name"),
                         ("label", "location_name"), 2)
    c = j.join(labels, "journal_id", "left")
    c = c.withColumn("cell_topic", F.when(F.col("topic").isNotNull(), F.concat_ws(":", "label", "location_name", F.col("topic").cast("string"))))
    words = _words(spark, sf_dir, c, "cell_topic")
    return emotion_location_summary(c.join(words, "cell_topic", "left").drop("cell_topic"))


def topic_assign_english(spark, sf_dir, target: int = TARGET):
    """Q20, cleaned + English variant: names and extra words removed as
    substrings (T1), valid stories = some token outside the stop list (F7)
    and detected English (T5); topics are fitted on valid stories only and
    invalid rows keep a null topic (T14)."""
    j = S.journals(spark, sf_dir, with_label=False, columns=["journal_id", "journal_story", "trail_name"])
    extras = S.stop_words(spark, sf_dir).where(F.col("version") == 1).select("word")
    stop = C.stop_list(j, extras)
    # the cleaned stories feed the mask, the language test and the result, the
    # valid set the model fit and the word counts: both are written once in the
    # shared checkpoint folder instead of re-running the cleaning and the
    # language detection for each use
    cleaned = materialize(C.clean_substring(j, stop).select("journal_id", "journal_story"))
    masked = C.valid_story_mask(cleaned, stop, lowercase=False)
    docs = S.read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    lang = L.is_english(L.detect(masked, *L.train_profile(docs), id_col="journal_id", text_col="journal_story", keep=("journal_story", "valid")))
    valid = materialize(lang.where(F.col("valid") & F.col("is_english")).select("journal_id", "journal_story"))
    assign = _fitted(valid, target).select("journal_id", "topic")
    words = _words(spark, sf_dir, valid.join(assign, "journal_id"), "topic", stop)
    return T.assign_topics(cleaned.select("journal_id", "journal_story"), assign, words, unassigned=None)

"""Topic reports over a topic-assigned journals DataFrame.

Each function takes the canonical journals table (``journal_id,
journal_story, location_name, latitude, longitude, trail_club, label,
topic, topic_words``) and returns a lazy DataFrame.  Orders are total:
ties fall back to the topic id and then ``journal_id`` so results never
depend on Spark's row order.

Scale notes common to all reports: every group-by is preceded by map-side
partial aggregation, so a hot location / club / label (a third of all rows)
reaches the shuffle as one partial row per input partition; top-n filters
run as ``WindowGroupLimit`` before the shuffle, and no report collects an
unbounded group: entry lists are cut to ``n`` rows by a window before any
``collect_list``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailspark.operators.common import (drop_null_keys, not_equal_keep_null, ordered_join,
                                         ordered_list, rank_within, wide)

NO_CLUB = "No Club"


def exclude_no_club(df: DataFrame, col: str = "trail_club", sentinel: str = NO_CLUB) -> DataFrame:
    """drop the ``No Club`` sentinel, keep null clubs."""
    return df.where(not_equal_keep_null(col, sentinel))


def exclude_latitude_sentinel(df: DataFrame, col: str = "latitude", sentinel: float = -1.0) -> DataFrame:
    """drop the ``-1`` latitude sentinel, keep nulls."""
    return df.where(not_equal_keep_null(col, sentinel))


# ---------------------------------------------------------------------------
# Location reports (Q1-Q6)

def topic_counts(df: DataFrame, keys: Sequence[str], count_col: str = "counts") -> DataFrame:
    """A1: group size over ``keys`` after dropping null keys."""
    return drop_null_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))


def top_topics_words(df: DataFrame, group: str = "location_name", n: int = 3) -> DataFrame:
    """Q2: ``(group, top_topics)``: the ``n`` most frequent topics' words, ', '-joined."""
    g = topic_counts(df, [group, "topic", "topic_words"])
    top = rank_within(g, [group], [F.desc("counts"), F.asc("topic"), F.asc("topic_words")], n)
    return top.groupBy(group).agg(ordered_join("rank", "topic_words", ", ").alias("top_topics"))


def topic_share(df: DataFrame, group: str = "location_name") -> DataFrame:
    """``count / group total`` per (group, topic); topic -1 included."""
    g = topic_counts(df, [group, "topic"], "n")
    w = Window.partitionBy(group)
    return g.select(group, "topic", "n", (F.col("n") / F.sum("n").over(w)).alias("share"))


def top_share_padded(df: DataFrame, group: str = "location_name", n: int = 5) -> DataFrame:
    """Top ``n`` topics per group by share, padded with zero-share topics.

    The reference takes ``nlargest`` over a dense group x topic row, so a
    group with fewer than ``n`` topics is padded with absent topics in
    ascending id order.  Those pads are always among the ``n`` smallest topic
    ids overall, so instead of a dense grid each group is offered exactly
    those ``n`` candidate ids (a scalar array computed once) and the zero
    rows are generated per group: output is at most ``n`` rows per group and
    nothing grows quadratically.
    """
    share = topic_share(df, group)
    present = rank_within(share, [group], [F.desc("share"), F.asc("topic")], n)
    # n smallest topic ids seen in the grouped rows: a bounded global top-n.
    smallest = (share.select("topic").distinct().orderBy("topic").limit(n)
                .agg(F.sort_array(F.collect_list("topic")).alias("ids")))
    per_group = present.groupBy(group).agg(
        F.collect_list("topic").alias("have"), F.count(F.lit(1)).alias("k"))
    pads = (per_group.where(F.col("k") < n)
            .withColumn("cand", smallest.scalar())
            .select(group, "k", F.posexplode(F.array_except("cand", "have")).alias("p", "topic"))
            .where(F.col("p") < F.lit(n) - F.col("k"))
            .select(group, "topic", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("share"),
                    (F.col("k") + F.col("p") + 1).cast("int").alias("rank")))
    return present.select(group, "topic", "n", "share", "rank").unionByName(pads)


def small_groups(df: DataFrame, keys: Sequence[str], min_entries: int = 2) -> DataFrame:
    """F9 report: groups with fewer than ``min_entries`` rows (skipped by Q7)."""
    return (drop_null_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"))
            .where(F.col("entries") < min_entries))


def few_topics(df: DataFrame, group: str, min_topics: int = 5) -> DataFrame:
    """Groups with fewer than ``min_topics`` distinct topics (topic -1 excluded)."""
    g = drop_null_keys(df.where(F.col("topic") != -1), [group])
    return (g.groupBy(group).agg(F.countDistinct("topic").alias("n_topics"))
            .where(F.col("n_topics") < min_topics))


def top_topics_entries_long(df: DataFrame, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Q3: top-``n`` topics per location name, then all entries of those topics.

    The topic groups are keyed by (location, lat, lon, topic, words) and
    ranked per location name; each coordinate keeps its ranked topics.  The
    entries of a coordinate are all rows of that location *name* whose
    topic is among the coordinate's top topics (null story as 'None').
    ``by`` (e.g. ``['label']``) runs the report once per key value.

    The reference prints the entries ' | '-joined into one cell; that cell
    grows with the data, so the scale-safe result stays long: one row per
    (coordinate, entry) with ``journal_id`` as the order key.
    :func:`join_entries` builds the single cell for small outputs.
    """
    by = list(by)
    coord = by + ["location_name", "latitude", "longitude"]
    g = topic_counts(df, coord + ["topic", "topic_words"])
    top = rank_within(g, by + ["location_name"], [F.desc("counts"), F.asc("latitude"), F.asc("longitude"),
                                                  F.asc("topic"), F.asc("topic_words")], n)
    words = top.groupBy(*coord).agg(ordered_join("rank", "topic_words", ", ").alias("top_topics"))
    chosen = top.select(*coord, "topic").distinct().join(words, coord)  # topic-level rows; the texts are joined once
    entries = (drop_null_keys(df, by + ["location_name"])
               .select(*by, "location_name", "topic", "journal_id",
                       F.coalesce(F.col("journal_story"), F.lit("None")).alias("journal_entry"))
               .join(chosen, by + ["location_name", "topic"]))
    return entries.select(*coord, "top_topics", "journal_id", "journal_entry")


def join_entries(long_df: DataFrame, sep: str = " | ", by: Sequence[str] = ()) -> DataFrame:
    """Presentation form of Q3 (one joined cell per coordinate and key of ``by``, such as the label); small outputs only."""
    coord = [*by, "location_name", "latitude", "longitude", "top_topics"]
    return long_df.groupBy(*coord).agg(ordered_join("journal_id", "journal_entry", sep).alias("journal_entries"))


def entry_cells(long_df: DataFrame, sep: str = " | ", by: Sequence[str] = (), max_bytes: int = 1 << 16) -> DataFrame:
    """A12 at any size: the cells of :func:`join_entries` in numbered chunks ``(key..., chunk, journal_entries, n_entries)``.

    An entry (with a separator) belongs to the chunk in which its first byte lies, counted over the whole cell in
    ``journal_id`` order (so a long entry may be followed by a gap in the numbers); the chunks of a key, joined with ``sep``, are its cell.  Rows are range-partitioned by key and order, so a
    key with very many entries lies in several parts; sums of the parts give each its offset, and no group is
    larger than a part or a chunk.  Nulls are left out of the cell.
    """
    from trailspark.session import materialize
    key = [*by, "location_name", "latitude", "longitude", "top_topics"]
    order = ["journal_id", "journal_entry"]
    rows = long_df.where(F.col("journal_entry").isNotNull()).select(*key, *order)
    rows = materialize(rows.repartitionByRange(*key, *order).select("*", F.spark_partition_id().alias("_part"), (
        F.octet_length("journal_entry") + len(sep.encode())).cast("long").alias("_bytes")))
    safe = [F.struct(*key).alias("_key")]  # a struct of nulls is equal to itself in a join
    parts = rows.select(*safe, "_part", "_bytes").groupBy("_key", "_part").agg(F.sum("_bytes").alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_key", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset")).alias("p")
    inside = Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(*safe, *order, "_part", "_bytes").withColumn("_at", F.coalesce(F.sum("_bytes").over(inside), F.lit(0))).alias("r")
    joined = placed.join(parts, F.col("r._key").eqNullSafe(F.col("p._key")) & (F.col("r._part") == F.col("p._part")))
    joined = joined.select("r._key", *order, F.floor((F.col("_offset") + F.col("_at")) / max_bytes).cast("long").alias("chunk"))
    cells = joined.groupBy("_key", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x["journal_entry"]), sep).alias("journal_entries"),
        F.count(F.lit(1)).alias("n_entries"))
    return cells.select("_key.*", "chunk", "journal_entries", "n_entries")


def top_story_groups(df: DataFrame, n: int = 3, entries: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """Q4: story-level groups, number of journals and up to ``entries`` entry columns.

    Grouping includes the story, so null stories drop out and identical
    stories count once; ``number_of_journals`` is the number of such groups
    per coordinate; the ``n`` most frequent groups per location give the
    topic words and entries (aligned to their own coordinate).  ``by`` runs
    the report once per key value (the reference runs it per label).
    """
    by = list(by)
    coord = by + ["location_name", "latitude", "longitude"]
    keys = coord + ["topic", "topic_words", "journal_story"]
    g = topic_counts(df, keys)
    n_groups = g.groupBy(*coord).agg(F.count(F.lit(1)).alias("number_of_journals"))
    top = rank_within(g, by + ["location_name"], [F.desc("counts"), F.asc("latitude"), F.asc("longitude"),
                                                  F.asc("topic"), F.asc("topic_words"), F.asc("journal_story")], n)
    agg = top.groupBy(*coord).agg(
        ordered_join("rank", "topic_words", ", ").alias("top_topics"),
        ordered_list("rank", "journal_story").alias("stories"))
    return agg.join(n_groups, coord).select(*coord, "top_topics", "number_of_journals",
                                            *wide(F.col("stories"), entries, "journal_entry"))


def first_n_lists(df: DataFrame, n_topics: int = 3, n_entries: int = 5, group_extra: Sequence[str] = ()) -> DataFrame:
    """Q5: first rows per (location, lat, lon) in ``journal_id`` order.

    Topic words of the first ``n_topics`` rows and stories of the first
    ``n_entries`` rows (not deduplicated).  Entry *j* is the same for every
    topic *i*, as in the reference.
    """
    coord = list(group_extra) + ["location_name", "latitude", "longitude"]
    base = drop_null_keys(df, coord)
    first = rank_within(base, coord, [F.asc("journal_id")], max(n_topics, n_entries), "pos")
    agg = first.groupBy(*coord).agg(
        ordered_list("pos", F.when(F.col("pos") <= n_topics, F.col("topic_words"))).alias("words"),
        ordered_list("pos", F.col("journal_story")).alias("stories"))
    cols = [*coord]
    for i in range(1, n_topics + 1):
        cols.append(F.get(F.col("words"), i - 1).alias(f"topic_{i}_words"))
        for j in range(1, n_entries + 1):
            cols.append(F.get(F.col("stories"), j - 1).alias(f"topic_{i}_journal_entry_{j}"))
    return agg.select(*cols)


def coordinate_top_entries(df: DataFrame, n_topics: int = 3, n_entries: int = 5,
                           group: Sequence[str] = ("label",)) -> DataFrame:
    """Q6: per (label, lat, lon) the top ``n_topics`` topics by count and up to
    ``n_entries`` original entries of each, in ``journal_id`` order."""
    coord = list(group) + ["latitude", "longitude"]
    base = drop_null_keys(exclude_latitude_sentinel(df), coord + ["topic"])
    counts = base.groupBy(*coord, "topic").agg(F.count(F.lit(1)).alias("counts"))
    top = rank_within(counts, coord, [F.desc("counts"), F.asc("topic")], n_topics, "topic_rank")
    words = base.groupBy("topic").agg(F.min("topic_words").alias("topic_words"))
    ent = rank_within(base.join(top.select(*coord, "topic"), coord + ["topic"], "left_semi"),
                      coord + ["topic"], [F.asc("journal_id")], n_entries, "entry_rank")
    ent_agg = ent.groupBy(*coord, "topic").agg(ordered_list("entry_rank", "journal_story").alias("entries"))
    per_topic = (top.join(ent_agg, coord + ["topic"]).join(words, "topic", "left")
                 .select(*coord, "topic_rank", F.coalesce("topic_words", F.lit("")).alias("topic_words"), "entries"))
    agg = per_topic.groupBy(*coord).agg(
        F.array_sort(F.collect_list(F.struct("topic_rank", "topic_words", "entries"))).alias("t"))
    cols = [*coord]
    for i in range(1, n_topics + 1):
        ti = F.get(F.col("t"), i - 1)
        cols.append(ti["topic_words"].alias(f"topic_{i}_words"))
        for j in range(1, n_entries + 1):
            cols.append(F.get(ti["entries"], j - 1).alias(f"topic_{i}_entry_{j}"))
    return agg.select(*cols)


def emotion_location_summary(df: DataFrame, min_entries: int = 2, n_words: int = 3, n_entries: int = 5,
                             skip: str = "positional") -> DataFrame:
    """Q7: per (label, location) with at least ``min_entries`` entries.

    ``number_of_journals`` counts all entries (null stories too); topic
    words of the ranks 2..4 of the topic frequency (``skip='positional'``,
    the reference assumes rank 1 is the outlier topic) or of the top 3
    topics other than -1 (``skip='outlier'``); the first ``n_entries``
    stories in ``journal_id`` order.
    """
    keys = ["label", "location_name"]
    base = drop_null_keys(df, keys)
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("number_of_journals")).where(
        F.col("number_of_journals") >= min_entries)
    counts = base.groupBy(*keys, "topic").agg(F.count(F.lit(1)).alias("counts"),
                                              F.min("topic_words").alias("topic_words"))
    if skip == "outlier":
        ranked = rank_within(counts.where(F.col("topic") != -1), keys, [F.desc("counts"), F.asc("topic")], n_words)
    else:
        ranked = rank_within(counts, keys, [F.desc("counts"), F.asc("topic")], n_words + 1).where(F.col("rank") >= 2)
    words = ranked.groupBy(*keys).agg(ordered_list("rank", F.regexp_replace("topic_words", ", ", " ")).alias("w"))
    first = rank_within(base, keys, [F.asc("journal_id")], n_entries, "pos")
    stories = first.groupBy(*keys).agg(ordered_list("pos", "journal_story").alias("s"))
    out = sizes.join(words, keys, "left").join(stories, keys, "left")
    return out.select(F.col("label"), F.col("location_name").alias("location"), "number_of_journals",
                      *wide(F.col("w"), n_words, "topic_words_x"),
                      *wide(F.col("s"), n_entries, "journal_entry")).withColumnsRenamed(
        {f"topic_words_x_{i}": f"topic_{i}_words" for i in range(1, n_words + 1)})


# ---------------------------------------------------------------------------
# Club reports (Q8-Q10)

def club_topic_frequency(df: DataFrame, club: str = "trail_club") -> DataFrame:
    """Topic counts per club, descending, with the chart line."""
    g = topic_counts(df, [club, "topic"], "count")
    r = rank_within(g, [club], [F.desc("count"), F.asc("topic")])
    return r.select(club, "topic", "count", "rank",
                    F.format_string("Topic %d: %d", F.col("topic"), F.col("count")).alias("line"))


def club_dominant_topic(df: DataFrame, club: str = "trail_club", threshold: str = "literal") -> DataFrame:
    """Q9: dominant topic per club vs. its overall frequency.

    ``difference = club_count - overall_count`` is never positive, so the
    literal filter is always empty; every club is emitted with the numbers
    and the flag ``uniquely_frequent`` for the chosen ``threshold``:
    ``literal`` (difference > 0) or ``majority`` (2 * club_count > overall).
    """
    base = drop_null_keys(df, [club, "topic"])
    cc = base.groupBy(club, "topic").agg(F.count(F.lit(1)).alias("club_count"))
    dom = cc.groupBy(club).agg(
        F.max_by(F.struct("topic", "club_count"), F.struct(F.col("club_count"), -F.col("topic"))).alias("d"))
    overall = base.groupBy("topic").agg(F.count(F.lit(1)).alias("overall_count"))
    out = (dom.select(club, F.col("d.topic").alias("topic"), F.col("d.club_count").alias("club_count"))
           .join(overall, "topic")
           .withColumn("difference", F.col("club_count") - F.col("overall_count"))
           .withColumn("share_of_topic", F.col("club_count") / F.col("overall_count")))
    flag = (F.col("difference") > 0) if threshold == "literal" else (2 * F.col("club_count") > F.col("overall_count"))
    return out.withColumn("uniquely_frequent", flag).select(
        club, "topic", "club_count", "overall_count", "difference", "share_of_topic", "uniquely_frequent")


def above_average_topics(df: DataFrame, club: str = "trail_club") -> DataFrame:
    """Topics whose share in a club exceeds their mean share over
    all clubs (absent = 0, so mean = sum(share) / number of clubs)."""
    share = topic_share(df, club)
    n_groups = share.select(club).distinct().agg(F.count(F.lit(1)).alias("g"))
    mean = share.groupBy("topic").agg(F.sum("share").alias("s")).withColumn("mean_share", F.col("s") / n_groups.scalar())
    return (share.join(mean.select("topic", "mean_share"), "topic")
            .where(F.col("share") > F.col("mean_share"))
            .select(club, "topic", "n", "share", "mean_share"))


def above_average_lists(df: DataFrame, club: str = "trail_club") -> DataFrame:
    """Q10 list form: one row per club, its above-average topics ascending
    (clubs with none keep an empty list)."""
    clubs = drop_null_keys(df, [club]).select(club).distinct()
    hits = above_average_topics(df, club).groupBy(club).agg(F.sort_array(F.collect_list("topic")).alias("topics"))
    return clubs.join(hits, club, "left").select(
        club, F.coalesce("topics", F.array().cast("array<int>")).alias("topics"))


def topic_chart_rows(ranked: DataFrame, group: str, topic_words: DataFrame, min_words: int = 3,
                     exclude_group: str = NO_CLUB) -> DataFrame:
    """Chart table from (group, topic, rank) rows.

    Drops the excluded group and topics -1 and 0; topics with fewer than
    ``min_words`` words show empty words; lines sorted by number of words
    descending (stable on the incoming rank); one row per group with the
    item count and the '<br>'-joined ``Topic t: words`` lines.
    """
    tw = topic_words.select("topic", F.split("topic_words", ", ").alias("wl"))
    tw = tw.withColumn("wl", F.when(F.size("wl") >= min_words, F.col("wl")).otherwise(F.array().cast("array<string>")))
    r = (ranked.where(not_equal_keep_null(group, exclude_group) & ~F.col("topic").isin(-1, 0))
         .join(tw, "topic", "left")
         .withColumn("wl", F.coalesce("wl", F.array().cast("array<string>"))))
    lines = r.select(group, "rank", F.size("wl").alias("nw"),
                     F.format_string("Topic %d: %s", F.col("topic"), F.array_join("wl", ", ")).alias("line"))
    groups = drop_null_keys(ranked, [group]).where(not_equal_keep_null(group, exclude_group)).select(group).distinct()
    agg = lines.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_topics"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("nw")).alias("k"), "rank", "line"))),
                                 lambda x: x["line"]), "<br>").alias("lines"))
    return groups.join(agg, group, "left").select(
        group, F.coalesce("n_topics", F.lit(0)).alias("n_topics"), F.coalesce("lines", F.lit("")).alias("lines"))

"""Physical-plan checks: pruning, pushdown, partial top-n and join strategies."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_columns_and_limits_before_shuffle(spark):
    p = plan(E.queries()["location_top3_words"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in p or "doc_id:bigint,source:string" in p
    assert "WindowGroupLimit" in p and "Partial" in p


def test_range_join_is_a_hash_join(spark):
    p = plan(E.queries()["club_first_match"](spark, SF))
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p
    # the only nested loop is on the small lookup (pieces x club ranges,
    # condition on the piece representative), never on the fact rows
    nlj = [ln for ln in p.splitlines() if "NestedLoopJoin" in ln]
    assert all("rep#" in ln for ln in nlj)


def test_rounded_join_broadcasts_checked_lookup(spark):
    p = plan(E.queries()["shelter_match"](spark, SF))
    assert "BroadcastHashJoin" in p


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F
    from trailspark.sources.tables import read_table
    df = read_table(spark, SF, "events", ["ts", "value", "event_type"]).where(F.col("event_type") == "click")
    p = plan(df.select("value"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in p


def test_no_jobs_while_plans_are_built(spark):
    """Reports and cleaning run nothing before their result is used."""
    from trailspark.plans import registry
    sc = spark.sparkContext
    for name in ("location_top3_words", "emotion_location_summary", "club_dominant_topic", "shelter_match", "clean_substring",
                 "clean_dict_substring", "clean_tokens", "valid_story_mask", "term_counts_bigrams", "topic_similarity"):
        sc.setJobGroup(f"build-{name}", name)
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        # reading a Parquet schema is a job of its own: one per table, whatever its size
        jobs = sc.statusTracker().getJobIdsForGroup(f"build-{name}")
        stages = [s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
        assert all(sc.statusTracker().getStageInfo(s).numTasks == 1 for s in stages) and len(jobs) <= 12, (name, len(jobs))
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_many_club_ranges(spark):
    import random
    from trailspark.operators import geo as G
    rng = random.Random(1)
    ranges = [(f"c{k}", k, *sorted((rng.uniform(-50, 50), rng.uniform(-50, 50)))) for k in range(300)]
    ranges = [(c, k, s, min(e, s + 2)) for c, k, s, e in ranges] + [("point", -1, 7.0, 7.0), ("inverted", -2, 9.0, 8.0), ("same", 400, 7.0, 7.0)]
    points = [rng.uniform(-55, 55) for _ in range(300)] + [7.0] + [r[2] for r in ranges[:40]] + [r[3] for r in ranges[:40]]
    clubs = spark.createDataFrame(ranges, "trail_club string, club_order int, lat_start double, lat_end double")
    rows = spark.createDataFrame([(i, repr(p)) for i, p in enumerate(points)] + [(-1, "x"), (-2, None)], "id int, latitude string")
    got = {r["id"]: r["trail_club"] for r in G.assign_clubs(rows, clubs).collect()}
    for i, p in enumerate(points):
        hit = [(k, c) for c, k, s, e in ranges if s <= p <= e]
        assert got[i] == (min(hit)[1] if hit else ""), p
    assert got[-1] == got[-2] == ""

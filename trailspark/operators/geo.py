"""Geo attribution: shelters by rounded latitude (J1-J3), clubs by latitude
range with first-match-wins (J4, J5), club gap fill (P5 / N15).

Both joins are equi-joins on an integral key (rounded hundredths, or a
latitude bin), so the fact table is never compared against every lookup
row; Spark broadcasts a lookup whose measured size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.functions.geo import lenient_double, rounded_key, valid_coordinate
from trailspark.functions.text import ustrip
from trailspark.session import cut_lineage

NO_CLUB = "No Club"

# ---------------------------------------------------------------------------
# Rounded equi-join


def clean_latitude(df: DataFrame, col: str = "latitude") -> DataFrame:
    """X9 + F3: lenient parse, drop rows that do not parse or are NaN/inf."""
    return df.withColumn(col, lenient_double(col)).where(valid_coordinate(col))


def attach_shelters(posts: DataFrame, shelters: DataFrame, decimals: int = 2, lat: str = "latitude",
                    how: str = "left") -> DataFrame:
    """Join posts to shelters on latitude rounded half-even to ``decimals``.

    Several shelters on one rounded latitude multiply the post (as a merge
    does).  The shelter name becomes ``location_name`` (P2).  ``how='inner'``
    gives the matched rows only (J3).
    """
    p = clean_latitude(posts, lat).withColumn("_key", rounded_key(lat, decimals))
    s = (clean_latitude(shelters.select("shelter_name", F.col(lat).alias("_slat")), "_slat")
         .select(rounded_key("_slat", decimals).alias("_key"), F.col("shelter_name").alias("location_name")))
    return p.join(s, "_key", how).drop("_key")


def unmatched_posts(posts: DataFrame, shelters: DataFrame, decimals: int = 2, lat: str = "latitude") -> DataFrame:
    """Posts with a valid latitude and no shelter on the rounded key."""
    p = clean_latitude(posts, lat).withColumn("_key", rounded_key(lat, decimals))
    s = (clean_latitude(shelters.select(F.col(lat).alias("_slat")), "_slat")
         .select(rounded_key("_slat", decimals).alias("_key")).distinct())
    return p.join(s, "_key", "left_anti").drop("_key")


# ---------------------------------------------------------------------------
# Range join, first club in file order wins, bounds inclusive.

# Different range bounds in one slice of the line.
SLICE_BOUNDS = 8192


def club_pieces(clubs: DataFrame, slice_bounds: int = SLICE_BOUNDS) -> DataFrame:
    """Resolve ordered, possibly overlapping club ranges into disjoint pieces.

    The boundaries of all valid ranges cut the line into points and open
    intervals; on each piece the set of covering ranges is constant, so the
    winner (smallest ``club_order``) is decided once here, on the lookup
    side.  Each fact row then matches at most one piece: the join needs no
    post-aggregation and keeps exactly one row per input row.

    No task holds the whole lookup: sampled splitters cut the line into slices of about
    ``slice_bounds`` different bounds.  A range is sent, clipped, to the slices in
    which it begins and ends only; of the ranges that cover a slice from end to end just
    the first club counts, and it is carried there by :func:`_carried`.  One sweep
    per slice then finds its pieces.

    Columns: ``lo, hi, lo_incl, hi_incl, trail_club``.  Inverted ranges
    (start > end) never match, as in the reference.
    """
    valid = (clubs.select(F.col("lat_start").cast("double").alias("s"), F.col("lat_end").cast("double").alias("e"),
                          F.struct(F.col("club_order").alias("o"), F.col("trail_club").cast("string").alias("club")).alias("w"))
             .where(valid_coordinate("s") & valid_coordinate("e") & (F.col("s") <= F.col("e"))))
    ranges = cut_lineage(valid.groupBy("s", "e").agg(F.min("w").alias("w")))
    bounds = ranges.select(F.explode(F.array("s", "e")).alias("x")).distinct()
    n = bounds.count()
    slices = max(1, -(-n // slice_bounds))
    cuts = []
    if slices > 1:  # slice k begins at cut k - 1; one number per slice reaches the driver
        shares = [k / slices for k in range(1, slices)]
        cuts = sorted(set(bounds.select(F.percentile_approx("x", shares, 100 * slices)).first()[0]))
    edges = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")

    def slice_of(x):
        return F.size(F.filter(edges, lambda c: c <= x))

    dealt = ranges.select("*", slice_of(F.col("s")).alias("a"), slice_of(F.col("e")).alias("b"))
    top, low = F.get(edges, F.col("k")), F.get(edges, F.col("k") - 1)  # null at the ends of the line
    ends = (dealt.select("s", "e", "w", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("k"))
            .select("k", F.when(F.col("a") == F.col("k"), F.col("s")).otherwise(low).alias("lo"),
                    F.when(F.col("b") == F.col("k"), F.col("e")).otherwise(top).alias("hi"), "w"))
    through = _carried(dealt.where(F.col("b") - F.col("a") > 1).select((F.col("a") + 1).alias("l"), F.col("b").alias("r"), "w"))
    through = through.select("k", low.alias("lo"), top.alias("hi"), "w")
    parts = ends.unionByName(through).groupBy("k", "lo", "hi").agg(F.min("w").alias("w"))
    rows = parts.select("k", "lo", "hi", F.col("w.o").alias("o"), F.col("w.club").alias("club"), top.alias("end"))
    schema = "lo double, hi double, lo_incl boolean, hi_incl boolean, trail_club string"
    return rows.groupBy("k").applyInPandas(_sweep, schema)


def _carried(spans: DataFrame) -> DataFrame:
    """``k, w``: the smallest ``w`` of all spans [l, r) of slices that hold slice k.

    A span is two overlapping windows of a power of two (the smallest of a set may be counted twice); windows are
    halved level by level, keeping the smallest of each, so a span costs two rows however long it is.
    """
    level = F.floor(F.log2(F.col("r") - F.col("l")) + 1e-9).cast("int")
    windows = spans.select(level.alias("j"), "l", "r", "w")
    size = F.expr("shiftleft(1, j)")
    windows = windows.select("j", F.explode(F.array(F.col("l"), F.col("r") - size)).alias("k"), "w").groupBy("j", "k").agg(F.min("w").alias("w"))
    windows = cut_lineage(windows)
    highest = windows.agg(F.max("j")).first()[0]
    if highest is None:
        return windows.select("k", "w")
    now = windows.where(F.col("j") == highest).select("k", "w")
    for j in range(highest - 1, -1, -1):
        halves = now.select(F.explode(F.array(F.col("k"), F.col("k") + F.lit(1 << j))).alias("k"), "w")
        now = halves.unionByName(windows.where(F.col("j") == j).select("k", "w")).groupBy("k").agg(F.min("w").alias("w"))
    return now


def _sweep(pdf):
    """Disjoint pieces of one slice with the first club that covers each.

    A heap holds the ranges that have begun, smallest order first; ranges that
    have ended leave it when they come to its top, so the sweep is
    O(ranges log ranges).  ``end``, where the next slice begins, is a bound, but its point is the next slice's.
    """
    import heapq

    import pandas as pd
    end = pdf["end"].iloc[0]
    rows = sorted(zip(pdf["lo"], pdf["hi"], pdf["o"], pdf["club"], strict=True), key=lambda r: r[:3])
    bounds = sorted({x for s, e, _, _ in rows for x in (s, e)})
    out, heap, k = [], [], 0
    for i, lo in enumerate(bounds):
        if lo == end:
            break
        while k < len(rows) and rows[k][0] <= lo:
            heapq.heappush(heap, (rows[k][2], rows[k][3] or "", k))
            k += 1
        while heap and rows[heap[0][2]][1] < lo:
            heapq.heappop(heap)
        if heap:
            out.append((lo, lo, True, True, rows[heap[0][2]][3]))
        # the open interval up to the next bound: ranges that end at lo don't reach it
        while heap and rows[heap[0][2]][1] <= lo:
            heapq.heappop(heap)
        if heap and i + 1 < len(bounds):
            out.append((lo, bounds[i + 1], False, False, rows[heap[0][2]][3]))
    return pd.DataFrame(out, columns=["lo", "hi", "lo_incl", "hi_incl", "trail_club"])


def _in_piece(lat, p) -> F.Column:
    above = (lat > p.lo) | (p.lo_incl & (lat == p.lo))
    below = (lat < p.hi) | (p.hi_incl & (lat == p.hi))
    return above & below


def assign_clubs(locations: DataFrame, clubs: DataFrame, lat: str = "latitude",
                 bin_width: float | None = None, fill: str | None = "") -> DataFrame:
    """Add ``trail_club`` to every location row.

    Rows whose latitude does not parse are kept, unassigned.  Unmatched rows
    get ``fill`` ('' as in the reference; None keeps null).  The join runs
    on an integral latitude bin (``floor(lat / bin_width)``) with the exact
    bound test as a residual, so it is an equi-join, not a nested loop;
    Spark broadcasts the pieces if it measures them to be small.
    """
    pieces = cut_lineage(club_pieces(clubs))  # read four times below
    if bin_width is None:
        span = pieces.agg((F.max("hi") - F.min("lo")).alias("span"), F.count(F.lit(1)).alias("n"))
        bw = F.greatest(span.select(F.col("span") / F.greatest(F.col("n"), F.lit(1))).scalar(), F.lit(1e-9))
    else:
        bw = F.lit(float(bin_width))
    pieces = pieces.withColumn("_bw", bw)
    binned = pieces.select("*", F.explode(F.sequence(F.floor(F.col("lo") / F.col("_bw")),
                                                      F.floor(F.col("hi") / F.col("_bw")))).alias("_bin"))
    p = binned.alias("p")
    lat_val = lenient_double(lat)
    rows = locations.withColumn("_lat", F.when(valid_coordinate(lat_val), lat_val))
    # rows without a position match nothing: spread their bins instead of one null key
    rows = rows.withColumn("_bin", F.coalesce(F.floor(F.col("_lat") / bw), F.xxhash64(F.rand(0))))
    j = rows.alias("r").join(p, (F.col("r._bin") == F.col("p._bin")) & _in_piece(F.col("r._lat"), p), "left")
    club = F.col("p.trail_club")
    if fill is not None:
        club = F.coalesce(club, F.lit(fill))
    out_cols = [F.col(f"r.{c}") for c in locations.columns if c != "trail_club"]
    return j.select(*out_cols, club.alias("trail_club"))


def unassigned_latitudes(locations: DataFrame, clubs: DataFrame, lat: str = "latitude") -> DataFrame:
    """Rows with a valid latitude that no club range covers."""
    assigned = assign_clubs(locations, clubs, lat, fill=None)
    lat_val = lenient_double(lat)
    return assigned.where(valid_coordinate(lat_val) & F.col("trail_club").isNull()).drop("trail_club")


def fill_no_club(df: DataFrame, col: str = "trail_club", value: str = NO_CLUB) -> DataFrame:
    """Blank or null club -> ``No Club`` (raises if the column is missing)."""
    if col not in df.columns:
        raise ValueError(f"column {col!r} not found; columns are {df.columns}")
    s = ustrip(F.col(col))
    return df.withColumn(col, F.when(F.length(s) > 0, F.col(col)).otherwise(F.lit(value)))

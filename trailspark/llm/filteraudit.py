"""Filter interaction audit by the Hart-Mas-Colell potential.

Filters are players.  The removal game of a part gives a coalition S of filters ``v(S)``, the documents that at
least one filter of S fails.  Its potential is P(empty) = 0 and P(S) = (v(S) + sum of P(S without i)) / |S|; filter
i's Shapley value is P(all) - P(all without i).  With n filters the potential is kept times n!, where every division
is exact, so n! times the Shapley value (what the filter removes, summed over all orders) is an integer.  The
steps of an order are differences of coalition values: with S before filter i, i removes v(S + i) - v(S).

Documents become one bit mask of failed filters; masks are counted per part with partial aggregation, and
everything after the counts works on one row per part.  All of it is DataFrame expressions.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import materialize

SPACES = r"[ \t\n\x0B\f\r]+"


def text_fails(text: str = "text") -> dict[str, Column]:
    """Failure of the filters that look at one text only: A to D.  A null text is empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(whole, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * distinct.cast("long") < 50 * n.cast("long"),
        "C": 100 * F.regexp_count(whole, F.lit("[A-Z]")).cast("long") > 2 * F.length(whole).cast("long"),
        "D": whole.rlike(r"[#$%&*|]"),
    }


def later_copy(rows: DataFrame, doc_id: str = "doc_id", key: str = "__text_key") -> DataFrame:
    """``rows`` with ``__copy``: whether a smaller id has the same text.  Rows without an id are never copies and no row's original.

    Only texts that several rows share are joined back; a text that very many rows share is one row of that side.
    """
    shared = rows.where(F.col(doc_id).isNotNull()).groupBy(key).agg(F.min(doc_id).alias("__first"), F.max(doc_id).alias("__last"))
    shared = shared.where(F.col("__first") < F.col("__last")).select(key, "__first")
    return (rows.join(shared, key, "left")
            .withColumn("__copy", F.coalesce(F.col(doc_id) > F.col("__first"), F.lit(False))).drop("__first"))


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``doc_id, part, mask, good, toxic``: bit i of ``mask`` is set if filter i of ABCDE fails.

    A text is known by its SHA-256.  Repeated label rows of an id count once; ids without a label are neither good nor toxic.
    """
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_fails().values())), F.lit(0))
    narrow = materialize(docs.select(
        "doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("__mask"),
        F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)).alias("__text_key")))
    judged = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return later_copy(narrow).join(judged, "doc_id", "left").select(
        "doc_id", "part", (F.col("__mask") + F.when(F.col("__copy"), F.lit(16)).otherwise(F.lit(0))).alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _values(counts: str, n: int) -> Column:
    """Coalition values from the counts by mask: ``v[S]`` is what any filter of S fails."""
    return F.expr(f"transform(sequence(0, {2 ** n - 1}), s -> aggregate(sequence(0, {2 ** n - 1}), 0L,"
                  f" (a, m) -> a + if((m & s) != 0, {counts}[m], 0L)))")


def _potential(values: str, n: int) -> Column:
    """n! times the potential of every coalition, smaller coalitions first (S without i is a smaller number)."""
    rest = f"aggregate(sequence(0, {n - 1}), 0L, (a, i) -> a + if((shiftright(s, i) & 1) = 1, p[s - shiftleft(1, i)], 0L))"
    return F.expr(f"aggregate(sequence(1, {2 ** n - 1}), array(0L), (p, s) ->"
                  f" array_append(p, ({factorial(n)}L * {values}[s] + {rest}) div bit_count(s)))")


def audit(masks: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """One row per part, order of ``filters`` and step, from rows of ``part, mask, good, toxic``.

    ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` are counts of the part; a part occurs if it
    has a row, and an empty table has none.  Columns of ``masks`` beside the four are ignored.
    """
    n = len(filters)
    full = 2 ** n - 1

    # partial counts by cell first: the 3 x 2^n conditional sums then run over a few hundred rows per part
    cells = masks.groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))

    def summed(condition: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when((F.col("mask") == m) & condition, F.col("n"))), F.lit(0)).cast("long") for m in range(full + 1)])

    games = cells.groupBy("part").agg(
        summed(F.lit(True)).alias("c"), summed(F.col("good")).alias("cg"), summed(F.col("toxic")).alias("ct"))
    games = games.withColumns({"v": _values("c", n), "vg": _values("cg", n), "vt": _values("ct", n)})
    games = games.withColumn("p", _potential("v", n)).withColumn("rows", F.expr("aggregate(c, 0L, (a, x) -> a + x)"))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for at, i in enumerate(order, 1):
            steps.append(("".join(filters[k] for k in order), at, before, 1 << i))
            before |= 1 << i
    spark = masks.sparkSession
    plan = spark.createDataFrame(steps, "filter_order string, step int, before int, bit int")
    plan = plan.agg(F.collect_list(F.struct("filter_order", "step", "before", "bit")).alias("steps"))

    def value(game: str, coalition: Column) -> Column:
        return F.element_at(game, coalition + 1)

    x = games.select("*", F.explode(plan.select("steps").scalar()).alias("x")).select("*", "x.*")
    after, removed = F.col("before") + F.col("bit"), value("v", F.col("before") + F.col("bit")) - value("v", F.col("before"))
    return x.select(
        "part", "filter_order", "step", (F.col("rows") - value("v", after)).alias("kept"), removed.alias("removed"),
        (value("v", F.col("bit")) - removed).alias("redundant"),
        (value("v", F.lit(full)) - value("v", full - F.col("bit"))).alias("unique_fails"),
        (value("vg", after) - value("vg", F.col("before"))).alias("good_lost"),
        (value("vt", after) - value("vt", F.col("before"))).alias("toxic_lost"),
        (value("p", F.lit(full)) - value("p", full - F.col("bit"))).alias("shapley"))

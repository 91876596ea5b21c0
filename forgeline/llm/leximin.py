"""One ranking from several differently scaled scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentiles(df: DataFrame, group: str, item: str, scores: list[str], cuts: int = 64) -> DataFrame:
    """``group``, ``item`` and one exact percentile per score: the share of the group's other items below it.

    Works for groups of any size without bringing a group into one task: equal scores are first counted
    together, each group's values are split at ``cuts`` quantiles (``percentile_approx``, a bounded sketch that
    combines on the map side), and an exact rank is the count in lower buckets plus the rank in the own bucket.
    Approximate cuts only shift bucket borders; the ranks are exact. ``df`` has one row per item; a null or NaN
    score is the lowest and gives percentile 0. In a group of one item every percentile is 0.
    """
    clean = lambda c: F.when(F.isnan(c), None).otherwise(c)
    # (group, item, which score, value); counted to (group, which score, value) -> number of items
    each = df.select(F.col(group).alias("__g"), F.col(item).alias("__i"), F.explode(F.array(*[F.struct(F.lit(i).alias("k"), clean(F.col(s).cast("double")).alias("v")) for i, s in enumerate(scores)])).alias("x"))
    long = each.select("__g", "__i", "x.k", "x.v")
    vals = long.groupBy("__g", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    qs = [(i + 1) / cuts for i in range(cuts - 1)]
    borders = vals.groupBy("__g", "k").agg(F.percentile_approx("v", qs, 10 * cuts).alias("q"), F.sum("n").alias("total"))
    bucketed = vals.join(borders, ["__g", "k"]).withColumn("b", F.when(F.col("v").isNull(), -1).otherwise(F.coalesce(F.size(F.filter("q", lambda c: c < F.col("v"))), F.lit(0)))).drop("q")
    sums = bucketed.groupBy("__g", "k", "b").agg(F.sum("n").alias("m"))
    below = sums.select("__g", "k", "b", (F.sum("m").over(W.partitionBy("__g", "k").orderBy("b")) - F.col("m")).alias("under"))
    inner = W.partitionBy("__g", "k", "b").orderBy("v")
    ranks = (
        bucketed.withColumn("within", F.sum("n").over(inner) - F.col("n"))
        .join(below, ["__g", "k", "b"])
        .select("__g", "k", "v", F.when(F.col("v").isNull() | (F.col("total") < 2), 0.0).otherwise((F.col("under") + F.col("within")) / (F.col("total") - 1)).alias("p"))
    )
    # one join for all scores. The value spreads the rows of a hot group over its partitions; items without one, which
    # need no partner, are spread by the hash of the item
    key = lambda none: F.struct(none.alias("none"), F.col("v").alias("v"))
    mine = long.select("__g", "__i", "k", key(F.when(F.col("v").isNull(), F.xxhash64("__i"))).alias("__k"))
    theirs = ranks.where("v is not null").select("__g", "k", key(F.lit(None).cast("long")).alias("__k"), "p")
    found = mine.join(theirs, ["__g", "k", "__k"], "left")
    pct = [F.coalesce(F.max(F.when(F.col("k") == i, F.col("p"))), F.lit(0.0)).alias(f"pct_{s}") for i, s in enumerate(scores)]
    return found.groupBy(F.col("__g").alias(group), F.col("__i").alias(item)).agg(*pct)


def leximin_vector(cols: list[str]) -> F.Column:
    """The item's own percentiles in ascending order; arrays compare lexicographically in Spark."""
    return F.array_sort(F.array(*[F.col(c) for c in cols]))


def merged_scores(candidates: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """One row per item of a group: of each score the greatest of its rows (null and NaN are missing)."""
    clean = [F.max(F.when(F.isnan(F.col(s).cast("double")), None).otherwise(F.col(s).cast("double"))).alias(s) for s in scores]
    return candidates.select(group, item, *scores).where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group, item).agg(*clean)


def leximin_best(candidates: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """``group``, ``item``: the first of each group; ties go to the smallest item."""
    p = percentiles(merged_scores(candidates, group, item, scores), group, item, scores)
    v = leximin_vector([f"pct_{s}" for s in scores])
    w = W.partitionBy(group).orderBy(F.col("__v").desc(), F.col(item))
    return p.select(group, item, v.alias("__v")).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(group, item)


def leximin_ranking(candidates: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """``group``, ``item``, one percentile per score and ``rank`` (1 = first, ties by item) for every item.

    The items are sorted by group, vector and item over all partitions (range partitioning by the whole key, so
    neither a hot group nor a mass of equal vectors meets in one task) and written; a rank is the place within the
    group's rows of a partition and the number of its rows in the partitions before.
    """
    from forgeline.session import cut

    pct = [f"pct_{s}" for s in scores]
    p = percentiles(merged_scores(candidates, group, item, scores), group, item, scores).withColumn("__v", leximin_vector(pct))
    placed = cut(p.orderBy(F.col(group), F.col("__v").desc(), F.col(item)).select(group, item, *pct, F.monotonically_increasing_id().alias("__at")))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    parts = placed.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # at most one row per group and partition
    before = parts.select(group, "__part", "__first", (F.sum("__n").over(W.partitionBy(group).orderBy("__part")) - F.col("__n")).alias("__before"))
    return placed.join(before, [group, "__part"]).select(group, item, *pct, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("rank"))

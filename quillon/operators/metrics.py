"""Quality measures: precision, recall and F1 by category, ranking measures, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prf(pairs: DataFrame, category: str, gold: str, predicted: str) -> DataFrame:
    """(category, tp, fp, fn, precision, recall, f1) of boolean columns; empty denominators give 1."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    g, p = F.col(gold), F.col(predicted)
    by = pairs.groupBy(category).agg(count(g & p).alias("tp"), count(~g & p).alias("fp"), count(g & ~p).alias("fn"))
    ratio = lambda n, d: F.when(d == 0, 1.0).otherwise(n / d)
    by = by.withColumn("precision", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6))
    return by.withColumn("f1", F.round(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def at_k(df: DataFrame, group: list[str], order: list[Column], relevance: str, k: int) -> DataFrame:
    """(group, precision, recall, ndcg) of the first k by ``order``; precision divides by k even for short lists.

    Only each group's first k rows and its ideal k reach the sort; totals are combined sums.
    """
    rank = lambda o: F.row_number().over(Window.partitionBy(*group).orderBy(*o))
    rel = F.col(relevance).cast("double")
    gain = lambda r: rel / F.log2(r + 1)
    got = df.withColumn("__r", rank(order)).filter(F.col("__r") <= k).groupBy(*group).agg(F.sum((rel > 0).cast("int")).alias("hits"), F.sum(gain(F.col("__r"))).alias("dcg"))
    ideal = df.withColumn("__r", rank([F.col(relevance).desc_nulls_last()])).filter(F.col("__r") <= k).groupBy(*group).agg(F.sum(gain(F.col("__r"))).alias("idcg"))
    total = df.groupBy(*group).agg(F.sum((rel > 0).cast("int")).alias("relevant"))
    joined = got.join(ideal, group).join(total, group)
    ratio = lambda n, d, empty: F.when(d == 0, empty).otherwise(n / d)
    return joined.select(*group, F.round(F.col("hits") / k, 6).alias("precision"), F.round(ratio(F.col("hits"), F.col("relevant"), 1.0), 6).alias("recall"), F.round(ratio(F.col("dcg"), F.col("idcg"), 1.0), 6).alias("ndcg"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho) of two ranks by 1 - 6 sum d^2 / (n (n^2 - 1)); rho is 1 for fewer than two rows."""
    d = (F.col(a) - F.col(b)).cast("double")
    by = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(d * d), F.lit(0.0)).alias("__d"))
    n = F.col("n").cast("double")
    return by.select("n", F.when(n < 2, 1.0).otherwise(F.round(1 - 6 * F.col("__d") / (n * (n * n - 1)), 6)).alias("rho"))


def distribution(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, mean, median, p90, max); p90 is the value at place int(0.9 (n - 1)) in ascending order.

    The place is found by running counts over distinct values, so a group is never collected.
    """
    v = F.col(value)
    counts = df.filter(v.isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    at = lambda place: F.min(F.when(F.col("upto") > place, v))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    by = run.groupBy(*group).agg(F.max("n").alias("n"), F.round(F.sum(v * F.col("c")) / F.sum("c"), 4).alias("mean"), F.round((at(low) + at(high)) / 2, 4).alias("median"), at(F.floor(0.9 * (F.col("n") - 1))).alias("p90"), F.max(value).alias("max"))
    return by


def ranking_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, mean, p50, p90, max) of a ranking; in descending order p50 stands at place n // 2 and p90 at place
    int(n / 10) - 1, the first at least. Places are found by running counts over distinct values."""
    v = F.col(value)
    counts = df.filter(v.isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    down = Window.partitionBy(*group).orderBy(v.desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("c").over(down)).withColumn("n", F.sum("c").over(Window.partitionBy(*group)))
    at = lambda place: F.max(F.when(F.col("upto") > place, v))
    top = F.greatest(F.lit(0), F.floor(F.col("n") * 0.1) - 1)
    return run.groupBy(*group).agg(F.max("n").alias("n"), F.round(F.sum(v * F.col("c")) / F.sum("c"), 2).alias("mean"), at(F.floor(F.col("n") / 2)).alias("p50"), at(top).alias("p90"), F.max(value).alias("max"))


#: A fall of F1 that counts as a regression: fixed value.
F1_FALL = 0.05


def gate(now: DataFrame, stored: DataFrame, key: str, value: str, higher_is_better: bool = True, tolerance: float = F1_FALL) -> DataFrame:
    """(key, before, now, regressed): measures against a stored baseline; a measure without one can't regress."""
    both = now.select(key, F.col(value).alias("now")).join(stored.select(key, F.col(value).alias("before")), key, "left")
    worse = F.col("now") < F.col("before") - tolerance if higher_is_better else F.col("now") > F.col("before") + tolerance
    return both.select(key, "before", "now", F.coalesce(worse, F.lit(False)).alias("regressed"))

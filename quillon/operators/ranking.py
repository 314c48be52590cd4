"""Ranks, percentiles, deltas, movers, top-k per group and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import delta
from quillon.session import cut

PAGE, MOST_PAGE = 50, 500


def ranked(df: DataFrame, universe: list[str], score: str) -> DataFrame:
    """Competition rank (ties share it) and percentile, the share of the universe scored no higher, in percent.

    Rank and percentile are counts over distinct scores, summed up before rows are touched: a universe that holds all
    rows is never sorted in one task by row, only by its distinct scores. A null score has neither.
    """
    levels = df.filter(F.col(score).isNotNull()).groupBy(*universe, score).agg(F.count("*").alias("__n"))
    above = Window.partitionBy(*universe).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*universe)
    levels = levels.withColumn("__above", F.coalesce(F.sum("__n").over(above), F.lit(0))).withColumn("__all", F.sum("__n").over(all_))
    levels = levels.select(*universe, score, (F.col("__above") + 1).alias("rank"), F.round(100.0 * (F.col("__all") - F.col("__above")) / F.col("__all"), 2).alias("percentile"))
    names = [*universe, score]
    levels = levels.withColumnsRenamed({n: f"__{n}" for n in names})
    condition = F.col(score) == F.col(f"__{score}")
    for u in universe:
        condition = condition & F.col(u).eqNullSafe(F.col(f"__{u}"))
    return df.join(levels, condition, "left").select(*df.columns, "rank", "percentile")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("place") <= k)


def changes(df: DataFrame, keys: list[str], at: str, score: str, rank: str) -> DataFrame:
    """Score and rank changes against the snapshot before; a first snapshot has null changes. Ranks that fall are gains."""
    w = Window.partitionBy(*keys).orderBy(at)
    before_score, before_rank, first = F.lag(score).over(w), F.lag(rank).over(w), F.row_number().over(w) == 1
    return df.select("*", F.when(~first, F.round(delta(F.col(score), before_score), 4)).alias("score_change"), (before_rank - F.col(rank)).alias("rank_change"))


def movers(df: DataFrame, keys: list[str], change: str, tie: str, k: int = 12, least: float = 1e-4) -> DataFrame:
    """The k largest changes of each key by size, those of at most ``least`` left out."""
    return top_k(df.filter(F.abs(F.col(change)) > least), keys, [F.abs(F.col(change)).desc(), F.col(tie).asc()], k)


def page(df: DataFrame, sort: str, allowed: dict[str, str], default: str, number: int = 1, size: int = PAGE) -> DataFrame:
    """A page of rows: ``sort`` is an allowed name, with '-' for descending; ties go by ``default``, sizes are clamped."""
    name = sort.removeprefix("-")
    column = F.col(allowed.get(name, default))
    order = [column.desc_nulls_last() if sort.startswith("-") else column.asc_nulls_last(), F.col(default).asc()]
    size = max(1, min(size, MOST_PAGE))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place in one order of all rows, which should be total.

    Rows are laid into ranges, numbered within each, and the ranges' sizes added up: no task sorts more than a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    sizes = laid.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.broadcast(sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return laid.withColumn("__within", within).join(starts, "__range").select(*df.columns, (F.col("__start") + F.col("__within")).alias(name))

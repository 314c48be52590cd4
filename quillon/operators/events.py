"""Events: exact and near-duplicate collapse, and employment intervals."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.values import event_key


def new_events(batch: DataFrame, active: DataFrame, order: list[str]) -> DataFrame:
    """Events of a batch whose key (person, type, day) is not active yet, one of each."""
    keyed = batch.withColumn("dedupe_key", event_key(F.col("person_id"), F.col("event_type"), F.col("occurred_at")))
    w = Window.partitionBy("dedupe_key").orderBy(*order)
    first = keyed.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    return first.join(active.select("dedupe_key").distinct(), "dedupe_key", "left_anti")


def collapsed(df: DataFrame, keys: list[str], at: str, tie: str, days: int = 60) -> DataFrame:
    """Rows that stay when, in time order, a row within ``days`` of the last one kept of its key is dropped.

    Whether a row stays depends on the row kept before it, which no window function can say: the rows of a partition
    are sorted by key and time and swept once, holding one date per key, so a hot key needs no memory. Rows without a
    date come first and count as near to one another. Null keys are keys.
    """
    columns = df.columns
    ordered = df.withColumn("__at", F.unix_micros(F.col(at).cast("timestamp")))
    ordered = ordered.repartition(*keys).sortWithinPartitions(*keys, F.col("__at").asc_nulls_first(), tie)
    reach = days * 86_400_000_000

    def sweep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key = kept = undated = None
        for batch in batches:
            values = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            times = batch.column(batch.schema.get_field_index("__at")).to_pylist()
            stay = []
            for i, (k, t) in enumerate(zip(zip(*values), times)):
                if k != key:
                    key, kept, undated = k, None, False
                if t is None:
                    if undated:
                        continue
                    undated = True
                elif kept is not None and t - kept <= reach:
                    continue
                else:
                    kept = t
                stay.append(i)
            yield batch.take(pa.array(stay, pa.int64())).select(columns)

    return ordered.mapInArrow(sweep, df.schema)


def near_counts(df: DataFrame, keys: list[str], at: str, days: int = 60) -> DataFrame:
    """(keys, pairs): how many pairs of rows of one key lie within ``days``; no pair is made.

    Rows are counted by day before the shuffle; a day's pairs are those within it and those with the days before it that are
    in reach. Rows without a date pair with none.
    """
    daily = df.filter(F.col(at).isNotNull()).groupBy(*keys, F.datediff(F.col(at), F.lit("1970-01-01").cast("date")).alias("day")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("day").rangeBetween(-days, -1)
    pairs = F.col("n") * F.coalesce(F.sum("n").over(before), F.lit(0)) + F.col("n") * (F.col("n") - 1) / 2
    return daily.select(*keys, pairs.cast("bigint").alias("pairs")).groupBy(*keys).agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")


def reconciled(jobs: DataFrame, ended: DataFrame, started: DataFrame) -> DataFrame:
    """Employment after ENDED events close open rows and STARTED events open rows that aren't open then.

    jobs: person_id, organization_id, started_at, ended_at, current; ended and started: person_id, organization_id, at.
    """
    closing = ended.groupBy("person_id", "organization_id").agg(F.min("at").alias("__at"))
    kept = jobs.join(closing, ["person_id", "organization_id"], "left")
    closes = F.col("current") & F.col("__at").isNotNull()
    kept = kept.withColumn("ended_at", F.when(closes, F.coalesce("ended_at", "__at")).otherwise(F.col("ended_at"))).withColumn("current", F.col("current") & ~closes).drop("__at")
    opening = started.groupBy("person_id", "organization_id").agg(F.min("at").alias("started_at"))
    new = opening.join(kept.filter("current"), ["person_id", "organization_id"], "left_anti")
    new = new.select("person_id", "organization_id", "started_at", F.lit(None).cast(jobs.schema["ended_at"].dataType).alias("ended_at"), F.lit(True).alias("current"))
    return kept.select("person_id", "organization_id", "started_at", "ended_at", "current").unionByName(new)

"""What changed between consecutive full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_text(c: Column) -> Column:
    """Lower case, runs of white space as one blank, no outer blanks; null and blank are the same: ''."""
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(c, r"[\s\x{00a0}]+", " "), "^ | $", "")), F.lit(""))


def next_snapshot(df: DataFrame, snapshot: str) -> DataFrame:
    """(snapshot, __next): each snapshot that exists and the following one, null for the last."""
    days = df.select(snapshot).filter(F.col(snapshot).isNotNull()).distinct()
    return days.withColumn("__next", F.lead(snapshot).over(Window.orderBy(snapshot)))


def changes(df: DataFrame, snapshot: str, key: str, compared: list[str]) -> DataFrame:
    """(snapshot, key, change) for each key added, removed or changed against the snapshot before.

    ``df`` holds one row of a key per snapshot; rows that are equal in all compared columns may repeat on either side
    and cancel one another one by one. Every row counts +1 in its own snapshot and -1 in the next one; the sum per
    identical row is EXCEPT ALL in both directions at once, and what is left of a key on the two sides labels it, as a
    full join of the residues by key would. Both aggregations combine before they shuffle. Rows with a null snapshot
    or key are left out. The first snapshot has no changes. Compared nulls equal one another.
    The list of snapshots is as long as the calendar, not as the data; it is joined by the optimizer's choice.
    """
    rows = df.select(snapshot, key, *compared).filter(F.col(snapshot).isNotNull() & F.col(key).isNotNull())
    dated = rows.join(next_snapshot(rows, snapshot), snapshot)
    first = rows.agg(F.min(snapshot).alias("__first"))
    sides = F.explode(
        F.array(
            F.struct(F.col(snapshot).alias("day"), F.lit(1).alias("sign")),
            F.struct(F.col("__next").alias("day"), F.lit(-1).alias("sign")),
        )
    )
    signed = dated.select(key, *compared, sides.alias("__side")).select(F.col("__side.day").alias("__day"), F.col("__side.sign").alias("__sign"), key, *compared)
    signed = signed.filter("__day is not null")
    residue = signed.groupBy("__day", key, *compared).agg(F.sum("__sign").alias("__left")).filter("__left <> 0")
    sides_left = residue.groupBy("__day", key).agg(F.max(F.col("__left") > 0).alias("__now"), F.max(F.col("__left") < 0).alias("__before"))
    change = F.when(F.col("__now") & F.col("__before"), "changed").when(F.col("__now"), "added").otherwise("removed")
    return sides_left.join(F.broadcast(first), F.col("__day") > F.col("__first")).select(F.col("__day").alias(snapshot), key, change.alias("change"))

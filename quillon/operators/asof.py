"""Attributes as known at event time, with validity, corrections and late knowledge.

Events and attribute versions are laid out as one timeline per entity, sorted by time with versions before events at
equal times, and swept once: a version enters when it is both begun and known, leaves when it ends, and every event
takes the best version in force.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: An entity with more rows than this, or than this share of all rows, is split along time.
HOT_ROWS, HOT_SHARE = 200_000, 1_000
#: Time slices of a split entity, at least and at most; between, one for each HOT_ROWS rows that there are.
SLICES, MOST_SLICES = 32, 1_024

VERSIONS, EVENTS = 0, 1
_OPEN = (1 << 63) - 1


def _sweep(batches: Iterator) -> Iterator:
    """Rows sorted by (entity, slice, at, kind): emit (event_id, attribute, version_id) of each event."""
    import pandas as pd

    entity = slice_ = None
    force: dict[str, list] = {}
    for batch in batches:
        out: list[tuple] = []
        for e, s, at, kind, attribute, rid, start, known, until in zip(*(batch[c].tolist() for c in ("entity", "slice", "at", "kind", "attribute", "row_id", "start", "known", "until"))):
            if e != entity or s != slice_:
                entity, slice_, force = e, s, {}
            if kind == VERSIONS:
                heapq.heappush(force.setdefault(attribute, []), (-start, -known, rid, until))
                continue
            for name, heap in force.items():
                while heap and heap[0][3] <= at:
                    heapq.heappop(heap)
                if heap:
                    out.append((rid, name, heap[0][2]))
        yield pd.DataFrame(out, columns=["event_id", "attribute", "version_id"])


def as_known(events: DataFrame, versions: DataFrame, hot_rows: int = HOT_ROWS, slices: int = SLICES) -> DataFrame:
    """(event_id, attribute, version_id): the version of each attribute in force and known at each event.

    events: entity, event_id (unique), at (timestamp). versions: entity, attribute, version_id, start, known, until
    (timestamps). In force means start <= at, known <= at and until null or > at; of several the latest start wins,
    then the latest known, then the least version_id. Events with a null entity or time and versions with a null
    entity, attribute, start or known match nothing; events without a version give no row; repeated versions give one.
    One shuffle by entity. A hot entity, counted first, is cut into time slices: a version goes to each slice that it
    touches, and of those in force throughout a slice only the best is sent, chosen by a combined maximum.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = events.select("entity", F.col("event_id").cast("string").alias("row_id"), micros("at").alias("at")).filter("entity is not null and at is not null and row_id is not null")
    v = versions.select("entity", "attribute", F.col("version_id").cast("string").alias("row_id"), micros("start").alias("start"), micros("known").alias("known"), F.coalesce(micros("until"), F.lit(_OPEN)).alias("until"))
    v = v.filter("entity is not null and attribute is not null and row_id is not null and start is not null and known is not null")
    v = v.withColumn("at", F.greatest("start", "known")).filter("until > at")

    # Entities hot in events, in versions or in both: all their rows count.
    both = e.select("entity", "at").unionByName(v.select("entity", "at"))
    counts = both.groupBy("entity").count()
    total = both.count()
    slices = max(slices, min(MOST_SLICES, total // max(1, hot_rows)))
    # At most HOT_SHARE entities can each hold more than 1/HOT_SHARE of the rows: that bounds the broadcast.
    hot = counts.filter(F.col("count") > max(hot_rows, total // HOT_SHARE)).select("entity")
    points = F.percentile_approx("at", F.array(*(F.lit(i / slices) for i in range(1, slices))), F.lit(1000))
    cuts = both.join(F.broadcast(hot), "entity").groupBy("entity").agg(points.alias("cuts"))
    cuts = F.broadcast(cuts)

    slice_of = lambda c: F.coalesce(F.expr(f"size(filter(cuts, x -> x <= {c}))"), F.lit(0))
    e = e.join(cuts, "entity", "left").select("entity", slice_of("at").alias("slice"), "at", F.lit(EVENTS).alias("kind"), F.lit(None).cast("string").alias("attribute"), "row_id", *(F.lit(0).cast("bigint").alias(c) for c in ("start", "known", "until")))
    v = v.join(cuts, "entity", "left").withColumn("first", slice_of("at")).withColumn("last", slice_of("until"))
    columns = ["entity", "slice", "at", "kind", "attribute", "row_id", "start", "known", "until"]
    kinds = F.lit(VERSIONS).alias("kind")
    edges = v.withColumn("slice", F.explode(F.array_distinct(F.array("first", "last")))).select("entity", "slice", "at", kinds, "attribute", "row_id", "start", "known", "until")
    inner = v.filter(F.col("last") > F.col("first") + 1).withColumn("slice", F.explode(F.sequence(F.col("first") + 1, F.col("last") - 1)))
    best = F.min_by(F.struct("at", "row_id", "start", "known", "until"), F.struct(-F.col("start"), -F.col("known"), F.col("row_id"))).alias("b")
    inner = inner.groupBy("entity", "slice", "attribute").agg(best).select("entity", "slice", "b.at", kinds, "attribute", "b.row_id", "b.start", "b.known", "b.until")
    line = e.select(*columns).unionByName(edges.select(*columns)).unionByName(inner.select(*columns))
    line = line.repartition("entity", "slice").sortWithinPartitions("entity", "slice", "at", "kind", "row_id")
    return line.mapInPandas(_sweep, "event_id string, attribute string, version_id string")


def carry_forward(events: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Each event with the last values of ``columns`` that became available at or before it.

    events: entity, event_id, at; changes: entity, available_at and ``columns``. The plain form for attributes without
    end or correction: union, sort by time with changes first at ties, last non-null value carried forward.
    """
    a = events.select("entity", "event_id", "at", F.lit(1).alias("__kind"), *(F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in columns))
    b = changes.select("entity", F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.col("available_at").alias("at"), F.lit(0).alias("__kind"), *columns)
    w = Window.partitionBy("entity").orderBy("at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = a.unionByName(b).select("entity", "event_id", "at", "__kind", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns))
    return carried.filter("__kind = 1").drop("__kind")

"""Structured Streaming forms of the batch operators: deduplicated intake, windowed counts and stateful collapse."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.sources.writers import exists


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str = "60 days") -> DataFrame:
    """One row per key among rows at most ``delay`` late; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, at: str, width: str, by: list[str], slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows per tumbling or sliding window and ``by``."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, delay).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, at: str, gap: str, by: list[str], delay: str = "1 day") -> DataFrame:
    """Sessions of rows at most ``gap`` apart."""
    grouped = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def collapsed(stream: DataFrame, key: str, at: str, days: int = 60, delay: str = "60 days") -> DataFrame:
    """(key, at) of rows more than ``days`` from every row kept of their key; the kept times are the state.

    Rows of one trigger are sorted by time first. A row may come ``delay`` late and is then kept if no kept row is within
    reach on either side; times that no row can reach any more leave the state, and a key without others leaves it whole.
    """
    reach = days * 86_400_000_000
    kind = stream.schema[key].dataType.simpleString()

    def update(group: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(t for f in frames for t in f["at_us"].tolist()):
            if all(abs(t - k) > reach for k in kept):
                kept.append(t)
                out.append(t)
        mark = state.getCurrentWatermarkMs()
        kept = [k for k in kept if k + reach >= mark * 1000] or kept[-1:]
        if kept:
            state.update((kept,))
            state.setTimeoutTimestamp(max(max(kept) + reach, mark * 1000) // 1000 + 1)
        yield pd.DataFrame({key: [group[0]] * len(out), "at_us": out})

    seen = stream.filter(F.col(at).isNotNull()).withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", delay)
    narrow = seen.select(key, "__at", F.unix_micros("__at").alias("at_us"))
    out = narrow.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, at_us bigint", "kept array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("at_us").alias(at))


def append_new(stream: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Start a query that appends rows whose keys the table at ``path`` doesn't hold: a replayed batch adds nothing.

    A table that is there but can't be read stops the query.
    """

    def batch(df: DataFrame, _: int) -> None:
        fresh = df.dropDuplicates(keys)
        if exists(df.sparkSession, path):
            fresh = fresh.join(df.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

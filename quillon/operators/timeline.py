"""What may be seen at a moment. ``as_of`` bounds the world's time, ``cutoff`` the time of knowledge; both are columns
or literals passed by the caller, never ambient state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import days_between, lookup


def _always(c: Column | None) -> Column:
    return F.lit(True) if c is None else c


def fact_visible(as_of: Column, cutoff: Column | None = None, begun: str = "valid_from", recorded: str = "created_at") -> Column:
    """A fact begun by ``as_of`` (no beginning: always); with a cutoff the record's time stands in and must be by it."""
    if cutoff is None:
        return F.col(begun).isNull() | (F.col(begun) <= as_of)
    return (F.coalesce(F.col(begun), F.col(recorded)) <= as_of) & (F.col(recorded) <= cutoff)


def event_visible(as_of: Column, cutoff: Column | None = None, at: str = "occurred_at", detected: str = "detected_at") -> Column:
    """An event that occurred by ``as_of``, or was detected by it where it has no date."""
    seen = F.when(F.col(at).isNotNull(), F.col(at) <= as_of).otherwise(F.col(detected) <= as_of)
    return F.coalesce(seen, F.lit(False)) & _always(None if cutoff is None else F.col(detected) <= cutoff)


def inference_visible(as_of: Column, cutoff: Column | None = None, expires: str = "expires_at", recorded: str = "created_at") -> Column:
    """An inference that has not expired."""
    return (F.col(expires).isNull() | (F.col(expires) >= as_of)) & _always(None if cutoff is None else F.col(recorded) <= cutoff)


def edge_visible(as_of: Column, cutoff: Column | None = None, seen: str = "first_seen_at", recorded: str = "created_at") -> Column:
    """A relation seen by ``as_of``; one without a first sight counts from its record."""
    return (F.coalesce(F.col(seen), F.col(recorded)) <= as_of) & _always(None if cutoff is None else F.col(recorded) <= cutoff)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``; the rank filter becomes a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "prev_") -> DataFrame:
    """Each row with the values of the row before it of its key; ``order`` should be unique within a key."""
    w = Window.partitionBy(*keys).orderBy(*(F.col(o).asc_nulls_first() for o in order))
    return df.select("*", *(F.lag(c).over(w).alias(f"{prefix}{c}") for c in columns))


def weekly_steps(spark, start: str, end: str, days: int = 7) -> DataFrame:
    """(step): moments from start to end inclusive, ``days`` apart."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', interval {days} days)")).alias("step"))


#: Days after which a value of a bucket is stale: fixed values.
STALE_DAYS = {"current_employment": 60, "network_relationship": 365, "company_stage": 120, "headline": 45, "education": 10_000, "default": 180}
#: Bucket of each fact type, others fall under default: fixed values.
FRESHNESS_BUCKET = {
    "CURRENT_TITLE": "current_employment",
    "EMPLOYMENT_ENDED_AT": "current_employment",
    "HEADLINE_TEXT": "headline",
    "HEADLINE_CHANGED": "headline",
    "EDUCATION_INSTITUTION": "education",
    "INVESTMENT_MANDATE": "company_stage",
    "VENTURE_ALLOCATION_EVIDENCE": "company_stage",
}


def stale_days(fact_type: Column) -> Column:
    """Days after which a fact of this type is stale."""
    return lookup(fact_type, {k: float(STALE_DAYS[b]) for k, b in FRESHNESS_BUCKET.items()}, float(STALE_DAYS["default"]))


def staleness(verified: Column, as_of: Column, limit: Column) -> tuple[Column, Column]:
    """(age in days, stale): an age that is unknown is not stale."""
    age = days_between(verified, as_of)
    return age, F.coalesce(age > limit, F.lit(False))

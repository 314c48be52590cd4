"""The tables that features are built from, out of the stored tables and all that observations yield, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import dedupe, events, extraction, resolve, taxonomy, timeline
from quillon.operators.bundles import World
from quillon.plans import models
from quillon.session import cut, table

#: States of monitoring in which people are scored: fixed values.
SCORED = ("ACTIVE_MONITORING", "PASSIVE_MONITORING", "DISCOVERED", "REVIEW")
#: Functions and seniorities that the open roles of the test tables ask for in turn: parameters.
ROLE_FUNCTIONS, ROLE_SENIORITIES = ("engineering", "research", "investing", "finance", "product"), ("senior_ic", "manager", "director", "vp", "c_level")


def visible(spark: SparkSession, d: str, as_of: Column) -> DataFrame:
    """Observations seen by ``as_of``, repeated deliveries gone."""
    o = table(spark, d, "observation").filter(F.col("observed_at") <= as_of)
    return dedupe.keep_first(o, [F.col("source_id"), dedupe.identifier("provider_record_id")], ["observed_at", "ingested_at", "observation_id"])


def found(spark: SparkSession, d: str, observations: DataFrame, live: DataFrame) -> DataFrame:
    """All that the observations of known people yield: person_id, kind, name, value and so on, at (its moment), tier and provider."""
    keep = ["observation_id", "person_id", "source_id", "occurred_at", "observed_at", "ingested_at"]
    x = extraction.extracted(observations.filter("person_id is not null"), keep)
    sources = table(spark, d, "data_source").groupBy("source_id").agg(F.min("reliability_tier").alias("tier"), F.min("provider").alias("provider"))
    x = x.join(live, "person_id").withColumn("person_id", F.col("live_id")).drop("live_id").join(sources, "source_id", "left")
    return x.withColumn("at", F.coalesce("occurred", "occurred_at", "observed_at")).withColumn("tier", F.coalesce("tier", F.lit(3)))


def facts_of(spark: SparkSession, d: str, x: DataFrame, live: DataFrame) -> DataFrame:
    """Stored facts that nothing supersedes, and those of observations with their evidence."""
    stored = table(spark, d, "fact").filter("superseded_by_id is null and subject_type = 'person'").withColumn("person_id", F.col("subject_id")).join(live, "person_id")
    stored = stored.select(
        F.col("live_id").alias("person_id"), "fact_id", "fact_type", F.struct("value.status", "value.value", "value.unit").alias("value"), "valid_from", "created_at", "extraction_confidence",
        F.lit(None).cast("double").alias("strength"), F.lit(None).cast("string").alias("provider"),
    )
    made = x.filter("kind = 'fact'").select(
        "person_id", F.concat_ws(":", F.lit("ob"), "observation_id", "name").alias("fact_id"), F.col("name").alias("fact_type"),
        F.struct(F.when(F.col("value").isNull(), "unknown").otherwise("known").alias("status"), "value", "unit").alias("value"), F.coalesce("occurred", "observed_at").alias("valid_from"), F.col("ingested_at").alias("created_at"),
        F.col("confidence").alias("extraction_confidence"), F.round(extraction.numbers.tier_weight(F.col("tier")), 3).alias("strength"), "provider",
    )
    return stored.unionByName(made)


def events_of(x: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """(person_id, event_type, organization, occurred_at, detected_at, confidence, observation_id, dedupe_key): events that count.

    One per person, type and day, and of seven types one per person, type and organisation within 60 days; keys of
    ``earlier`` events count too. An ended employment at a named organisation is a professional departure as well.
    """
    e = x.filter("kind = 'event'").select("observation_id", "person_id", F.col("name").alias("event_type"), F.trim("organization").alias("organization"), F.col("at").alias("occurred_at"), F.col("ingested_at").alias("detected_at"), extraction.event_confidence(F.col("confidence"), F.col("tier")).alias("confidence"))
    e = e.withColumn("organization", F.coalesce("organization", F.lit("")))
    first = events.new_events(e, earlier if earlier is not None else e.limit(0).select(F.lit("").alias("dedupe_key")), ["occurred_at", "observation_id", "organization"])
    windowed = F.coalesce(F.col("event_type").isin(*taxonomy.WINDOWED_TYPES), F.lit(False))
    near = events.collapsed(first.filter(windowed), ["person_id", "event_type", "organization"], "occurred_at", "observation_id", 60)
    kept = near.unionByName(first.filter(~windowed))
    left = kept.filter("event_type = 'EMPLOYMENT_ENDED' and organization <> ''").withColumn("event_type", F.lit("PROFESSIONAL_DEPARTURE"))
    return kept.unionByName(left)


def inferences_of(x: DataFrame) -> DataFrame:
    i = x.filter("kind = 'inference'").select("person_id", F.col("name").alias("inference_type"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))), 4).alias("probability"), F.col("at").alias("created_at"))
    return i.withColumn("expires_at", taxonomy.expiry(F.col("inference_type"), F.col("created_at")))


def colleagues(jobs: DataFrame, verified: DataFrame) -> DataFrame:
    """Relations (src, dst, strength, confidence, first_seen_at, created_at, verified) of each person with the longest-serving
    colleague of each employer: as many as there are jobs, however many people one employer has.

    Strong in the same function, moderate between current colleagues, weak otherwise, unknown where a function is.
    """
    j = jobs.filter("person_id is not null and organization_id is not null").select("person_id", "organization_id", "function", "started_at", "ended_at", F.coalesce("current", F.lit(False)).alias("current")).distinct()
    first = F.struct(F.col("started_at").isNull(), "started_at", "person_id", F.col("function").isNull(), "function", "current")
    senior = j.groupBy("organization_id").agg(F.min_by(F.struct("person_id", "function", "started_at", "current"), first).alias("s"))
    pairs = j.join(senior, "organization_id").filter("person_id <> s.person_id")
    seen = F.greatest("started_at", "s.started_at").cast("timestamp_ntz")
    both = F.col("current") & F.col("s.current")
    strength = F.when(F.col("function").isNull() | F.col("s.function").isNull(), 0).when(F.col("function") == F.col("s.function"), 3).when(both, 2).otherwise(1)
    confidence = F.when(both, 0.85).when(F.col("started_at").isNotNull(), 0.6)
    out = pairs.select(F.col("person_id").alias("src"), F.col("s.person_id").alias("dst"), strength.alias("strength"), confidence.alias("confidence"), seen.alias("first_seen_at"), F.lit("2025-09-01").cast("timestamp_ntz").alias("created_at"))
    return out.join(verified.withColumnRenamed("person_id", "src"), "src", "left")


def classes_of(x: DataFrame, e: DataFrame, jobs: DataFrame, organization: DataFrame) -> DataFrame:
    """(person_id, person_class): by current job, and by what events and inferences show; each class once."""
    o = organization.select("organization_id", "organization_type", F.coalesce("is_portfolio", F.lit(False)).alias("held"))
    j = jobs.filter("current").join(o, "organization_id")
    job = F.array_compact(F.array(
        F.when(F.lower("title").contains("founder"), "FOUNDER"), F.when(F.col("organization_type").isin("family_office", "endowment", "venture_fund") & F.col("seniority").isin("partner", "c_level"), "LP"),
        F.when(F.col("held") & F.col("seniority").isin("c_level", "vp"), "PORTFOLIO_EXECUTIVE"),
    ))
    shown = extraction.numbers.lookup(F.col("t"), taxonomy.CLASS_OF)
    seen = e.select("person_id", F.col("event_type").alias("t")).union(x.filter("kind = 'inference'").select("person_id", "name"))
    return j.select("person_id", F.explode(job).alias("person_class")).union(seen.select("person_id", shown.alias("person_class")).filter("person_class is not null")).distinct()


def roles_of(organization: DataFrame) -> DataFrame:
    """An open role at each portfolio company, its function and seniority in turn."""
    n = F.substring("organization_id", 4, 10).try_cast("int")
    pick = lambda words, k: F.element_at(F.array(*(F.lit(w) for w in words)), F.pmod(F.floor(n / k), F.lit(len(words))).cast("int") + 1)
    place = F.split(F.coalesce("location", F.lit("")), ", ")
    return organization.filter("is_portfolio").select(
        F.col("organization_id").alias("role_id"), pick(ROLE_FUNCTIONS, 1).alias("function"), pick(ROLE_SENIORITIES, 2).alias("seniority"),
        F.coalesce("attributes.sectors", F.array().cast("array<string>")).alias("domains"), F.array_compact(F.array("attributes.stage")).alias("stages"),
        F.get(place, 0).alias("metro"), F.coalesce(F.get(place, 1), F.lit("")).alias("country"), (F.pmod(n, F.lit(7)) == 0).alias("remote_ok"),
    )


def people_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "person").filter("merged_into_id is null").select("person_id", "canonical_name", "entity_resolution_status", "monitoring_status", F.coalesce("is_team_seed", F.lit(False)).alias("is_team_seed"))


def build(spark: SparkSession, d: str, as_of: Column, cutoff: Column | None = None, x: DataFrame | None = None, live: DataFrame | None = None, visible_events: DataFrame | None = None) -> World:
    """The world as of a moment; with a cutoff nothing recorded after it counts either.

    x, live and visible_events may be given where a caller made them before.
    """
    live = cut(resolve.live_ids(table(spark, d, "person"))) if live is None else live
    x = cut(found(spark, d, visible(spark, d, as_of), live)) if x is None else x
    organization = table(spark, d, "organization")
    facts = facts_of(spark, d, x, live).filter(timeline.fact_visible(as_of, cutoff))
    e = (events_of(x) if visible_events is None else visible_events).filter(timeline.event_visible(as_of, cutoff))
    inferences = inferences_of(x).filter(timeline.inference_visible(as_of, cutoff))
    jobs = table(spark, d, "employment").join(live, "person_id").withColumn("person_id", F.col("live_id")).drop("live_id")
    checked = table(spark, d, "fact").filter(F.col("verified_at") <= as_of).withColumn("person_id", F.col("subject_id")).join(live, "person_id").groupBy(F.col("live_id").alias("person_id")).agg(F.max("verified_at").alias("verified"))
    notes = table(spark, d, "observation").filter((F.col("content_type") == "manual_note") & (F.col("observed_at") <= as_of)).join(live, "person_id")
    feedback = notes.select(F.col("live_id").alias("connector_person_id"), F.when(F.lower("raw_text").contains("told"), "MEETING_BOOKED").otherwise("NOTE").alias("feedback_type"))
    return World(
        people_of(spark, d), facts, jobs, organization, e, inferences, colleagues(jobs, checked).filter(timeline.edge_visible(as_of, cutoff)), classes_of(x, e, jobs, organization), feedback, roles_of(organization), models.THESIS,
    )

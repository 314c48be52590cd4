"""Queries of the four models over the test tables: features, scores, access, confidence and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import bundles, config, metrics, modelrun, resolve, taxonomy
from quillon.plans import model_sql, models, world
from quillon.plans.registry import Book
from quillon.session import cut, table

BOOK = Book()
query = BOOK.query
AS_OF = "2026-09-06 23:59:59"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def scored_people(w: bundles.World) -> DataFrame:
    return w.person.filter(F.col("monitoring_status").isin(*world.SCORED))


def run(w: bundles.World, target: str, at, access: DataFrame | None = None, frame: DataFrame | None = None) -> DataFrame:
    """Scores of a target with rank, percentile, action and reasons."""
    model = config.parse(models.MODELS[target])
    people = scored_people(w)
    frame = cut(bundles.frame(w, people, at)) if frame is None else frame
    access = modelrun.access_of(w, models.ACCESS, at) if access is None else access
    if target == "talent":
        scores = modelrun.talent_scored(frame, w, model, access, at)
    else:
        scores = modelrun.scored(frame, w, model, access, at, modelrun.held_sectors(w.organization))
    match = F.col("priority") >= models.ROLE_MATCH if target == "talent" else F.lit(False)
    context = modelrun.ranked(cut(scores.drop("normal")), target).join(people.select("person_id", "monitoring_status"), "person_id")
    context = context.withColumns({"has_role_match": match, "has_warm_path": F.coalesce(F.col("access") > 0, F.lit(False)), "is_newly_discovered": F.col("monitoring_status") == "DISCOVERED", "data_stale": F.lit(False)})
    return modelrun.decided(context, models.ACTIONS)


def _scores(spark: SparkSession, d: str, target: str, *more: str) -> DataFrame:
    model = config.parse(models.MODELS[target])
    out = run(world.build(spark, d, as_of()), target, as_of())
    dims = [F.round(f"dim_{n}", 4).alias(n) for n in model.dimensions]
    return out.select("person_id", *more, *dims, "priority", "confidence", "rank", "percentile", "action")


@query(model_sql.founder_sql(AS_OF))
def founder_scores(spark: SparkSession, d: str) -> DataFrame:
    """FEA-01, FEA-02, FEA-03, FEA-18, FEA-20, THS-01, THS-02, THS-03, THS-04, SCO-01..06, GRF-01..07, ACT-01, ACT-02, JN-14, RNK-01:
    the founder model from facts, jobs, observations and relations to action."""
    return _scores(spark, d, "founder")


@query(model_sql.lp_sql(AS_OF))
def lp_scores(spark: SparkSession, d: str) -> DataFrame:
    """FEA-04, FEA-05, FEA-06, FEA-07: the allocator model."""
    return _scores(spark, d, "lp")


@query(model_sql.talent_sql(AS_OF))
def talent_scores(spark: SparkSession, d: str) -> DataFrame:
    """FEA-08..15, JN-13, AGG-15: the talent model, each person's best open role."""
    return _scores(spark, d, "talent", "role_id")


@query(model_sql.connector_sql(AS_OF))
def connector_scores(spark: SparkSession, d: str) -> DataFrame:
    """FEA-16, AGG-04..08, JN-08: the connector model."""
    return _scores(spark, d, "connector")


def _yielded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    live = cut(resolve.live_ids(table(spark, d, "person")))
    return world.found(spark, d, world.visible(spark, d, as_of()), live), live


@query(model_sql.rows_sql(AS_OF, "select fact_id, person_id, fact_type, status, try_cast(trim(value) as double) as number, case when try_cast(trim(value) as double) is null then value end as text, valid_from, strength, provider from facts where provider is not null and exists (select 1 from people where people.person_id = facts.person_id)"))
def fact_evidence(spark: SparkSession, d: str) -> DataFrame:
    """EXT-01, EXT-02, EXT-03, EVT-05, SNK-02, JSN-05, JSN-07, JN-04, JN-17, MTH-03: facts that observations yield, each with its
    evidence's strength and provider, of the people that are scored."""
    x, live = _yielded(spark, d)
    facts = world.facts_of(spark, d, x, live).filter("provider is not null")
    people = world.people_of(spark, d).filter(F.col("monitoring_status").isin(*world.SCORED))
    number = F.trim("value.value").try_cast("double")
    out = facts.join(people, "person_id", "left_semi")
    return out.select("fact_id", "person_id", "fact_type", "value.status", number.alias("number"), F.when(number.isNull(), F.col("value.value")).alias("text"), "valid_from", "strength", "provider")


@query(model_sql.rows_sql(AS_OF, f"select person_id, event_type, organization, occurred_at, confidence, {model_sql.severity_sql('event_type')} as severity, {model_sql.expiry_sql('event_type', 'occurred_at')} as expires_at from ev where confidence >= 0.5"))
def event_rows(spark: SparkSession, d: str) -> DataFrame:
    """EVT-01..06, EVT-08, DT-04, HSH-01, FLT-05, FLT-09, MTH-02: events that count, repeated reports folded, departures derived."""
    x, _ = _yielded(spark, d)
    e = world.events_of(cut(x)).filter((F.col("occurred_at") <= as_of()) & (F.col("confidence") >= 0.5))
    kind = F.col("event_type")
    return e.select("person_id", "event_type", "organization", "occurred_at", "confidence", taxonomy.severity(kind).alias("severity"), taxonomy.expiry(kind, F.col("occurred_at")).alias("expires_at"))


@query(model_sql.rows_sql(AS_OF, "select person_id, event_type as inference_type, probability, days, 'inference' as label from signals where probability is not null order by days, person_id, inference_type, probability limit 200"))
def inference_list(spark: SparkSession, d: str) -> DataFrame:
    """FLT-10, RPT-08, SNK-03, EVT-01: live inferences, labelled, newest first, a page of two hundred."""
    x, _ = _yielded(spark, d)
    live = world.inferences_of(x).filter(world.timeline.inference_visible(as_of()))
    days = bundles.numbers.days_between(F.col("created_at"), as_of())
    return live.select("person_id", "inference_type", "probability", days.alias("days"), F.lit("inference").alias("label")).orderBy("days", "person_id", "inference_type", "probability").limit(200)


STEPS = ("2026-08-23 23:59:59", "2026-08-30 23:59:59")


@query(model_sql.backtest_sql(STEPS))
def backtest_scores(spark: SparkSession, d: str) -> DataFrame:
    """BKT-01, FLT-08, FLT-11, AGG-18: the founder model at weekly steps with nothing that was recorded later."""
    out = None
    for step in STEPS:
        at = F.lit(step).cast("timestamp_ntz")
        scores = cut(run(world.build(spark, d, at, at), "founder", at).select("person_id", "priority", "rank"))
        first = scores.agg(F.max(F.when(F.col("rank") == 1, F.col("person_id"))).alias("first"))
        spread = metrics.distribution(scores.withColumn("step", F.lit(step[:10])), ["step"], "priority").join(F.broadcast(first))
        out = spread if out is None else out.unionByName(spread)
    return out.select("step", "n", *(F.round(c, 2).alias(c) for c in ("mean", "median", "p90", "max")), "first")


@query()
def discovery_candidates(spark: SparkSession, d: str) -> DataFrame:
    """DSC-01..06: candidates that the discovery stream stages, one per rule and person."""
    from quillon.plans import pipeline

    x, live = _yielded(spark, d)
    return pipeline.discovered(world.visible(spark, d, as_of()), cut(x), live, table(spark, d, "person"))


@query("select 'founder_v0.1' as full_version, 'fit' as dimension, 0.25::double as weight, 0.225::double as stored")
def model_compare(spark: SparkSession, d: str) -> DataFrame:
    """JN-19, SET-06, RPT-05: a configuration joined with its stored version, the dimensions whose weights differ."""
    model = config.parse(models.FOUNDER)
    stored = {n: round(x.weight * 0.9, 3) if n == "fit" else x.weight for n, x in model.dimensions.items()}
    schema = "full_version string, dimension string, weight double"
    mine = spark.createDataFrame([(model.full_version, n, x.weight) for n, x in model.dimensions.items()], schema)
    theirs = spark.createDataFrame([(model.full_version, n, w) for n, w in stored.items()], schema).withColumnRenamed("weight", "stored")
    return mine.join(theirs, ["full_version", "dimension"], "left").filter(~F.col("weight").eqNullSafe(F.col("stored")))


@query()
def weekly_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """ORC-01, SNK-10, SNK-12, SNK-14, RNK-02: two weeks of the whole cycle, the second on what the first stored: its scores by
    all four models with changes of score and rank."""
    from quillon.plans import pipeline

    before, _ = pipeline.weekly(spark, d, "2026-08-30")
    last, _ = pipeline.weekly(spark, d, "2026-09-06", before)
    return last["deltas"]


@query()
def weekly_digest(spark: SparkSession, d: str) -> DataFrame:
    """DIG-01..06, SNK-20, RPT-05: the twelve sections of a week."""
    from quillon.plans import pipeline

    return pipeline.weekly(spark, d, "2026-09-06")[0]["digest"]

"""The weekly cycle over observation tables, as a fixed number of plans whatever the number of people.

Each stage writes one table under the run's folder and reads it back, so a failed run is resumed or repeated without
touching what is published, and running a week twice gives the same tables. What earlier weeks stored, events and score
snapshots, is handed in and decides what is new.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import values
from quillon.operators import bundles, modelrun, ranking, resolve, rules, taxonomy, timeline
from quillon.operators.guards import guard_prose
from quillon.plans import model_queries, models, world
from quillon.plans.entity_queries import attachments
from quillon.session import cut, table

TARGETS = ("founder", "lp", "talent", "connector")
#: Classes whose people a target's sections show: fixed values.
RELEVANT = {
    "founder": ("FOUNDER", "POTENTIAL_FOUNDER"),
    "lp": ("LP", "POTENTIAL_LP"),
    "talent": ("TALENT", "OPERATOR", "PORTFOLIO_EXECUTIVE", "ENGINEER"),
    "connector": ("CONNECTOR",),
}
#: Event types of three sections: fixed values.
WARM, DEPARTURES, FORMATIONS = ("WARM_PATH_CREATED", "NEW_TEAM_CONNECTION"), ("EMPLOYMENT_ENDED", "PROFESSIONAL_DEPARTURE"), ("COMPANY_FORMATION_CONFIRMED", "FOUNDER_TITLE_ADDED", "PRODUCT_LAUNCH")
#: Discovery rules of the test tables: parameters.
DISCOVERY = [
    {"name": "capital moves", "target_class": "POTENTIAL_LP", "keywords": ["fund", "allocation", "mandate"], "titles": ["partner", "treasurer"], "excluded_keywords": ["insurance"], "min_signals": 2},
    {"name": "departures", "target_class": "TALENT", "keywords": ["years"], "required_events": ["EMPLOYMENT_ENDED", "OPEN_TO_WORK_SIGNAL"], "min_signals": 2},
    {"name": "builders", "target_class": "POTENTIAL_FOUNDER", "keywords": ["clinic", "robot", "ledger"], "technical_topics": ["imaging", "mapping", "storage"], "titles": ["founder"], "min_signals": 2},
    {"name": "paused", "active": False, "keywords": ["a"]},
]


@dataclass
class Run:
    """Stage statistics of one cycle; a failing stage is recorded and raised."""

    week: str
    stages: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        began = time.time()
        try:
            out = cut(make())
            self.stages.append({"week": self.week, "stage": name, "rows": out.count(), "ms": int(1000 * (time.time() - began)), "error": None})
            return out
        except Exception as e:
            self.stages.append({"week": self.week, "stage": name, "rows": 0, "ms": int(1000 * (time.time() - began)), "error": str(e)[:200]})
            raise

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(s["week"], s["stage"], s["rows"], s["ms"], s["error"]) for s in self.stages], "week string, stage string, rows bigint, ms bigint, error string")


def register_model(stored: dict[str, str], model: dict) -> dict[str, str]:
    """Model hashes by name and version with ``model`` added; changed weights under an old version are refused."""
    key, h = f"{model['name']}@{model['version']}", values.config_hash(model)
    if stored.get(key, h) != h:
        raise ValueError(f"{key} changed without a new version")
    return {**stored, key: h}


def source_health(spark: SparkSession, d: str, as_of: Column) -> DataFrame:
    """(source_id, provider, status, records): an enabled source is successful if it has delivered, partial if it hasn't."""
    seen = table(spark, d, "observation").filter(F.col("observed_at") <= as_of).groupBy("source_id").agg(F.count("*").alias("records"))
    status = F.when(~F.coalesce("enabled", F.lit(False)), "disabled").when(F.col("records") > 0, "successful").otherwise("partial")
    return table(spark, d, "data_source").join(seen, "source_id", "left").select("source_id", "provider", status.alias("status"), F.coalesce("records", F.lit(0)).alias("records"))


def attach(observations: DataFrame, found: DataFrame) -> DataFrame:
    """Observations with the person that their subject's resolution attached, where they had none; only of the monitored stream."""
    to = found.filter("attach = 'person'").select(F.col("subject").alias("__subject"), F.col("person_id").alias("__person"))
    key = F.when(F.col("person_id").isNull() & (F.col("mode") == "update"), F.lower(F.trim("subject_hint")))
    joined = observations.withColumn("__subject", key).join(to, "__subject", "left")
    return joined.withColumn("person_id", F.coalesce("person_id", "__person")).select(*observations.columns)


def discovered(observations: DataFrame, x: DataFrame, live: DataFrame, person: DataFrame) -> DataFrame:
    """(rule, target_class, person_id, subject, is_new, identity_confidence, observation_id, source_id, reasons): one candidate
    per rule and person of the discovery stream.

    The first active rule that an observation matches stages it. A subject already known keeps its person; an unknown one
    becomes a new person under its name, unless several people bear that name.
    """
    o = observations.filter("mode = 'discover' and trim(subject_hint) <> ''")
    v = values.opened(F.col("raw_json"))
    o = o.select("observation_id", "source_id", "person_id", "subject_hint", "observed_at", "raw_text", v.alias("v"))
    get = lambda f: F.nullif(F.try_variant_get("v", f"$.{f}", "string"), F.lit(""))
    o = o.withColumn("text", F.concat_ws(" ", F.nullif("raw_text", F.lit("")), get("title"), get("summary"), get("body"), get("profile.headline")))
    happened = x.filter("kind <> 'fact'").groupBy("observation_id").agg(F.array_sort(F.collect_set("name")).alias("event_types"))
    matched = rules.first_rule(o.join(happened, "observation_id", "left"), "text", "event_types", DISCOVERY).join(live, "person_id", "left")
    name = resolve.normal_name(F.col("subject_hint"))
    bearers = person.filter("merged_into_id is null").groupBy(resolve.normal_name(F.col("canonical_name")).alias("__name")).agg(F.count("*").alias("bearers")).filter("__name <> ''")
    staged = matched.withColumn("__name", name).join(bearers, "__name", "left").withColumn("bearers", F.coalesce("bearers", F.lit(0)))
    staged = staged.filter("live_id is not null or bearers < 2")
    is_new = F.col("live_id").isNull()
    staged = staged.select(
        "rule", "target_class", F.coalesce("live_id", F.concat(F.lit("new:"), F.lower(F.trim("subject_hint")))).alias("person_id"), F.trim("subject_hint").alias("subject"), is_new.alias("is_new"),
        F.when(~is_new, 1.0).when(F.col("bearers") == 1, resolve.NAME).otherwise(0.0).alias("identity_confidence"), "observation_id", "source_id", F.array_join("reasons", "; ").alias("reasons"), "observed_at",
    )
    row = [c for c in staged.columns if c not in ("rule", "person_id", "observed_at")]
    first = staged.groupBy("rule", "person_id").agg(F.min_by(F.struct(*row), F.struct("observed_at", "observation_id")).alias("r"))
    return first.select("rule", "person_id", *(f"r.{c}" for c in row))


def weekly(spark: SparkSession, d: str, week: str, earlier: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], Run]:
    """Tables of the week that ends at ``week`` (YYYY-MM-DD, its last day): sources, observations, attachments, found, events,
    new_events, candidates, access, features, scores, deltas and digest.

    ``earlier`` holds the events and scores stored by the week before; without it everything is new.
    """
    run = Run(week)
    earlier = earlier or {}
    as_of = F.lit(f"{week} 23:59:59").cast("timestamp_ntz")
    person = table(spark, d, "person")
    sources = run.stage("source_health", lambda: source_health(spark, d, as_of))
    kept = run.stage("normalize_and_dedupe", lambda: world.visible(spark, d, as_of))
    attached = run.stage("resolve_subjects", lambda: attachments(spark, d))
    live = cut(resolve.live_ids(person))
    x = run.stage("extract", lambda: world.found(spark, d, attach(kept, attached), live))

    def detect() -> DataFrame:
        e = world.events_of(x)
        return e.select("*", taxonomy.severity(F.col("event_type")).alias("severity"), taxonomy.expiry(F.col("event_type"), F.col("occurred_at")).alias("expires_at"))

    events = run.stage("resolve_extract_detect", detect)
    stored = earlier.get("events")
    key = ["person_id", "event_type", "occurred_at", "organization"]
    fresh = run.stage("new_events", lambda: events if stored is None else events.join(stored.select(*key), key, "left_anti").select(*events.columns))
    candidates = run.stage("discovery_candidates", lambda: discovered(kept, x, live, person))
    w = world.build(spark, d, as_of, x=x, live=live, visible_events=events)
    access = run.stage("access", lambda: modelrun.access_of(w, models.ACCESS, as_of))
    frame = run.stage("features", lambda: bundles.frame(w, model_queries.scored_people(w), as_of))
    columns = ["person_id", "target", "priority", "confidence", "quality", "fit", "timing", "access", "rank", "percentile", "action", "reason_codes"]

    def score() -> DataFrame:
        out = None
        for target in TARGETS:
            one = model_queries.run(w, target, as_of, access=access, frame=frame).select(*columns)
            out = one if out is None else out.unionByName(one)
        return out.select(F.lit(week).alias("week"), *columns)

    scores = run.stage("features_and_scoring", score)
    deltas = run.stage("rank_deltas", lambda: with_changes(scores, earlier.get("scores")))
    review = attached.filter("attach = 'review'")
    made = {"sources": sources, "candidates": candidates, "new_events": fresh, "deltas": deltas, "review": review, "classes": w.classes, "person": w.person}
    digest_ = run.stage("digest", lambda: digest(made))
    run.warnings = [f"ambiguous subjects: {n}" for n in (review.count(),) if n]
    out = {"sources": sources, "observations": kept, "attachments": attached, "found": x, "events": events, "new_events": fresh, "candidates": candidates, "access": access, "features": frame, "scores": scores, "deltas": deltas, "digest": digest_}
    return out, run


def with_changes(now: DataFrame, before: DataFrame | None) -> DataFrame:
    """Scores with rank and score changes against an earlier run; people new to the ranking have null changes."""
    if before is None:
        return now.select("*", F.lit(None).cast("double").alias("score_change"), F.lit(None).cast("bigint").alias("rank_change"))
    old = before.select("person_id", "target", F.col("priority").alias("__score"), F.col("rank").alias("__rank"))
    return now.join(old, ["person_id", "target"], "left").select(*now.columns, F.round(F.col("priority") - F.col("__score"), 4).alias("score_change"), (F.col("__rank") - F.col("rank")).alias("rank_change"))


def digest(t: dict[str, DataFrame]) -> DataFrame:
    """(section, place, person_id, person, detail): the twelve sections of a week, each in its order.

    Scores show only people of a class relevant to the target; the first four movers' sections take changes above 0.05, the
    allocators' and talent's fall back to the highest scores where nobody moved.
    """
    name = t["person"].select("person_id", F.col("canonical_name").alias("person"))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("target"), F.lit(c).alias("person_class")) for k, cs in RELEVANT.items() for c in cs)))
    fits = t["classes"].join(F.broadcast(t["classes"].sparkSession.range(1).select(wanted.alias("w")).select("w.*")), "person_class").select("person_id", "target").distinct()
    shown = t["deltas"].join(fits, ["person_id", "target"], "left_semi").join(name, "person_id")
    line = F.concat_ws("  ", F.format_string("%.1f", "priority"), F.when(F.col("score_change").isNull(), "new").otherwise(F.format_string("%+.1f", "score_change")), F.format_string("conf %.2f", "confidence"), F.col("action"))
    high, up, down = [F.desc("priority"), F.asc("person_id")], [F.desc("score_change"), F.asc("person_id")], [F.asc("score_change"), F.asc("person_id")]

    def section(df: DataFrame, label: str, detail: Column, order: list[Column], most: int | None) -> DataFrame:
        rows = ranking.placed(df.withColumn("__detail", detail), order) if most is None else df.withColumn("__detail", detail).orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
        return rows.select(F.lit(label).alias("section"), F.col("place").cast("bigint").alias("place"), "person_id", "person", F.col("__detail").alias("detail"))

    of = lambda target: shown.filter(F.col("target") == target)
    rise, fall = F.col("score_change") > 0.05, F.col("score_change") < -0.05
    out = [
        section(of("founder").filter("score_change is null"), "top_new_founders", line, high, 10),
        section(of("founder").filter(rise), "largest_founder_score_increases", line, up, 10),
        section(of("founder").filter(fall), "largest_founder_score_decreases", line, down, 10),
    ]
    for target, label in (("lp", "top_lp_changes"), ("talent", "top_talent_changes")):
        moved = of(target).filter(rise)
        out.append(section(moved, label, line, up, 10) if not moved.isEmpty() else section(of(target), label, line, high, 10))
    out.append(section(of("connector"), "top_connectors", line, high, 10))
    e = t["new_events"].filter("severity in ('high', 'medium')").join(name, "person_id")
    day = F.date_format("occurred_at", "yyyy-MM-dd")
    latest = [F.desc("detected_at"), F.asc("person_id"), F.asc("event_type"), F.asc("observation_id")]
    out.append(section(e.filter(F.col("event_type").isin(*WARM)), "new_warm_paths", F.concat_ws("  ", "event_type", day), latest, None))
    left = timeline.latest(e.filter(F.col("event_type").isin(*DEPARTURES)), ["person_id"], [F.asc_nulls_first("occurred_at"), F.asc("event_type"), F.asc("observation_id")])
    out.append(section(left, "important_departures", F.concat_ws("  ", day, F.format_string("conf %.2f", "confidence")), latest, None))
    out.append(section(e.filter(F.col("event_type").isin(*FORMATIONS)), "new_company_formations", F.concat_ws("  ", "event_type", day), latest, None))
    c = t["candidates"].select("person_id", F.col("subject").alias("person"), "rule", "identity_confidence")
    out.append(section(c, "newly_discovered_people", F.concat_ws("  ", "rule", F.format_string("conf %.2f", "identity_confidence")), [F.desc("identity_confidence"), F.asc("person_id"), F.asc("rule")], 15))
    r = t["review"].select(F.lit(None).cast("string").alias("person_id"), F.col("subject").alias("person"))
    out.append(section(r, "data_quality_warnings", F.lit("ambiguous identity, for review"), [F.asc("person")], None))
    s = t["sources"].filter("status in ('failed', 'partial')").select(F.lit(None).cast("string").alias("person_id"), F.col("provider").alias("person"), "status")
    out.append(section(s, "source_failures", F.col("status"), [F.asc("person")], None))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def rendered(digest_: DataFrame) -> Iterator[str]:
    """The digest's lines in order, read partition by partition; prose that praises is refused."""
    section = None
    for r in digest_.orderBy("section", "place", "person_id").toLocalIterator():
        if r.section != section:
            section = r.section
            yield f"## {section}"
        yield guard_prose(f"- {r.person or r.person_id or ''}  {r.detail}")


def render(digest_: DataFrame) -> str:
    """The digest as text."""
    return "\n".join(rendered(digest_))


def as_json(digest_: DataFrame) -> str:
    return json.dumps([r.asDict() for r in digest_.orderBy("section", "place", "person_id").toLocalIterator()], sort_keys=True)


def sampled_edges(sources: DataFrame, targets: DataFrame, existing: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """(src, dst): for each source k pseudo-random targets without replacement, existing pairs and itself left out; fewer only
    where fewer are left.

    Targets stand on a ring in the order of their hashes. A source starts at a hashed place and walks on, past as many places
    as it has pairs already, so no source meets all targets.
    """
    ring = ranking.placed(targets.select("node").distinct(), [F.xxhash64(F.lit(seed), "node").asc(), F.asc("node")])
    n = max(1, ring.count())
    have = existing.select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("have"))
    s = sources.select(F.col("node").alias("src")).distinct().join(have, "src", "left").withColumn("reach", F.least(F.lit(n), F.lit(k + 1) + F.coalesce("have", F.lit(0))))
    picks = s.select("src", F.explode(F.sequence(F.lit(0), (F.col("reach") - 1).cast("int"))).alias("i")).withColumn("place", 1 + F.pmod(F.xxhash64(F.lit(seed), "src") + F.col("i"), F.lit(n)))
    pairs = picks.join(ring, "place").select("src", F.col("node").alias("dst"), "i").filter("src <> dst").join(existing, ["src", "dst"], "left_anti")
    return pairs.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy("i"))).filter(F.col("rn") <= k).select("src", "dst")

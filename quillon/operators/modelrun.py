"""Scores of the four model targets: features, dimensions, access, priority, confidence, rank and action in one plan."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import bundles, graph, ranking, rules, scoring
from quillon.operators.bundles import World
from quillon.operators.config import Model
from quillon.operators.rules import SENIORITY
from quillon.session import spread

#: Roles matched within one row at once; more roles go in further blocks.
ROLE_BLOCK = 500


def held_sectors(organization: DataFrame) -> list[str]:
    """Sectors of the portfolio, in lower case: a short list of words, however many organisations there are."""
    rows = organization.filter("is_portfolio").select(F.explode(bundles._sectors()).alias("s")).distinct().collect()
    return sorted(r[0] for r in rows)


def access_of(world: World, config: dict, as_of: Column) -> DataFrame:
    """(person_id, access, hops, routes, path): access from the team's people over relations seen by ``as_of``."""
    people = world.person.select(F.col("person_id").alias("node"))
    seeds = world.person.filter("is_team_seed").select(F.col("person_id").alias("node"))
    edges = world.edges.select("src", "dst", "strength", "verified", "confidence")
    return graph.access_scores(people, edges, seeds, config, as_of).withColumnRenamed("node", "person_id")


def _timed(df: DataFrame, signals: DataFrame, model: Model) -> DataFrame:
    """``df`` with a column per decaying dimension; 0 where a person has no signal."""
    for name, dim in model.dimensions.items():
        if dim.kind == "decay_signals":
            df = df.join(scoring.signal_dimension(signals, "person_id", dim, f"dim_{name}"), "person_id", "left").withColumn(f"dim_{name}", F.coalesce(f"dim_{name}", F.lit(0.0)))
    return df


def priority(model: Model, score: Callable[[str], Column]) -> Column:
    """Weighted mean of the known dimensions' scores, weights renormalised; 0 if none is known."""
    dims = {n: (score(f"dim_{n}"), d.weight) for n, d in model.dimensions.items()}
    total = scoring._sum(F.coalesce(c * w, F.lit(0.0)) for c, w in dims.values())
    known = scoring._sum(F.when(c.isNotNull(), w).otherwise(0.0) for c, w in dims.values())
    return F.coalesce(scoring.rounded(total / F.nullif(known, F.lit(0.0))), F.lit(0.0))


def _projected(df: DataFrame, model: Model, as_of: Column) -> DataFrame:
    """Priority, confidence with its components, and the four public scores from dimension columns and feeding facts."""
    parts = scoring.evidence_components(F.col("feeding"), as_of)
    identity = F.lit(scoring.IDENTITY_DEFAULT)
    for state, value in scoring.IDENTITY.items():
        identity = F.when(F.col("entity_resolution_status") == state, value).otherwise(identity)
    parts |= {"identity": identity, "completeness": scoring.rounded(F.col("present") / scoring.full_weight(model))}
    confidence = scoring.weighted_confidence({k: F.col(k) for k in parts}, model.confidence)
    dim = lambda *names: next((F.col(f"dim_{n}") for n in names if n in model.dimensions), F.lit(None).cast("double"))
    return df.withColumns(parts).select(
        "*", priority(model, F.col).alias("priority"), confidence.alias("confidence"), dim("quality").alias("quality"), dim("fit").alias("fit"), dim("timing", "availability_timing").alias("timing"), dim("access").alias("access"),
    )


def _access_joined(df: DataFrame, access: DataFrame, model: Model) -> DataFrame:
    for name, dim in model.dimensions.items():
        if dim.kind == "access_model":
            df = df.join(access.select("person_id", F.col("access").alias(f"dim_{name}")), "person_id", "left")
    return df


def features(frame: DataFrame, model: Model, thesis: dict | None, held: list[str]) -> DataFrame:
    """``frame``'s ids with the model's features as columns, the facts that feed them and the names of those missing."""
    bundle = bundles.build(model.target, thesis, held)
    ids = ("person_id", "canonical_name", "entity_resolution_status")
    wide = frame.withColumns(bundle.shared).select(*ids, *(c.alias(n) for n, c in bundle.columns.items()), bundle.feeding.alias("feeding"))
    return wide.select("*", F.array_sort(F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in bundle.columns)))).alias("missing"))


def scored(frame: DataFrame, world: World, model: Model, access: DataFrame, as_of: Column, held: list[str]) -> DataFrame:
    """One row per person: features, their normalised values, dim_ columns, priority, confidence and its components, public
    scores. Each step is a projection over the one before, so no expression is worked out twice."""
    wide = features(frame, model, world.thesis, held)
    wide = wide.select("*", F.struct(*(c.alias(n) for n, c in scoring.normal_columns(model, F.col).items())).alias("normal"))
    normal = lambda n: F.col("normal").getField(n)
    dims = scoring.weighted(model)
    wide = wide.select("*", *(scoring.present_weight(n, d, normal).alias(f"present_{n}") for n, d in dims.items()))
    wide = wide.select("*", *(scoring.weighted_dimension(n, d, normal, F.col(f"present_{n}")).alias(f"dim_{n}") for n, d in dims.items()), scoring._sum(F.col(f"present_{n}") for n in dims).alias("present"))
    wide = wide.drop(*(f"present_{n}" for n in dims))
    return _projected(_access_joined(_timed(wide, bundles.signals(world, as_of), model), access, model), model, as_of)


def talent_scored(frame: DataFrame, world: World, model: Model, access: DataFrame, as_of: Column) -> DataFrame:
    """One row per person: the role that fits best, its dimensions, priority and confidence.

    Open roles are a query set that every person meets within its row, ROLE_BLOCK at a time; only the best of each block
    leaves the row, so no table of people by roles exists. Ties go to the least role_id.
    """
    blocks: list[list] = []
    for r in world.roles.orderBy("role_id").toLocalIterator():
        if not blocks or len(blocks[-1]) == ROLE_BLOCK:
            blocks.append([])
        low = lambda words: [w.lower() for w in words or [] if w is not None]
        blocks[-1].append({
            "role_id": r["role_id"], "function": r["function"], "rank": SENIORITY.get((r["seniority"] or "").lower(), 0), "domains": low(r["domains"]), "stages": low(r["stages"]),
            "adjacent": list(bundles.ADJACENT.get(r["function"], ())), "metro": (r["metro"] or "").lower(), "country": (r["country"] or "").lower(), "remote_ok": bool(r["remote_ok"]),
        })
    base = _access_joined(_timed(frame, bundles.signals(world, as_of), model), access, model)
    kind = "array<struct<role_id:string,function:string,rank:int,domains:array<string>,stages:array<string>,adjacent:array<string>,metro:string,country:string,remote_ok:boolean>>"
    own = bundles.talent_person()
    dims = scoring.weighted(model)
    # What doesn't depend on the role is worked out once for each person.
    fixed = {n: d for n, d in dims.items() if set(d.features) <= set(own.columns)}
    varied = {n: d for n, d in dims.items() if n not in fixed}
    ids = ("person_id", "canonical_name", "entity_resolution_status")
    others = [n for n in model.dimensions if n not in dims]
    base = base.select(*ids, *(f"dim_{n}" for n in others), *(c.alias(n) for n, c in own.shared.items()), *(c.alias(n) for n, c in own.columns.items()), own.feeding.alias("feeding"))
    base = base.select("*", *(scoring.normal_value(F.col(f), spec).alias(f"__{n}.{f}") for n, d in fixed.items() for f, spec in d.features.items()))
    column = lambda n: F.col(f"`__{n}`")
    base = base.select("*", *(scoring.present_weight(n, d, column).alias(f"__present_{n}") for n, d in fixed.items()))
    base = base.select("*", *(scoring.weighted_dimension(n, d, column, F.col(f"__present_{n}")).alias(f"dim_{n}") for n, d in fixed.items()), scoring._sum(F.col(f"__present_{n}") for n in fixed).alias("__fixed"))
    # Few bytes and much work: every core should have its share.
    base = spread(base, "person_id")
    best = None
    for block in blocks:
        held = F.from_json(F.lit(json.dumps(block)), kind)

        def scores_of(r: Column) -> Column:
            features = bundles.talent_role(r)
            return F.struct(r["role_id"].alias("role_id"), *(scoring.normal_value(features[f], spec).alias(f"{n}.{f}") for n, d in varied.items() for f, spec in d.features.items()))

        normal = F.transform(held, scores_of)
        present = F.transform(normal, lambda r: F.struct(r.alias("r"), *(scoring.present_weight(n, d, r.getField).alias(n) for n, d in varied.items())))
        scores = F.transform(present, lambda p: F.struct(
            p["r"]["role_id"].alias("role_id"), *(scoring.weighted_dimension(n, d, p["r"].getField, p[n]).alias(f"dim_{n}") for n, d in varied.items()), scoring._sum(p[n] for n in varied).alias("present"),
        ))
        total = lambda s: priority(model, lambda c: s[c] if c.removeprefix("dim_") in varied else F.col(c))
        found = F.array_min(F.transform(scores, lambda s: F.struct((-total(s)).alias("worse"), s["role_id"].alias("role_id"), s.alias("s"))))
        best = found if best is None else F.least(best, found)
    if best is None:
        best = F.lit(None).cast("struct<worse:double,role_id:string,s:struct<role_id:string," + ",".join(f"dim_{n}:double" for n in varied) + ",present:double>>")
    # With roles everybody has a best one; a filter on it would have all roles matched twice.
    chosen = (base if blocks else base.limit(0)).select("*", best.alias("__best"))
    wide = chosen.select(*ids, "feeding", *own.columns, *(f"dim_{n}" for n in [*others, *fixed]), "__best.role_id", *(F.col(f"__best.s.dim_{n}").alias(f"dim_{n}") for n in varied), (F.col("__fixed") + F.col("__best.s.present")).alias("present"))
    return _projected(wide, model, as_of)


def ranked(scores: DataFrame, target: str) -> DataFrame:
    """Scores with rank and percentile among all people scored for the target."""
    return ranking.ranked(scores.withColumn("target", F.lit(target)), ["target"], "priority")


def decided(scores: DataFrame, rule_set: list[dict]) -> DataFrame:
    """Scores with the action and reason codes of the first rule that holds.

    Rules read priority, confidence, access, quality, fit, timing, model_target, has_role_match, has_warm_path,
    is_newly_discovered and data_stale, as far as the scores have them.
    """
    context = scores.withColumn("model_target", F.col("target"))
    action, reasons = rules.first_match(rule_set, context.columns)
    return context.select(*scores.columns, action.alias("action"), reasons.alias("reason_codes"))


def contributions(scored_: DataFrame, model: Model) -> DataFrame:
    """(person_id, dimension, feature, raw, normalized, weight, included, effective_weight, contribution) of the weighted
    dimensions, from scored() rows: what each feature adds to its dimension's score of one. A feature that is left out adds
    nothing and has no effective weight."""
    normal = lambda n: F.col("normal").getField(n)
    dims, rows = scoring.weighted(model), []
    scored_ = scored_.select("*", *(scoring.present_weight(n, d, normal).alias(f"__present_{n}") for n, d in dims.items()))
    for name, dim in dims.items():
        present = F.col(f"__present_{name}")
        for feature, spec in dim.features.items():
            value = normal(f"{name}.{feature}")
            share = F.when(value.isNotNull(), spec.weight / present).otherwise(0.0)
            rows.append(F.struct(
                F.lit(name).alias("dimension"), F.lit(feature).alias("feature"), F.col(feature).cast("string").alias("raw"), value.alias("normalized"), F.lit(spec.weight).alias("weight"), value.isNotNull().alias("included"),
                scoring.rounded(share).alias("effective_weight"), scoring.rounded(F.coalesce(value, F.lit(0.0)) * share).alias("contribution"),
            ))
    return scored_.select("person_id", F.explode(F.array(*rows)).alias("c")).select("person_id", "c.*")

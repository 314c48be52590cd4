"""Config-driven scores in long form: contributions, dimensions, priority, confidence. Unknown never counts as zero."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import clip, decayed, normalized
from quillon.operators.config import Dimension, Feature, Model


def check_model(model: dict) -> None:
    """Refuse weights that don't sum to one, unknown normalisers and unknown missing behaviour."""
    total = sum(d["weight"] for d in model["dimensions"].values())
    if abs(total - 1.0) > 1e-6:
        raise ValueError(f"dimension weights sum to {total}")
    for name, d in model["dimensions"].items():
        for feature, spec in d["features"].items():
            normalized(spec["normalization"], F.lit(0.0) if spec["normalization"] != "tiered" else F.lit(""), spec.get("params"))
            if spec.get("missing", "unknown") not in ("unknown", "zero", "neutral"):
                raise ValueError(f"{name}.{feature}: missing {spec['missing']!r}")


def contributions(wide: DataFrame, subject: str, model: dict) -> DataFrame:
    """(subject, dimension, feature, raw, normalized, weight, included, contribution) from one column per feature.

    A missing value is left out, or counts as zero or a half, as the feature says. A contribution is the feature's
    share of its dimension's score; the denominator is the weight present, or the full weight where the dimension
    does not renormalise. One narrow pass: a dimension's weights are summed within the row.
    """
    rows = []
    for dim, d in model["dimensions"].items():
        made = []
        for feature, spec in d["features"].items():
            raw = F.col(feature)
            value = normalized(spec["normalization"], raw if spec["normalization"] == "tiered" else raw.cast("double"), spec.get("params"))
            missing = {"zero": F.lit(0.0), "neutral": F.lit(0.5)}.get(spec.get("missing", "unknown"))
            value = value if missing is None else F.coalesce(value, missing)
            made.append((feature, raw, value, float(spec["weight"])))
        full = sum(w for *_, w in made)
        present = reduce(lambda a, b: a + b, (F.when(v.isNotNull(), w).otherwise(0.0) for _, _, v, w in made))
        denominator = F.nullif(present, F.lit(0.0)) if d.get("renormalize", True) else F.lit(full)
        for feature, raw, value, weight in made:
            rows.append(F.struct(
                F.lit(dim).alias("dimension"), F.lit(feature).alias("feature"), raw.cast("string").alias("raw"), F.round(value, 6).alias("normalized"), F.lit(weight).alias("weight"),
                value.isNotNull().alias("included"), F.round(F.coalesce(value * weight / denominator, F.lit(0.0)), 6).alias("contribution"),
            ))
    return wide.select(subject, F.explode(F.array(*rows)).alias("c")).select(subject, "c.*")


def dimension_scores(long: DataFrame, subject: str) -> DataFrame:
    """(subject, dimension, score): 100 times the summed contributions; null where no feature is included."""
    score = F.when(F.max("included"), F.round(100.0 * F.sum("contribution"), 4))
    return long.groupBy(subject, "dimension").agg(score.alias("score"))


def signal_score(signals: DataFrame, subject: str, initial: Column, age_days: Column, half_life: Column) -> DataFrame:
    """(subject, score): 100 times the sum of decayed signals, clipped to [0, 1]; a signal of unknown age counts undecayed."""
    decay = decayed(initial, F.coalesce(age_days, F.lit(0.0)), half_life)
    return signals.groupBy(subject).agg(F.round(100.0 * clip(F.sum(decay)), 4).alias("score"))


def priority(scores: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of the known scores, their weights renormalised; null if none is known."""
    weighted = reduce(lambda a, b: a + b, (F.coalesce(c * w, F.lit(0.0)) for c, w in scores.values()))
    present = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), w).otherwise(0.0) for c, w in scores.values()))
    return F.round(weighted / F.nullif(present, F.lit(0.0)), 4)


def confidence(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean of components in [0, 1], apart from any score; unknown components leave the mean."""
    return priority({k: (clip(c), w) for k, (c, w) in parts.items()})


def breakdown(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Contributions now and before side by side, and their change; a feature on one side only counts as zero there."""
    a = now.select(*keys, F.col("contribution").alias("now"))
    b = before.select(*keys, F.col("contribution").alias("before"))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, "now", "before", F.round(F.coalesce("now", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 6).alias("change"))


def weight_diff(a: dict[str, float], b: dict[str, float]) -> dict[str, tuple[float | None, float | None]]:
    """Names whose weights differ between two configurations."""
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if a.get(k) != b.get(k)}


def rounded(c: Column, digits: int = 4) -> Column:
    """Rounded with ties upward whatever the binary form of a decimal fraction is."""
    return F.round(c + F.lit(1e-9), digits)


def normal_value(raw: Column, spec: Feature) -> Column:
    """A feature normalised and rounded to 4; null where it is unknown and doesn't count."""
    value = rounded(normalized(spec.normalization, raw.cast("string") if spec.normalization == "tiered" else raw.cast("double"), spec.params))
    filler = {"zero": 0.0, "neutral": 0.5}.get(spec.missing)
    return value if filler is None else F.coalesce(value, F.lit(filler))


def weighted(model: Model) -> dict[str, Dimension]:
    """The dimensions that weigh features."""
    return {n: d for n, d in model.dimensions.items() if d.kind == "weighted_features"}


def normal_columns(model: Model, raw: Callable[[str], Column]) -> dict[str, Column]:
    """Normalised features by the name dimension.feature, from the raw ones."""
    return {f"{n}.{f}": normal_value(raw(f), spec) for n, d in weighted(model).items() for f, spec in d.features.items()}


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def present_weight(name: str, dim: Dimension, normal: Callable[[str], Column]) -> Column:
    """Denominator of a weighted dimension: the weight of what is included, or the full weight; one where that is zero."""
    full = sum(f.weight for f in dim.features.values()) or 1.0
    if not dim.renormalize:
        return F.lit(full)
    present = F.round(_sum(F.when(normal(f"{name}.{f}").isNotNull(), spec.weight).otherwise(0.0) for f, spec in dim.features.items()), 6)
    return F.when(present == 0, 1.0).otherwise(present)


def weighted_dimension(name: str, dim: Dimension, normal: Callable[[str], Column], present: Column) -> Column:
    """100 times the weighted mean of the included features, by their normalised columns; 0 where none is included."""
    total = _sum(F.coalesce(normal(f"{name}.{f}") * spec.weight, F.lit(0.0)) for f, spec in dim.features.items())
    return rounded(100.0 * total / present)


def full_weight(model: Model) -> float:
    """Weight of all weighted dimensions, the denominator of completeness."""
    return sum(sum(f.weight for f in d.features.values()) or 1.0 for d in weighted(model).values()) or 1.0


def signal_dimension(signals: DataFrame, subject: str, dim: Dimension, name: str) -> DataFrame:
    """(subject, name): 100 times the decayed sum of a subject's signals, clipped; combined before the shuffle.

    signals: subject, event_type, days_since, probability. A signal takes its strength from its probability where the
    dimension says so; of unknown age it counts undecayed.
    """
    strength, half = F.lit(0.0), F.lit(60.0)
    for kind, c in dim.signals.items():
        initial = float(c.get("factor", 1.0)) * F.coalesce("probability", F.lit(0.0)) if c.get("initial_from") == "probability" else F.lit(float(c.get("initial", 0.0)))
        strength = F.when(F.col("event_type") == kind, initial).otherwise(strength)
        half = F.when(F.col("event_type") == kind, float(c.get("half_life_days", 60))).otherwise(half)
    value = decayed(strength, F.coalesce("days_since", F.lit(0.0)), half)
    kept = signals.filter(F.col("event_type").isin(*dim.signals))
    return kept.groupBy(subject).agg(F.round(100.0 * clip(F.sum(value)), 4).alias(name))


#: Confidence in an identity by the state of its resolution: fixed values.
IDENTITY = {"RESOLVED": 1.0, "MERGED": 1.0, "NEEDS_REVIEW": 0.6, "UNRESOLVED": 0.75}
IDENTITY_DEFAULT = 0.7
#: Daily rate at which a fact's recency falls: fixed value.
RECENCY_RATE = 0.005


def evidence_components(feeding: Column, as_of: Column) -> dict[str, Column]:
    """Reliability, independence, recency and extraction of the facts that feed a score, each rounded to 4.

    feeding: array of distinct structs (fact_id, at, extraction, strength, provider); strength and provider are null for a
    fact without evidence. Without facts: 0.5, 0.5, 0.5 and 1.
    """
    mean = lambda a, otherwise: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(otherwise)
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    of = lambda f: known(F.transform(feeding, f))
    day = lambda t: F.unix_micros(t.cast("timestamp")) / F.lit(86_400_000_000.0)
    ages = of(lambda x: F.exp(F.lit(-RECENCY_RATE) * F.greatest(F.lit(0.0), day(as_of) - day(x["at"]))))
    providers = F.array_distinct(of(lambda x: x["provider"]))
    parts = {
        "reliability": mean(of(lambda x: x["strength"]), 0.5),
        "independence": F.when(F.size(providers) > 0, F.least(F.lit(1.0), 0.5 + 0.25 * F.size(providers))).otherwise(0.5),
        "recency": mean(ages, 0.5),
        "extraction": mean(of(lambda x: x["extraction"]), 1.0),
    }
    return {k: rounded(v) for k, v in parts.items()}


def weighted_confidence(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the components, apart from any score."""
    total = _sum(F.coalesce(c, F.lit(0.0)) * float(weights.get(k, 0.0)) for k, c in parts.items())
    return rounded(clip(total / F.lit(sum(weights.values()) or 1.0)))

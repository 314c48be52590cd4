"""Numeric and date expressions: normalisers to [0, 1], confidences, ages and deltas. Unknown is null, never zero."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``c`` within bounds; null stays null."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def _capped_count(v: Column, p: dict) -> Column:
    return v / F.lit(float(p.get("max") or 1))


def _linear_cap(v: Column, p: dict) -> Column:
    return v / F.lit(float(p.get("divisor") or 1))


def _min_ratio(v: Column, p: dict) -> Column:
    r = v / F.lit(float(p.get("target") or 1))
    return F.lit(1.0) - r if p.get("invert") else r


def _exp_decay(v: Column, p: dict) -> Column:
    half_life = p.get("half_life_days") or p.get("half_life")
    if not half_life and p.get("lambda") is None:
        raise ValueError("exp_decay needs half_life_days or lambda")
    rate = math.log(2) / half_life if half_life else p["lambda"]
    return F.when(v.isNotNull(), F.exp(F.lit(-float(rate)) * F.greatest(F.lit(0.0), v)))


def _bucket(v: Column, p: dict) -> Column:
    if len(p["values"]) != len(p["thresholds"]) + 1:
        raise ValueError("bucket needs one value more than thresholds")
    out = F.lit(float(p["values"][-1]))
    for limit, value in reversed(list(zip(p["thresholds"], p["values"]))):
        out = F.when(v <= limit, float(value)).otherwise(out)
    return F.when(v.isNotNull(), out)


def _tiered(v: Column, p: dict) -> Column:
    tiers = p["tiers"]
    out = F.lit(float(tiers.get("_default", 0.0)))
    for name, value in tiers.items():
        if name != "_default":
            out = F.when(v == name, float(value)).otherwise(out)
    return out


#: name -> (column, parameters) -> column; tiered takes text, all others numbers.
NORMALIZERS: dict[str, Callable[[Column, dict], Column]] = {
    "binary": lambda v, p: F.when(v.isNotNull(), F.when(v != 0, 1.0).otherwise(0.0)),
    "capped_count": _capped_count,
    "linear_cap": _linear_cap,
    "min_ratio": _min_ratio,
    "exp_decay": _exp_decay,
    "tiered": _tiered,
    "passthrough_unit": lambda v, p: v,
    "bucket": _bucket,
}


def normalized(name: str, value: Column, params: dict | None = None) -> Column:
    """``value`` by the named normaliser, within [0, 1]; an unknown name raises."""
    if name not in NORMALIZERS:
        raise ValueError(f"unknown normaliser {name!r}; known: {', '.join(sorted(NORMALIZERS))}")
    return clip(NORMALIZERS[name](value, params or {}))


#: What each normaliser computes, for audits.
FORMULAS = {
    "binary": "1 if value else 0",
    "capped_count": "min(value, max) / max",
    "linear_cap": "clip(value / divisor, 0, 1)",
    "min_ratio": "clip(value / target, 0, 1), inverted: 1 - value / target",
    "exp_decay": "exp(-ln(2) / half_life_days * days)",
    "tiered": "value's place in tiers",
    "passthrough_unit": "clip(value, 0, 1)",
    "bucket": "step of thresholds and values",
}


def described(name: str, params: dict | None = None) -> dict:
    """A normalisation as shown in an audit: its name, formula, parameters and bounds."""
    return {"normalization": name, "formula": FORMULAS.get(name, "n/a"), "params": params or {}, "cap": 1.0, "floor": 0.0}


def days_between(earlier: Column, later: Column) -> Column:
    """Fractional days."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def decayed(initial: Column, age_days: Column, half_life: Column | float) -> Column:
    """``initial`` halved every ``half_life`` days; an age below zero counts as none, a null age gives null."""
    hl = half_life if isinstance(half_life, Column) else F.lit(float(half_life))
    return F.when(age_days.isNotNull(), initial * F.exp(-F.lit(math.log(2)) / hl * F.greatest(F.lit(0.0), age_days)))


def delta(new: Column, old: Column) -> Column:
    """Change of a score: null where the new one is unknown; an unknown old one counts as zero."""
    return new - F.coalesce(old, F.lit(0.0))


def lookup(key: Column, mapping: dict, default: float | None = None) -> Column:
    """Value of a fixed mapping, ``default`` for other keys and null."""
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(key == k, v).otherwise(out)
    return out


#: Weight of a source by reliability tier: fixed values.
TIER_WEIGHTS = {1: 1.0, 2: 0.85, 3: 0.7, 4: 0.55, 5: 0.35}


def tier_weight(tier: Column) -> Column:
    return lookup(tier, TIER_WEIGHTS, 0.5)


def source_confidence(reliability: Column, directness: Column, extraction: Column, independence: Column) -> Column:
    """Product of four factors in [0, 1], rounded to 2."""
    return F.round(clip(reliability * directness * extraction * independence), 2)


def capped_confidence(claimed: Column, reliability: Column) -> Column:
    """A claimed confidence, at most what the source's reliability leaves of it."""
    return F.round(F.least(claimed, reliability * claimed), 2)


def lenient_timestamp(c: Column) -> Column:
    """A whole timestamp, else the date in the first ten characters, else null."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(F.substring(c, 1, 10)))

"""Model, access, action and discovery configurations, read as they are written and checked before anything runs."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from quillon.functions.numbers import NORMALIZERS
from quillon.functions.values import config_hash
from quillon.operators.guards import guard_features

KINDS = ("weighted_features", "decay_signals", "access_model")
MISSING = ("unknown", "zero", "neutral")
#: Weights of confidence components where a model names none: fixed values.
CONFIDENCE_WEIGHTS = {"reliability": 0.22, "independence": 0.18, "recency": 0.18, "extraction": 0.15, "identity": 0.12, "completeness": 0.15}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Feature:
    weight: float
    normalization: str = "passthrough_unit"
    params: dict = field(default_factory=dict)
    missing: str = "unknown"


@dataclass(frozen=True)
class Dimension:
    """``features`` of a weighted dimension, ``signals`` of a decaying one."""

    weight: float
    kind: str
    renormalize: bool = True
    features: dict[str, Feature] = field(default_factory=dict)
    signals: dict[str, dict] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    name: str
    version: str
    target: str
    dimensions: dict[str, Dimension]
    confidence: dict[str, float]
    hash: str

    @property
    def full_version(self) -> str:
        return f"{self.name}_{self.version}"

    def feature_names(self) -> list[str]:
        return list(dict.fromkeys(n for d in self.dimensions.values() for n in d.features))


def read(path: str | Path) -> dict:
    """A configuration file: JSON, or YAML where a YAML reader is installed."""
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ConfigError(f"{path}: no YAML reader is installed; give the same as JSON") from e
    return yaml.safe_load(text)


def scan(folder: str | Path) -> list[dict]:
    """All configurations of a folder, by file name."""
    return [read(p) for p in sorted(Path(folder).iterdir()) if p.suffix in (".json", ".yaml", ".yml")]


def _feature(name: str, spec: dict | None) -> Feature:
    spec = spec or {}
    f = Feature(float(spec.get("weight", 0.0)), spec.get("normalization", "passthrough_unit"), spec.get("params") or {}, spec.get("missing_behavior", "unknown"))
    if f.normalization not in NORMALIZERS:
        raise ConfigError(f"feature {name!r}: unknown normalization {f.normalization!r}")
    if f.missing not in MISSING:
        raise ConfigError(f"feature {name!r}: missing_behavior {f.missing!r}")
    return f


def parse(raw: dict) -> Model:
    """A checked model: its dimension weights sum to one, and every kind, normalisation and missing behaviour is known."""
    for key in ("name", "version", "target", "priority", "dimensions"):
        if key not in raw:
            raise ConfigError(f"a model needs {key!r}")
    total = sum(float(w) for w in raw["priority"].values())
    if abs(total - 1.0) > 1e-6:
        raise ConfigError(f"dimension weights of {raw['name']} {raw['version']} sum to {total:.6f}")
    dimensions = {}
    for name, weight in raw["priority"].items():
        block = raw["dimensions"].get(name)
        if block is None:
            raise ConfigError(f"priority names {name!r}, dimensions do not")
        kind = block.get("kind", "weighted_features")
        if kind not in KINDS:
            raise ConfigError(f"dimension {name!r}: unknown kind {kind!r}")
        features = {f: _feature(f, spec) for f, spec in (block.get("features") or {}).items()} if kind == "weighted_features" else {}
        guard_features(list(features))
        dimensions[name] = Dimension(float(weight), kind, bool(block.get("renormalize_over_present", True)), features, (block.get("signals") or {}) if kind == "decay_signals" else {})
    confidence = (raw.get("confidence") or {}).get("weights") or CONFIDENCE_WEIGHTS
    return Model(raw["name"], raw["version"], raw["target"], dimensions, {k: float(v) for k, v in confidence.items()}, config_hash(raw))


def models(folder: str | Path) -> dict[str, Model]:
    """The models of a folder by name; files of other configurations are passed over."""
    return {m.name: m for raw in scan(folder) if "priority" in raw and "target" in raw for m in (parse(raw),)}


def discovery_rules(raws: list[dict]) -> list[dict]:
    """Active rules in order, as rules.first_rule() takes them."""
    out = []
    for raw in raws:
        least = raw.get("minimum_evidence") or {}
        phrases = {k: raw.get(k) or [] for k in ("keywords", "technical_topics", "titles", "excluded_keywords")}
        if raw.get("active", True):
            out.append({"name": raw["name"], "target_class": raw.get("target_class"), **phrases, "required_events": least.get("require_any_event_types") or [], "min_signals": int(least.get("min_signals", 1))})
    return out

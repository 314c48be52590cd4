"""The shipped models, access table and action rules, in the form in which config.parse() reads files."""

from __future__ import annotations


def _feature(weight: float, normalization: str, missing: str, **params) -> dict:
    return {"weight": weight, "normalization": normalization, "missing_behavior": missing, "params": params}


def _unit(weight: float) -> dict:
    return _feature(weight, "passthrough_unit", "unknown")


def _flag(weight: float, missing: str = "zero") -> dict:
    return _feature(weight, "binary", missing)


def _weighted(features: dict, renormalize: bool = True) -> dict:
    return {"kind": "weighted_features", "renormalize_over_present": renormalize, "features": features}


def _decaying(**signals: tuple[float, float]) -> dict:
    return {"kind": "decay_signals", "signals": {k: {"initial": i, "half_life_days": h} for k, (i, h) in signals.items()}}


_ACCESS = {"kind": "access_model", "model": "access_v0.1"}

#: Weights, normalisations and half-lives of the four models: fixed values.
FOUNDER = {
    "name": "founder", "version": "v0.1", "target": "founder",
    "priority": {"quality": 0.35, "fit": 0.25, "timing": 0.25, "access": 0.15},
    "dimensions": {
        "quality": _weighted({
            "prior_exit": _flag(0.15),
            "prior_founder": _feature(0.10, "capped_count", "zero", max=3),
            "institutional_fundraise": _flag(0.09),
            "product_shipped": _flag(0.08),
            "org_built_team_size": _feature(0.06, "linear_cap", "unknown", divisor=50),
            "verified_scale_milestone": _flag(0.06),
            "years_domain_experience": _feature(0.09, "min_ratio", "unknown", target=8),
            "years_engineering_experience": _feature(0.07, "min_ratio", "unknown", target=10),
            "research_depth": _feature(0.04, "capped_count", "zero", max=10),
            "patents": _feature(0.04, "capped_count", "zero", max=10),
            "oss_major": _flag(0.04),
            "early_employee_rank": _feature(0.05, "bucket", "unknown", thresholds=[10, 50, 200], values=[1.0, 0.7, 0.4, 0.1]),
            "promotions": _feature(0.04, "capped_count", "zero", max=4),
            "time_to_leadership_years": _feature(0.03, "min_ratio", "unknown", target=6, invert=True),
            "budget_ownership": _flag(0.03),
            "prestige_weak_signal": _flag(0.03),
        }),
        "fit": _weighted({
            "sector_match": _unit(0.18), "technology_match": _unit(0.16), "technical_topic_match": _unit(0.16), "business_model_match": _unit(0.12), "stage_match": _unit(0.10), "geography_match": _unit(0.10),
            "portfolio_adjacency": _unit(0.08), "thesis_embedding_similarity": _unit(0.10),
        }),
        "timing": _decaying(
            EMPLOYMENT_ENDED=(1.00, 45), FOUNDER_TITLE_ADDED=(1.00, 60), STEALTH_COMPANY_SIGNAL=(0.85, 45), COMPANY_FORMATION_CONFIRMED=(1.00, 120), PRODUCT_LAUNCH=(0.80, 90),
            FUNDRAISE_ANNOUNCED=(0.95, 75), COFOUNDER_SEARCH=(0.80, 40), HIRING_STARTED=(0.70, 60), DOMAIN_ACTIVITY_SPIKE=(0.50, 30),
        ),
        "access": _ACCESS,
    },
    "confidence": {"weights": {"reliability": 0.22, "independence": 0.18, "recency": 0.18, "extraction": 0.15, "identity": 0.12, "completeness": 0.15}},
}
FOUNDER["dimensions"]["timing"]["signals"]["POSSIBLE_COMPANY_FORMATION"] = {"initial_from": "probability", "factor": 0.90, "half_life_days": 40}
LP = {
    "name": "lp", "version": "v0.1", "target": "lp",
    "priority": {"authority": 0.20, "capital_relevance": 0.15, "venture_allocation_fit": 0.20, "emerging_manager_fit": 0.10, "house_fit": 0.15, "timing": 0.10, "access": 0.10},
    "dimensions": {
        "authority": _weighted({
            "is_cio": _flag(0.24), "is_partner": _flag(0.20), "is_head_of_venture": _flag(0.16), "is_head_of_alternatives": _flag(0.14), "is_ic_member": _flag(0.12), "is_family_office_lead": _flag(0.08),
            "principal_with_mandate": _flag(0.06),
        }, renormalize=False),
        "capital_relevance": _weighted({"org_is_allocator_type": _flag(0.45), "disclosed_aum": _feature(0.35, "min_ratio", "unknown", target=5000000000), "known_fund_investment_activity": _flag(0.20)}),
        "venture_allocation_fit": _weighted({
            "allocates_to_vc": _flag(0.30, "unknown"), "allocates_to_emerging_managers": _flag(0.25, "unknown"), "allocates_early_stage": _flag(0.20, "unknown"), "geo_match": _unit(0.15), "strategy_match": _unit(0.10),
        }),
        "emerging_manager_fit": _weighted({"emerging_manager_program_evidence": _flag(0.60), "prior_emerging_commitments": _feature(0.40, "capped_count", "zero", max=5)}),
        "house_fit": _weighted({"stage_fit": _unit(0.30), "size_fit": _unit(0.25), "sector_fit": _unit(0.25), "geo_fit": _unit(0.20)}),
        "timing": _decaying(
            CIO_ROLE_STARTED=(1.00, 90), PARTNER_ROLE_STARTED=(1.00, 90), INVESTMENT_MANDATE_CHANGED=(1.00, 75), LP_ROLE_STARTED=(0.85, 90), FAMILY_OFFICE_ROLE_STARTED=(0.85, 90),
            VENTURE_ALLOCATION_SIGNAL=(0.80, 120), EMERGING_MANAGER_SIGNAL=(0.80, 120), INVESTMENT_COMMITTEE_ROLE=(0.75, 100),
        ),
        "access": _ACCESS,
    },
    "confidence": {"weights": {"reliability": 0.24, "independence": 0.18, "recency": 0.16, "extraction": 0.14, "identity": 0.12, "completeness": 0.16}},
}
TALENT = {
    "name": "talent", "version": "v0.1", "target": "talent",
    "priority": {
        "functional": 0.18, "seniority": 0.12, "domain": 0.18, "stage_experience": 0.12, "operating_experience": 0.10, "execution_evidence": 0.12, "location": 0.06, "availability_timing": 0.06, "access": 0.06,
    },
    "dimensions": {
        "functional": _weighted({"function_alignment": _feature(1.0, "tiered", "unknown", tiers={"exact": 1.0, "adjacent": 0.6, "none": 0.1})}, renormalize=False),
        "seniority": _weighted({"seniority_distance": _feature(1.0, "bucket", "unknown", thresholds=[0, 1, 2], values=[1.0, 0.7, 0.4, 0.1])}, renormalize=False),
        "domain": _weighted({"domain_overlap": _unit(1.0)}, renormalize=False),
        "stage_experience": _weighted({"stage_overlap": _feature(1.0, "tiered", "unknown", tiers={"match": 1.0, "adjacent": 0.6, "none": 0.15})}, renormalize=False),
        "operating_experience": _weighted({"years_operating": _feature(1.0, "min_ratio", "unknown", target=8)}),
        "execution_evidence": _weighted({
            "product_shipped": _flag(0.30), "org_built_team_size": _feature(0.30, "linear_cap", "unknown", divisor=50), "promotions": _feature(0.20, "capped_count", "zero", max=4), "budget_ownership": _flag(0.20),
        }),
        "location": _weighted({"location_alignment": _feature(1.0, "tiered", "unknown", tiers={"same_metro": 1.0, "remote_ok": 0.8, "same_country": 0.6, "mismatch": 0.1})}, renormalize=False),
        "availability_timing": _decaying(OPEN_TO_WORK_SIGNAL=(1.00, 120), PROFESSIONAL_DEPARTURE=(0.75, 90), NEW_EXECUTIVE_ROLE=(-0.80, 180), COMPANY_ACQUIRED=(0.50, 120)),
        "access": _ACCESS,
    },
    "confidence": {"weights": {"reliability": 0.20, "independence": 0.16, "recency": 0.20, "extraction": 0.14, "identity": 0.14, "completeness": 0.16}},
}
CONNECTOR = {
    "name": "connector", "version": "v0.1", "target": "connector",
    "priority": {"connectivity": 0.72, "independent_paths": 0.10, "cross_sector": 0.10, "relationship_freshness": 0.04, "intro_track_record": 0.04},
    "dimensions": {
        "connectivity": _weighted({
            "relevant_connections": _feature(0.40, "capped_count", "zero", max=40), "founder_connectivity": _feature(0.22, "capped_count", "zero", max=25), "lp_connectivity": _feature(0.22, "capped_count", "zero", max=15),
            "portfolio_connectivity": _feature(0.16, "capped_count", "zero", max=15),
        }),
        "independent_paths": _weighted({"independent_path_count": _feature(1.0, "capped_count", "zero", max=10)}, renormalize=False),
        "cross_sector": _weighted({"distinct_sectors": _feature(1.0, "capped_count", "zero", max=6)}, renormalize=False),
        "relationship_freshness": _weighted({"fresh_edge_share": _unit(1.0)}, renormalize=False),
        "intro_track_record": _weighted({"successful_intros": _feature(1.0, "capped_count", "zero", max=10)}, renormalize=False),
    },
    "confidence": {"weights": {"reliability": 0.18, "independence": 0.14, "recency": 0.24, "extraction": 0.12, "identity": 0.16, "completeness": 0.16}},
}
MODELS = {m["name"]: m for m in (FOUNDER, LP, TALENT, CONNECTOR)}

#: Base scores of paths and their adjustments: fixed values.
ACCESS = {
    "max_hops": 3,
    "path_base": {"DIRECT": 100, "HOP1_STRONG": 90, "HOP1_MODERATE": 75, "HOP1_WEAK": 55, "HOP2_STRONG": 45, "HOP2_MODERATE": 30, "HOP2_WEAK": 18, "HOP3_ANY": 15, "NO_PATH": 0},
    "adjustments": {
        "independent_paths": {"per_extra_path": 4, "max_bonus": 8},
        "staleness": {"threshold_days": 365, "per_month_penalty": 4, "max_penalty": 15},
        "confidence_clamp": {"enabled": True, "floor": 0.5},
    },
}
#: Action rules in order: fixed values.
ACTIONS = [
    {"when": {"data_stale": True, "priority_gte": 60}, "then": "VERIFY_DATA", "reason_codes": ["DATA_STALE"]},
    {"when": {"priority_gte": 70, "confidence_lt": 0.60}, "then": "VERIFY_DATA", "reason_codes": ["LOW_CONFIDENCE"]},
    {"when": {"model_target": "talent", "has_role_match": True, "priority_gte": 70}, "then": "MATCH_TO_PORTFOLIO_ROLE", "reason_codes": ["PORTFOLIO_ROLE_MATCH"]},
    {"when": {"priority_gte": 85, "confidence_gte": 0.80, "access_gte": 70}, "then": "REQUEST_INTRO", "reason_codes": ["HIGH_PRIORITY", "WARM_PATH_AVAILABLE"]},
    {"when": {"priority_gte": 85, "confidence_gte": 0.80, "access_lt": 70}, "then": "CONTACT_NOW", "reason_codes": ["HIGH_PRIORITY", "NO_WARM_PATH"]},
    {"when": {"model_target": "lp", "priority_gte": 40, "confidence_gte": 0.60}, "then": "LP_RELATIONSHIP_BUILDING", "reason_codes": ["LP_CANDIDATE"]},
    {"when": {"priority_gte": 50, "confidence_gte": 0.60}, "then": "CONSIDER_CONTACT", "reason_codes": ["MODERATE_PRIORITY"]},
    {"when": {"priority_gte": 35}, "then": "MONITOR", "reason_codes": ["BELOW_CONTACT_THRESHOLD"]},
    {"when": {"always": True}, "then": "PASS", "reason_codes": ["LOW_PRIORITY"]},
]
#: A role match from this priority counts as one: fixed value.
ROLE_MATCH = 55.0

#: The thesis of these queries, in words of the test tables: a parameter.
THESIS = {
    "sectors": ["payments", "health", "aerospace", "energy", "analytics", "family office"],
    "technologies": ["imaging", "storage", "vector ledger"],
    "technical_topics": ["mapping", "fusion", "treasury"],
    "business_models": ["marketplace services"],
    "stages": ["seed"],
    "geographies": ["BQ", "TH"],
    "embedding_model": None,
}

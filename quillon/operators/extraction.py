"""Facts, events and inferences of observations, dispatched by content type in one narrow pass."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import numbers, values
from quillon.operators import rules
from quillon.operators.rules import Finding
from quillon.operators.taxonomy import INFERENCE_TYPES

#: Profile fields, under the names that rules use, that are text and that are flags.
TEXTS = {"headline": "headline", "company": "current_company", "title": "current_title", "seniority": "current_seniority", "location": "location"}
FLAGS = {"building": "building", "founder": "founder_status", "open": "open_to_work"}
#: Numbers and flags of a first profile with their fact types and units: fixed values.
NUMBER_FACTS = {
    "years_domain_experience": ("YEARS_DOMAIN_EXPERIENCE", "years"),
    "years_engineering_experience": ("YEARS_ENGINEERING_EXPERIENCE", "years"),
    "patent_count": ("PATENT_COUNT", "count"),
    "publication_count": ("PUBLICATION_COUNT", "count"),
    "companies_founded": ("COMPANIES_FOUNDED_COUNT", "count"),
    "promotion_count": ("PROMOTION_COUNT", "count"),
    "team_size_managed": ("TEAM_SIZE_MANAGED", None),
    "early_employee_rank": ("EARLY_EMPLOYEE_RANK", "count"),
}
FLAG_FACTS = {
    "prior_exit": "PRIOR_EXIT",
    "prior_founder": "PRIOR_FOUNDER",
    "institutional_fundraise": "INSTITUTIONAL_FUNDRAISE",
    "product_shipped": "PRODUCT_SHIPPED",
    "budget_ownership": "BUDGET_OWNERSHIP",
    "oss_major": "OSS_PROJECT_MAJOR",
    "verified_scale_milestone": "VERIFIED_SCALE_MILESTONE",
}


def _get(variant: str, field: str) -> Column:
    return F.try_variant_get(variant, f"$.{field}", "string")


def side(variant: str) -> Column:
    """A profile as the struct that rules.profile_rules() reads."""
    return F.struct(*(_get(variant, f).alias(n) for n, f in TEXTS.items()), *(values.truthy(_get(variant, f)).alias(n) for n, f in FLAGS.items()))


def baseline_rules(profile: str) -> list[Finding]:
    """Facts of a first profile. An open fundraising status is recorded as unknown."""
    get = lambda f: _get(profile, f)
    has = lambda f: F.coalesce(get(f) != "", F.lit(False))
    out = [
        Finding("fact", "HEADLINE_TEXT", has("headline"), 0.99, get("headline")),
        Finding("fact", "CURRENT_TITLE", has("current_title") & has("current_company"), 0.95, get("current_title"), get("current_company")),
        Finding("fact", "LOCATION", has("location"), 0.9, get("location")),
    ]
    out += [Finding("fact", t, get(f).isNotNull(), 0.9, get(f), unit=u) for f, (t, u) in NUMBER_FACTS.items()]
    out += [Finding("fact", t, get(f).isNotNull(), 0.9, values.truthy(get(f)).cast("string")) for f, t in FLAG_FACTS.items()]
    return [*out, Finding("fact", "FUNDRAISING_STATUS", F.coalesce(get("fundraising_status"), F.lit("")).isin("", "unknown"), 1.0)]


def structured_rules(v: str) -> list[Finding]:
    """The fact or event that a structured record names.

    Its value is an object with value, status and unit, else raw_value with unit, else the plain value; a record without
    any is a fact of unknown value. An event that says it is an inference, or whose type is one, is an inference.
    """
    get = lambda f: _get(v, f)
    within = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.value", "variant")).startswith("OBJECT"), F.lit(False))
    value = F.coalesce(F.when(within, get("value.value")), get("raw_value"), F.when(~within, get("value")))
    value = F.when(~F.coalesce(get("value.status") == "unknown", F.lit(False)), value)
    confidence = F.coalesce(get("confidence").try_cast("double"), F.lit(0.9))
    guess = F.coalesce(values.truthy(get("is_inference")), F.lit(False)) | F.coalesce(get("event_type").isin(*INFERENCE_TYPES), F.lit(False))
    event = lambda kind, c, p: Finding(kind, get("event_type"), get("event_type").isNotNull() & c, p, None, get("organization_name"))
    return [
        Finding("fact", get("fact_type"), get("fact_type").isNotNull(), confidence, value, get("organization_name"), unit=F.coalesce(get("value.unit"), get("unit"))),
        event("event", ~guess, confidence),
        event("inference", guess, F.coalesce(get("probability").try_cast("double"), confidence)),
    ]


def said(raw_text: str, v: str) -> Column:
    """What an observation says: its text with title, body and summary of its payload."""
    part = lambda f: F.nullif(_get(v, f), F.lit(""))
    return F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.col(raw_text), F.lit("")), part("title"), part("body"), part("summary"))), F.lit(""))


def extracted(o: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, kind, name, confidence, value, organization, unit and occurred of all that observations yield.

    o: content_type, subject_hint, raw_text, raw_json, previous_snapshot and ``keep``. A profile is compared with the
    snapshot before it, or gives its first facts where there is none; structured records give what they name; all else
    is read as text. occurred is the day the payload names, else null. Unreadable payloads, and empty observations,
    yield nothing; a fact without a value is unknown.
    """
    d = o.select(*keep, "content_type", "subject_hint", "raw_text", values.opened(F.col("raw_json")).alias("__v"), values.opened(F.col("previous_snapshot")).alias("__b"))
    d = d.select("*", values.profile(F.col("__v")).alias("__a"), values.profile(F.col("__b")).alias("__p"))
    is_profile = F.coalesce(F.col("content_type") == "profile_snapshot", F.lit(False))
    named = F.coalesce(F.col("content_type").isin("csv_row", "json_record"), F.lit(False)) & (_get("__v", "fact_type").isNotNull() | _get("__v", "event_type").isNotNull())
    branch = F.when(is_profile & F.col("__v").isNull(), "none").when(is_profile & F.col("__b").isNotNull(), "pair").when(is_profile, "first").when(named, "record").otherwise("text")
    day = lambda *fields: F.coalesce(*(F.regexp_extract(_get("__v", f), r"^(\d{4}-\d{2}-\d{2})", 1).try_cast("date") for f in fields)).cast("timestamp_ntz")
    occurred = F.when(is_profile, day("observed_on", "as_of")).when(named, day("occurred_at"))
    d = d.select(*keep, "content_type", "subject_hint", "__v", "__a", branch.alias("__branch"), occurred.alias("occurred"), side("__p").alias("__before"), side("__a").alias("__after"), said("raw_text", "__v").alias("__said"))
    made = [("pair", rules.profile_rules("__before", "__after")), ("first", baseline_rules("__a")), ("record", structured_rules("__v")), ("text", rules.text_rules("__said", "subject_hint", "content_type"))]
    all_rules = [replace(r, condition=(F.col("__branch") == b) & r.condition) for b, rs in made for r in rs]
    return rules.findings(d, all_rules, [*keep, "occurred"])


def changed_fields(before: Column, after: Column) -> Column:
    """Names of the eight material profile fields that differ between two profile variants; null equals absent."""
    fields = [*TEXTS.values(), *FLAGS.values()]
    get = lambda c, f: F.try_variant_get(c, f"$.{f}", "string")
    return F.array_compact(F.array(*(F.when(~get(before, f).eqNullSafe(get(after, f)), F.lit(f)) for f in fields)))


def event_confidence(claimed: Column, tier: Column) -> Column:
    """A claimed confidence, at most what the tier of its source leaves of it."""
    return F.round(F.least(claimed, numbers.source_confidence(numbers.tier_weight(tier), F.lit(1.0), claimed, F.lit(1.0))), 2)

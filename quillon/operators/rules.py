"""Rule tables as columns: findings of text and of snapshot pairs, first-match decisions, keyword discovery."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.numbers import lookup
from quillon.functions.text import clean_org, hits, material_change, snippet


@dataclass(frozen=True)
class Finding:
    """One rule: what it yields when its condition holds."""

    kind: str  # 'event', 'fact' or 'inference'
    name: str | Column
    condition: Column
    confidence: Column | float
    value: Column | None = None
    organization: Column | None = None
    unit: str | Column | None = None


def findings(df: DataFrame, rules: list[Finding], keep: list[str]) -> DataFrame:
    """One row per rule that holds: ``keep``, kind, name, confidence, value, organization, unit. One narrow pass."""

    def row(r: Finding) -> Column:
        text = lambda c: (F.lit(None) if c is None else c).cast("string")
        confidence = r.confidence if isinstance(r.confidence, Column) else F.lit(float(r.confidence))
        said = lambda c: text(F.lit(c) if isinstance(c, str) else c)
        made = F.struct(F.lit(r.kind).alias("kind"), said(r.name).alias("name"), confidence.cast("double").alias("confidence"), text(r.value).alias("value"), text(r.organization).alias("organization"), said(r.unit).alias("unit"))
        return F.when(F.coalesce(r.condition, F.lit(False)), made)

    return df.select(*keep, F.explode(F.array_compact(F.array(*(row(r) for r in rules)))).alias("f")).select(*keep, "f.*")


#: Ranks of seniority; other words rank 0. Fixed values.
SENIORITY = {"ic": 1, "senior_ic": 2, "manager": 3, "director": 4, "vp": 5, "svp": 6, "c_level": 7, "partner": 7, "founder": 7, "board": 6, "advisor": 3}

#: Phrases that mark a headline: fixed values.
BUILDING = r"(?i)\b(building|stealth|working on something new|founder|co[- ]?founder|something new|new (?:company|venture|thing)|0\s*to\s*1)\b"
STEALTH = r"(?i)\b(stealth|quietly building|under wraps)\b"
FOUNDER = r"(?i)\b(founder|co[- ]?founder|founding (?:team|engineer)|ceo & founder)\b"
COFOUNDER_SEARCH = r"(?i)\b(looking for a (?:technical )?co[- ]?founder|cofounder wanted)\b"
HIRING = r"(?i)\b(we'?re hiring|now hiring|join us|hiring across)\b"


def profile_rules(before: str, after: str) -> list[Finding]:
    """Rules on two profiles: struct columns with text headline, company, title, seniority and location and the
    booleans building, founder and open. A formation is inferred from one signal or more and a sign of it now."""
    b, a = (lambda f: F.col(f"{before}.{f}")), (lambda f: F.col(f"{after}.{f}"))
    sure = lambda c: F.coalesce(c, F.lit(False))
    has = lambda c: sure(F.trim(c) != "")
    says = lambda side, pattern: sure(side("headline").rlike(pattern))
    newly = lambda pattern: says(a, pattern) & ~says(b, pattern)
    other_company = ~a("company").eqNullSafe(b("company"))
    left, joined = has(b("company")) & other_company, has(a("company")) & other_company
    stayed = has(a("company")) & sure(a("company") == b("company"))
    retitled = stayed & has(a("title")) & ~a("title").eqNullSafe(b("title"))
    rose = lookup(F.lower(a("seniority")), SENIORITY, 0) > lookup(F.lower(b("seniority")), SENIORITY, 0)
    headline = material_change(b("headline"), a("headline"))
    building_now, building_before = (sure(s("building")) | says(s, BUILDING) for s in (a, b))
    founder_now, founder_before = (sure(s("founder")) | says(s, FOUNDER) for s in (a, b))
    stealth = says(a, STEALTH)
    signals = reduce(lambda x, y: x + y, (c.cast("int") for c in (left, building_now & ~building_before, stealth, founder_now & ~founder_before)))
    formation = F.round(F.least(F.lit(0.85), F.lit(0.35) + 0.2 * signals), 4)
    opened = sure(a("open")) & ~sure(b("open"))
    moved = has(a("location")) & ~a("location").eqNullSafe(b("location"))
    return [
        Finding("event", "EMPLOYMENT_ENDED", left, 0.95, b("company"), b("company")),
        Finding("fact", "EMPLOYMENT_ENDED_AT", left, 0.95, b("company"), b("company")),
        Finding("event", "EMPLOYMENT_STARTED", joined, 0.9, a("company"), a("company")),
        Finding("fact", "CURRENT_TITLE", joined, 0.9, F.coalesce(a("title"), F.lit("unknown")), a("company")),
        Finding("event", "TITLE_CHANGED", retitled, 0.9, a("title"), a("company")),
        Finding("event", "PROMOTION", retitled & rose, 0.9, a("title"), a("company")),
        Finding("fact", "HEADLINE_CHANGED", headline, 0.98, a("headline")),
        Finding("fact", "HEADLINE_TEXT", headline, 0.99, F.coalesce(a("headline"), F.lit(""))),
        Finding("event", "HEADLINE_CHANGED", headline, 0.98, a("headline")),
        Finding("event", "FOUNDER_TITLE_ADDED", founder_now & ~founder_before, 0.95, a("headline")),
        Finding("inference", "STEALTH_COMPANY_SIGNAL", newly(STEALTH), 0.7, a("headline")),
        Finding("event", "COFOUNDER_SEARCH", says(a, COFOUNDER_SEARCH), 0.85, a("headline")),
        Finding("event", "HIRING_STARTED", newly(HIRING), 0.7, a("headline")),
        Finding("inference", "POSSIBLE_COMPANY_FORMATION", (signals >= 1) & (building_now | founder_now | stealth), formation),
        Finding("event", "OPEN_TO_WORK_SIGNAL", opened, 0.9),
        Finding("fact", "OPEN_TO_WORK_DECLARED", opened, 0.95, F.lit("true")),
        Finding("fact", "LOCATION", moved, 0.85, a("location")),
    ]


#: Patterns of free text: fixed values.
ORG_AFTER = r"\b(?:at|from|joined|joins|joining|left|leaving|departs?|departing)\s+([A-Z][A-Za-z0-9&.\- ]{1,40}?)(?=[\s,.;:]|$)"
RAISED = r"(?i)\brais(?:e|ed|ing)\s+\$?\s?(\d[\d.,]*)\s*(k|m|bn|b|million|billion)?"
RAISED_A = r"(?i)\brais(?:e|ed|ing)\s+(?:an?\s+)?\$?\s?(\d[\d.,]*)\s*(k|m|bn|b|million|billion)?"
SERIES = r"(?i)\b(pre-?seed|seed|series\s+[a-e])\b"
LAUNCH = r"(?i)\b(launch(?:ed|ing)?|introducing|unveil(?:ed|ing)?|now available)\b"
TEXT_STEALTH = r"(?i)\bstealth\b"
TEXT_BUILDING = r"(?i)\b(building (?:a|his|her|their|out) \w+|working on something new|starting (?:a|his|her|their) (?:company|startup|venture)|(?:new|early-stage) startup|(?:in|now in) stealth)\b"
TEXT_COFOUNDER = r"looking for a (?:technical )?co-?founder"
OPEN_TO_WORK = r"(?i)\bopen to (?:work|new (?:roles|opportunities))\b"
PARTNER = r"(?i)\b(joined|promoted to|named)\s+(?:as\s+)?partner\b"
CIO = r"\b(chief investment officer|\bCIO\b)\b"
MANDATE = r"(?i)\b(venture (?:allocation|mandate)|allocate to venture|alternatives mandate)\b"
PATENT = r"(?i)\bpatent\b"
PAPER = r"(?i)\b(arxiv|published a paper|paper accepted|preprint)\b"
ACQUIRED = r"(?i)\b(acquired by|acquisition of|has acquired)\b"
#: Words that go with a pattern or a departure: fixed values.
LEAVING, LEAVING_TOO = ("left ", "leaving ", "departed", "stepping down", "after "), ("years at", "left ", "departing")
PRODUCT_WORDS = ("product", "platform", "app", "tool", "model", "project", "infrastructure")
APPOINTED = ("appointed", "named", "joins", "joined", "new")


def text_rules(text: str, subject: str, content_type: str, raised: str = RAISED) -> list[Finding]:
    """Rules on free text. ``raised`` may be RAISED_A, which also reads 'raised a $28M'."""
    t, low = F.col(text), F.lower(F.col(text))
    any_of = lambda words: reduce(lambda x, y: x | y, (low.contains(w) for w in words))
    org = F.nullif(clean_org(F.regexp_extract(t, ORG_AFTER, 1)), F.lit(""))
    ended = any_of(LEAVING) & any_of(LEAVING_TOO)
    funded = t.rlike(raised) & t.rlike(SERIES)
    launched, infra = t.rlike(LAUNCH) & any_of(PRODUCT_WORDS), any_of(("infrastructure", "infra"))
    opened, mandate = t.rlike(OPEN_TO_WORK), t.rlike(MANDATE)
    return [
        Finding("event", "NEWS_MENTION", (F.col(content_type) == "news_article") & F.col(subject).isNotNull(), 0.75, F.col(subject)),
        Finding("event", "EMPLOYMENT_ENDED", ended, 0.8, None, org),
        Finding("fact", "EMPLOYMENT_ENDED_AT", ended, 0.8, snippet(t, ["left", "after", "depart"]), org),
        Finding("event", "FUNDRAISE_ANNOUNCED", funded, 0.85),
        Finding("fact", "INSTITUTIONAL_FUNDRAISE", funded, 0.85, snippet(t, ["rais", "seed", "series"])),
        Finding("event", "TECHNICAL_PROJECT_LAUNCHED", launched & infra, 0.75),
        Finding("event", "PRODUCT_LAUNCH", launched & ~infra, 0.75),
        Finding("fact", "PRODUCT_SHIPPED", launched, 0.7, snippet(t, ["launch", "introduc", "unveil"])),
        Finding("inference", "STEALTH_COMPANY_SIGNAL", t.rlike(TEXT_STEALTH), 0.65),
        Finding("inference", "POSSIBLE_COMPANY_FORMATION", t.rlike(TEXT_BUILDING) & (F.col(content_type) != "profile_snapshot"), 0.5),
        Finding("event", "COFOUNDER_SEARCH", low.rlike(TEXT_COFOUNDER), 0.8),
        Finding("event", "OPEN_TO_WORK_SIGNAL", opened, 0.85),
        Finding("fact", "OPEN_TO_WORK_DECLARED", opened, 0.85, F.lit("true")),
        Finding("event", "PARTNER_ROLE_STARTED", t.rlike(PARTNER), 0.8, None, org),
        Finding("event", "CIO_ROLE_STARTED", t.rlike(CIO) & any_of(APPOINTED), 0.8, None, org),
        Finding("event", "INVESTMENT_MANDATE_CHANGED", mandate, 0.8),
        Finding("fact", "INVESTMENT_MANDATE", mandate, 0.8, F.lit("venture allocation")),
        Finding("event", "PATENT_FILED", t.rlike(PATENT), 0.7),
        Finding("event", "PAPER_PUBLISHED", t.rlike(PAPER), 0.7),
        Finding("event", "COMPANY_ACQUIRED", t.rlike(ACQUIRED), 0.8, None, org),
    ]


_COMPARE = {"gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v}


def condition(when: dict, columns: list[str]) -> Column:
    """All of a rule's conditions: {'score_gte': 60, 'flag': True, 'always': True}.

    An unknown number counts as zero and an unknown flag as false, so an unknown access is below every threshold.
    'always' holds if its value does; a condition on a column that isn't there never holds.
    """
    out = F.lit(True)
    for name, value in when.items():
        field, _, op = name.rpartition("_")
        if name == "always":
            test = F.lit(bool(value))
        elif op in _COMPARE and field in columns:
            test = _COMPARE[op](F.coalesce(F.col(field).cast("double"), F.lit(0.0)), float(value))
        elif name in columns and isinstance(value, bool):
            test = F.coalesce(F.col(name), F.lit(False)) == value
        elif name in columns:
            test = F.coalesce(F.col(name) == value, F.lit(False))
        else:
            test = F.lit(False)
        out = out & test
    return out


def first_match(rules: list[dict], columns: list[str], default: str = "UNKNOWN") -> tuple[Column, Column]:
    """(decision, reason codes) of the first rule that holds, from rules {'when', 'then', 'reason_codes'} over ``columns``."""
    decision, reasons = F.lit(default), F.array().cast("array<string>")
    for rule in reversed(rules):
        holds = condition(rule.get("when", {}), columns)
        decision = F.when(holds, rule.get("then", default)).otherwise(decision)
        reasons = F.when(holds, F.array(*(F.lit(c) for c in rule.get("reason_codes", ()))).cast("array<string>")).otherwise(reasons)
    return decision, reasons


def discovered(df: DataFrame, text: str, key: str, rules: list[dict]) -> DataFrame:
    """(key, rule, reasons, signals): for each text its first rule, in order, with enough phrase hits.

    rules: name, keywords, excluded, min_signals. Excluded phrases rule a rule out. Texts are tested once per rule in
    one narrow pass; null texts match nothing.
    """
    tried = []
    for r in rules:
        found = hits(F.col(text), r["keywords"])
        fits = (F.size(found) >= max(1, r.get("min_signals", 1))) & (F.size(hits(F.col(text), r.get("excluded", []))) == 0) & F.col(text).isNotNull()
        tried.append(F.when(fits, F.struct(F.lit(r["name"]).alias("rule"), found.alias("reasons"), F.size(found).alias("signals"))))
    return df.select(key, F.coalesce(*tried).alias("m")).filter("m is not null").select(key, "m.rule", "m.reasons", "m.signals")


def one_per_rule(candidates: DataFrame, rule: str, person: str, order: list[str]) -> DataFrame:
    """The first candidate of each (rule, person)."""
    w = Window.partitionBy(rule, person).orderBy(*order)
    return candidates.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def rule_match(text: Column, events: Column, rule: dict) -> tuple[Column, Column, Column]:
    """(holds, reasons, signals) of a discovery rule on a text and the event types found with it.

    An excluded phrase rules it out; required events must be met by one of them and count as a signal, as does asking for
    none. A rule without any phrase or event that holds gives no reason and doesn't match.
    """
    low = F.coalesce(text, F.lit(""))
    found = {k: hits(low, rule.get(k) or []) for k in ("keywords", "technical_topics", "titles")}
    wanted = sorted(rule.get("required_events") or [])
    none = F.array().cast("array<string>")
    met = F.array_sort(F.array_intersect(F.coalesce(events, none), F.array(*(F.lit(e) for e in wanted)))) if wanted else none
    gate = F.size(met) > 0 if wanted else F.lit(True)
    said = lambda label, a, most: F.when(F.size(a) > 0, F.concat(F.lit(f"{label}:"), F.array_join(F.slice(a, 1, most), ",")))
    reasons = F.array_compact(F.array(said("keywords", found["keywords"], 4), said("topics", found["technical_topics"], 4), said("titles", found["titles"], 3), said("events", met, 1_000)))
    signals = reduce(lambda a, b: a + b, (F.size(a) for a in found.values())) + gate.cast("int")
    banned = F.size(hits(low, rule.get("excluded_keywords") or [])) > 0
    return ~banned & gate & (signals >= int(rule.get("min_signals", 1))) & (F.size(reasons) > 0), reasons, signals


def first_rule(df: DataFrame, text: str, events: str, rules: list[dict]) -> DataFrame:
    """``df`` with rule, target_class, reasons and signals of the first active rule that matches; other rows are left out."""
    tried = []
    for r in rules:
        if r.get("active", True):
            holds, reasons, signals = rule_match(F.col(text), F.col(events), r)
            tried.append(F.when(holds, F.struct(F.lit(r["name"]).alias("rule"), F.lit(r.get("target_class")).cast("string").alias("target_class"), reasons.alias("reasons"), signals.alias("signals"))))
    if not tried:
        return df.limit(0).selectExpr("*", "'' as rule", "'' as target_class", "array('') as reasons", "0 as signals")
    return df.withColumn("__m", F.coalesce(*tried)).filter("__m is not null").select("*", "__m.*").drop("__m")

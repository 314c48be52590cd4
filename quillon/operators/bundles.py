"""Feature bundles of the four model targets as wide tables, one row per subject, null where a feature is unknown.

All that a person's features need is joined once into a frame of pre-aggregated columns (frame()); a builder is a set of
column expressions over it, so the four targets share one plan and no target shuffles anything of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import numbers, values
from quillon.operators import features
from quillon.operators.guards import guard_features
from quillon.operators.rules import SENIORITY

#: Founder features taken from one fact each; flags without a fact are known to be false. Fixed values.
FOUNDER_NUMBERS = {
    "years_domain_experience": "YEARS_DOMAIN_EXPERIENCE",
    "years_engineering_experience": "YEARS_ENGINEERING_EXPERIENCE",
    "research_depth": "PUBLICATION_COUNT",
    "patents": "PATENT_COUNT",
    "early_employee_rank": "EARLY_EMPLOYEE_RANK",
    "promotions": "PROMOTION_COUNT",
    "time_to_leadership_years": "TIME_TO_LEADERSHIP_YEARS",
}
FOUNDER_FLAGS = {
    "prior_exit": "PRIOR_EXIT",
    "institutional_fundraise": "INSTITUTIONAL_FUNDRAISE",
    "product_shipped": "PRODUCT_SHIPPED",
    "verified_scale_milestone": "VERIFIED_SCALE_MILESTONE",
    "oss_major": "OSS_PROJECT_MAJOR",
    "budget_ownership": "BUDGET_OWNERSHIP",
    "prestige_weak_signal": "PRESTIGE_FLAG",
}
#: Thesis dimensions and the features they give: fixed values.
THESIS = {
    "sector_match": "sectors",
    "technology_match": "technologies",
    "technical_topic_match": "technical_topics",
    "business_model_match": "business_models",
    "stage_match": "stages",
    "geography_match": "geographies",
}
#: Types of organisations that allocate capital, and words of a title that give authority over it: fixed values.
ALLOCATORS = ("family_office", "endowment", "foundation", "fund_of_funds", "fund")
AUTHORITY = {
    "is_cio": ("cio", "chief investment officer"),
    "is_partner": ("partner",),
    "is_head_of_venture": ("head of venture", "head of ventures"),
    "is_head_of_alternatives": ("head of alternatives", "head of alts"),
    "is_family_office_lead": ("family office lead", "family office investment lead"),
}
#: Functions next to a role's: fixed values.
ADJACENT = {"engineering": ("product", "research"), "product": ("engineering", "design"), "research": ("engineering",), "operations": ("finance",)}
#: Seniorities whose years don't count as operating years: fixed values.
NOT_OPERATING = ("founder", "board", "advisor")
#: Classes of people that make a connection relevant, by kind: fixed values.
FOUNDERS, ALLOCATOR_CLASSES, EXECUTIVES = ("FOUNDER", "POTENTIAL_FOUNDER"), ("LP", "POTENTIAL_LP"), ("PORTFOLIO_EXECUTIVE",)
#: Feedback that credits a connector: fixed values.
INTRODUCED = ("INTRO_COMPLETED", "MEETING_BOOKED")


@dataclass(frozen=True)
class World:
    """Tables from which features are built; person ids are live ones throughout.

    person: person_id, canonical_name, entity_resolution_status, monitoring_status, is_team_seed. facts: fact_id, person_id,
    fact_type, value struct(status, value, unit), valid_from, created_at, extraction_confidence, strength, provider.
    jobs: person_id, organization_id, function, seniority, started_at, ended_at, current. organization. events: person_id,
    event_type, occurred_at, detected_at, confidence. inferences: person_id, inference_type, probability, created_at,
    expires_at. edges: src, dst, strength (int rank), confidence, first_seen_at, created_at, verified. classes: person_id,
    person_class. feedback: connector_person_id, feedback_type. roles: role_id, function, seniority, domains, stages, metro,
    country, remote_ok. thesis: phrases by dimension.
    """

    person: DataFrame
    facts: DataFrame
    jobs: DataFrame
    organization: DataFrame
    events: DataFrame
    inferences: DataFrame
    edges: DataFrame
    classes: DataFrame
    feedback: DataFrame
    roles: DataFrame
    thesis: dict | None


def latest_facts(facts: DataFrame) -> DataFrame:
    """(person_id, facts): a map of each person's latest fact of every type, visible ones given.

    Two combined aggregations; a person's map has at most one entry per fact type. Later beginnings win, then later
    records, then the least fact_id; a fact without a beginning comes last.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    order = F.struct(F.col("valid_from").isNull(), -F.coalesce(micros("valid_from"), F.lit(0)), -F.coalesce(micros("created_at"), F.lit(0)), F.col("fact_id"))
    row = F.struct("fact_id", "value", F.coalesce("valid_from", "created_at").alias("at"), F.col("extraction_confidence").alias("extraction"), "strength", "provider", "valid_from")
    one = facts.groupBy("person_id", "fact_type").agg(F.min_by(row, order).alias("f"))
    return one.groupBy("person_id").agg(F.map_from_entries(F.collect_list(F.struct("fact_type", "f"))).alias("facts"))


def _sectors(prefix: str = "attributes") -> Column:
    """All sectors of an organisation in lower case, empty ones left out."""
    every = F.array_union(F.array(f"{prefix}.sector"), F.coalesce(f"{prefix}.sectors", F.array().cast("array<string>")))
    return F.filter(F.array_distinct(F.transform(every, F.lower)), lambda s: s.isNotNull() & (s != ""))


def job_features(jobs: DataFrame, organization: DataFrame, as_of: Column) -> DataFrame:
    """(person_id, functions, top_rank, years_operating, stages, names, org_texts, org, portfolio, sectors) of each person's jobs.

    org is the organisation of the latest current job. The sets are bounded by the number of organisations.
    """
    text = F.concat_ws(" . ", F.nullif("canonical_name", F.lit("")), "attributes.sectors", F.nullif("attributes.sector", F.lit("")))
    o = organization.select(
        "organization_id", "organization_type", "location", "aum_usd", "is_portfolio", F.col("canonical_name").alias("organization_name"), text.alias("org_text"),
        F.nullif(F.lower("attributes.stage"), F.lit("")).alias("stage"), _sectors().alias("sectors"),
    )
    j = jobs.join(o, "organization_id", "left")
    current = F.coalesce("current", F.lit(False))
    counted = ~F.coalesce(F.lower("seniority").isin(*NOT_OPERATING), F.lit(False)) & F.col("started_at").isNotNull()
    years = F.greatest(F.lit(0), F.datediff(F.coalesce("ended_at", as_of.cast("date")), F.col("started_at"))) / 365.25
    newest = F.struct(F.col("started_at").isNull(), -F.coalesce(F.unix_date("started_at"), F.lit(0)), F.col("organization_id"))
    org = F.struct("organization_id", "organization_type", "location", "aum_usd")
    return j.groupBy("person_id").agg(
        F.array_sort(F.collect_set("function")).alias("functions"),
        F.max(numbers.lookup(F.lower("seniority"), SENIORITY, 0)).alias("top_rank"),
        F.round(F.sum(F.when(counted, years)), 2).alias("years_operating"),
        F.array_sort(F.collect_set("stage")).alias("stages"),
        F.array_sort(F.collect_set("organization_name")).alias("names"),
        F.array_sort(F.collect_set("org_text")).alias("org_texts"),
        F.min_by(F.when(current & F.col("organization_id").isNotNull(), org), F.when(current & F.col("organization_id").isNotNull(), newest)).alias("org"),
        F.max(F.coalesce("is_portfolio", F.lit(False))).alias("portfolio"),
        F.array_distinct(F.flatten(F.collect_set(F.when(current, F.col("sectors"))))).alias("sectors"),
    )


def connector_features(world: World, jobs: DataFrame, as_of: Column) -> DataFrame:
    """(person_id, relevant_connections, founder_connectivity, lp_connectivity, portfolio_connectivity, independent_path_count,
    distinct_sectors, fresh_edge_share): counts over the distinct neighbours of each person, and over all its relations."""
    both = world.edges.select("src", "dst", "verified").union(world.edges.select("dst", "src", "verified")).toDF("person_id", "other", "verified")
    age = numbers.days_between(F.col("verified"), as_of)
    fresh = both.groupBy("person_id").agg(F.round(F.avg(F.when(F.coalesce(age <= 365, F.lit(False)), 1.0).otherwise(0.0)), 4).alias("fresh_edge_share"))
    of = lambda *names: F.max(F.col("person_class").isin(*names))
    marks = world.classes.groupBy("person_id").agg(of(*FOUNDERS).alias("founder"), of(*ALLOCATOR_CLASSES).alias("lp"), of(*EXECUTIVES).alias("executive"))
    other = world.person.select("person_id", "is_team_seed").join(marks, "person_id", "left").join(jobs.select("person_id", "portfolio", "sectors"), "person_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    other = other.select(F.col("person_id").alias("other"), *(flag(c).alias(c) for c in ("founder", "lp", "executive", "portfolio")), flag("is_team_seed").alias("seed"), F.coalesce("sectors", F.array().cast("array<string>")).alias("sectors"))
    near = both.filter("other <> person_id").select("person_id", "other").distinct().join(other, "other", "left")
    count = lambda c: F.sum(flag(c).cast("bigint"))
    counts = near.groupBy("person_id").agg(
        count(F.col("founder") | F.col("lp") | F.col("executive")).alias("relevant_connections"), count(F.col("founder")).alias("founder_connectivity"), count(F.col("lp")).alias("lp_connectivity"),
        (count(F.col("executive")) + count(F.col("portfolio"))).alias("portfolio_connectivity"), count(F.col("seed")).alias("independent_path_count"),
    )
    sectors = near.select("person_id", F.explode("sectors").alias("s")).distinct().groupBy("person_id").agg(F.count("*").alias("distinct_sectors"))
    return counts.join(sectors, "person_id", "left").join(fresh, "person_id", "full_outer")


def frame(world: World, people: DataFrame, as_of: Column) -> DataFrame:
    """(person_id, name, identity, facts, job columns, event_types, connector columns, intros): all that builders read."""
    jobs = job_features(world.jobs, world.organization, as_of)
    seen = world.events.groupBy("person_id").agg(F.array_sort(F.collect_set("event_type")).alias("event_types"))
    intros = world.feedback.filter(F.col("feedback_type").isin(*INTRODUCED)).groupBy(F.col("connector_person_id").alias("person_id")).agg(F.count("*").alias("intros"))
    out = people.select("person_id", "canonical_name", "entity_resolution_status")
    for part in (latest_facts(world.facts), jobs, seen, connector_features(world, jobs, as_of), intros):
        out = out.join(part, "person_id", "left")
    return out


class Facts:
    """Reads of the map column ``facts``: numbers, flags and texts, null where unknown."""

    def __init__(self, column: str = "facts"):
        self.map = F.col(column)

    def row(self, kind: str) -> Column:
        return F.try_element_at(self.map, F.lit(kind))

    def text(self, kind: str) -> Column:
        value = self.row(kind)["value"]
        return F.when(~values.is_unknown(value), F.coalesce(value["value"], F.lit("")))

    def number(self, kind: str) -> Column:
        return F.trim(self.text(kind)).try_cast("double")

    def flag(self, kind: str) -> Column:
        return values.truthy(self.text(kind))

    def feeding(self, *parts: tuple[str, Column]) -> Column:
        """Distinct facts of given kinds that are there and whose condition holds."""
        kind = "array<struct<fact_id:string,at:timestamp_ntz,extraction:double,strength:double,provider:string>>"
        if not parts:
            return F.array().cast(kind)
        row = lambda k: F.when(self.row(k).isNotNull(), F.struct(*(self.row(k)[f].alias(f) for f in ("fact_id", "at", "extraction", "strength", "provider"))))
        return F.array_distinct(F.array_compact(F.array(*(F.when(c, row(k)) for k, c in parts))))


@dataclass(frozen=True)
class Bundle:
    """Feature columns by name, the facts that feed them, and columns that several features read and that are made first."""

    columns: dict[str, Column]
    feeding: Column
    shared: dict[str, Column] = field(default_factory=dict)


def _or_false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def corpus(f: Facts) -> Column:
    """What is known of a person in words: headline, place, employers and their sectors."""
    parts = F.array_union(F.array(F.nullif(f.text("HEADLINE_TEXT"), F.lit("")), F.nullif(f.text("LOCATION"), F.lit(""))), F.coalesce("org_texts", F.array().cast("array<string>")))
    return F.array_join(F.array_compact(parts), " . ")


def adjacency(text: Column, held: list[str]) -> Column:
    """Share of three that the sectors held in the portfolio have in a text; 0 without any."""
    if not held:
        return F.lit(0.0)
    return F.least(F.lit(1.0), F.size(features.hits(text, held)) / float(max(1, min(len(held), 3))))


def founder(thesis: dict | None, held: list[str]) -> Bundle:
    f = Facts()
    words, number = F.col("__words"), lambda t: F.col(f"__{t}")
    counted = [*FOUNDER_NUMBERS.values(), "TEAM_SIZE_MANAGED", "COMPANIES_FOUNDED_COUNT"]
    shared = {"__words": corpus(f)} | {f"__{t}": f.number(t) for t in counted} | {f"__{t}": f.flag(t) for t in [*FOUNDER_FLAGS.values(), "PRIOR_FOUNDER"]}
    out = {n: _or_false(number(t)) for n, t in FOUNDER_FLAGS.items()} | {n: number(t) for n, t in FOUNDER_NUMBERS.items()}
    founded = number("COMPANIES_FOUNDED_COUNT")
    out["prior_founder"] = F.coalesce(founded, _or_false(number("PRIOR_FOUNDER")).cast("double"))
    out["org_built_team_size"] = number("TEAM_SIZE_MANAGED")
    for name, dimension in THESIS.items():
        out[name] = F.lit(None).cast("double") if thesis is None else features.phrase_match(words, thesis.get(dimension) or [])
    out["portfolio_adjacency"] = F.lit(None).cast("double") if thesis is None else adjacency(words, held)
    out["thesis_embedding_similarity"] = F.lit(0.0 if thesis and thesis.get("embedding_model") else None).cast("double")
    feeding = [(t, number(t).isNotNull()) for t in [*FOUNDER_FLAGS.values(), *counted]]
    return Bundle(out, f.feeding(*feeding, ("PRIOR_FOUNDER", founded.isNull() & number("PRIOR_FOUNDER").isNotNull())), shared)


def lp(thesis: dict | None, held: list[str]) -> Bundle:
    f = Facts()
    said = F.col("__said")
    shared = {"__said": F.lower(F.concat_ws(" ", *(F.coalesce(f.text(t), F.lit("")) for t in ("DECISION_AUTHORITY_ROLE", "CURRENT_TITLE", "HEADLINE_TEXT"))))}
    happened = lambda t: _or_false(F.array_contains("event_types", t))
    evidence = _or_false(f.flag("EMERGING_MANAGER_EVIDENCE"))
    out = {n: F.size(features.hits(said, list(needles))) > 0 for n, needles in AUTHORITY.items()}
    out["is_ic_member"] = happened("INVESTMENT_COMMITTEE_ROLE") | said.contains("investment committee")
    out["principal_with_mandate"] = said.contains("principal") & f.row("INVESTMENT_MANDATE").isNotNull()
    out["org_is_allocator_type"] = _or_false(F.col("org.organization_type").isin(*ALLOCATORS))
    out["disclosed_aum"] = F.nullif(F.col("org.aum_usd").cast("double"), F.lit(0.0))
    out["known_fund_investment_activity"] = happened("FUND_INVESTMENT_ACTIVITY")
    out["allocates_to_vc"] = out["allocates_early_stage"] = f.flag("VENTURE_ALLOCATION_EVIDENCE")
    out["allocates_to_emerging_managers"] = out["emerging_manager_program_evidence"] = happened("EMERGING_MANAGER_SIGNAL") | evidence
    near = _or_false(F.size(features.hits(F.col("org.location"), list((thesis or {}).get("geographies") or []))) > 0)
    out["geo_match"] = F.when(near, 1.0).otherwise(0.0)
    out["strategy_match"] = F.lit(0.0)
    out["prior_emerging_commitments"] = F.coalesce(f.number("EMERGING_MANAGER_EVIDENCE"), F.lit(0.0))
    for name in ("stage_fit", "size_fit", "sector_fit"):
        out[name] = F.when(F.col("org").isNotNull(), 0.4)
    out["geo_fit"] = F.when(F.col("org").isNotNull(), F.when(near, 1.0).otherwise(0.4))
    there = F.lit(True)
    return Bundle(out, f.feeding(("DECISION_AUTHORITY_ROLE", there), ("VENTURE_ALLOCATION_EVIDENCE", f.flag("VENTURE_ALLOCATION_EVIDENCE").isNotNull()), ("EMERGING_MANAGER_EVIDENCE", f.number("EMERGING_MANAGER_EVIDENCE").isNotNull())), shared)


def connector(thesis: dict | None, held: list[str]) -> Bundle:
    counts = ("relevant_connections", "founder_connectivity", "lp_connectivity", "portfolio_connectivity", "independent_path_count", "distinct_sectors")
    out = {c: F.coalesce(F.col(c), F.lit(0)) for c in counts}
    out["fresh_edge_share"] = F.col("fresh_edge_share")
    out["successful_intros"] = F.coalesce("intros", F.lit(0))
    return Bundle(out, Facts().feeding())


def talent_person() -> Bundle:
    """Features of a person that are the same for every role, the facts that feed them, and what the others read."""
    f = Facts()
    none = F.array().cast("array<string>")
    shared = {
        "__functions": F.coalesce("functions", none), "__rank": F.coalesce("top_rank", F.lit(0)), "__stages": F.coalesce("stages", none), "__place": F.lower(f.text("LOCATION")),
        "__words": F.lower(F.array_join(F.array_union(F.array(F.coalesce(f.text("HEADLINE_TEXT"), F.lit(""))), F.coalesce("names", none)), " ")),
    }
    out = {
        "years_operating": F.col("years_operating"), "product_shipped": _or_false(f.flag("PRODUCT_SHIPPED")), "budget_ownership": _or_false(f.flag("BUDGET_OWNERSHIP")),
        "org_built_team_size": f.number("TEAM_SIZE_MANAGED"), "promotions": F.coalesce(f.number("PROMOTION_COUNT"), F.lit(0.0)),
    }
    feeding = [(t, f.flag(t).isNotNull()) for t in ("PRODUCT_SHIPPED", "BUDGET_OWNERSHIP")] + [(t, f.number(t).isNotNull()) for t in ("TEAM_SIZE_MANAGED", "PROMOTION_COUNT")]
    return Bundle(out, f.feeding(*feeding), shared)


def talent_role(role: Column) -> dict[str, Column]:
    """Features of a person for one role: a struct of role_id, function, rank, domains and stages in lower case, adjacent
    functions, metro, country in lower case and remote_ok. Reads the shared columns of talent_person()."""
    functions, rank, words, stages, place = (F.col(f"__{n}") for n in ("functions", "rank", "words", "stages", "place"))
    within = lambda part: F.coalesce((part != "") & place.contains(part), F.lit(False))
    return {
        "function_alignment": F.when(F.size(functions) > 0, F.when(F.array_contains(functions, role["function"]), "exact").when(F.arrays_overlap(functions, role["adjacent"]), "adjacent").otherwise("none")),
        "seniority_distance": F.when(rank > 0, F.abs(role["rank"] - rank).cast("double")),
        "domain_overlap": F.when(F.size(role["domains"]) > 0, F.round(F.size(F.filter(role["domains"], lambda d: words.contains(d))) / F.size(role["domains"]), 4)),
        "stage_overlap": F.when(F.size(role["stages"]) > 0, F.when(F.arrays_overlap(role["stages"], stages), "match").when(F.size(stages) > 0, "adjacent").otherwise("none")),
        "location_alignment": F.when(place != "", F.when(role["remote_ok"], "remote_ok").when(within(role["metro"]), "same_metro").when(within(role["country"]), "same_country").otherwise("mismatch")),
    }


#: Builders by model target; talent needs a role and is built by talent().
BUILDERS: dict[str, Callable[[dict | None, list[str]], Bundle]] = {"founder": founder, "lp": lp, "connector": connector}


def build(target: str, thesis: dict | None, held: list[str]) -> Bundle:
    """The bundle of a target; its feature names are guarded."""
    if target == "talent":
        raise ValueError("talent features require a role")
    if target not in BUILDERS:
        raise KeyError(f"no feature builder for target {target!r}")
    bundle = BUILDERS[target](thesis, held)
    guard_features(list(bundle.columns))
    return bundle


def signals(world: World, as_of: Column) -> DataFrame:
    """(person_id, event_type, days_since, probability): events and inferences that may count as timing signals."""
    e = world.events.select("person_id", "event_type", numbers.days_between(F.col("occurred_at"), as_of).alias("days_since"), F.lit(None).cast("double").alias("probability"))
    i = world.inferences.select("person_id", F.col("inference_type").alias("event_type"), numbers.days_between(F.col("created_at"), as_of).alias("days_since"), F.col("probability").cast("double").alias("probability"))
    return e.unionByName(i)

"""Rule-based identity resolution: blocking, an additive scorecard, decisions, and merges that can be undone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import normal_address, normal_name
from quillon.session import cut

MATCH, POSSIBLE, SURE, MARGIN = 0.90, 0.15, 0.60, 0.25


def block(left: DataFrame, right: DataFrame, rules: list[tuple[Column, Column]], left_id: str, right_id: str) -> DataFrame:
    """Distinct candidate pairs that agree in at least one blocking key; null keys block nothing.

    Every rule is an equi-join on one exploded key column, so one shuffle serves all rules.
    """

    def keyed(df: DataFrame, row_id: str, columns: list[Column], name: str) -> DataFrame:
        keys = F.array(*(F.struct(F.lit(i).alias("rule"), c.cast("string").alias("key")) for i, c in enumerate(columns)))
        return df.select(F.col(row_id).alias(name), F.explode(keys).alias("k")).select(name, "k.rule", "k.key").filter("key is not null and key <> ''")

    a = keyed(left, left_id, [x for x, _ in rules], "left_id")
    b = keyed(right, right_id, [y for _, y in rules], "right_id")
    return a.join(b, ["rule", "key"]).select("left_id", "right_id").distinct()


def scorecard(terms: list[tuple[str, Column, float]], penalties: list[tuple[str, Column, float]] = ()) -> tuple[Column, Column]:
    """(score in [0, 1], reasons) of named conditions and weights."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    total = reduce(lambda a, b: a + b, (F.when(holds(c), w).otherwise(0.0) for _, c, w in terms))
    for _, c, w in penalties:
        total = total - F.when(holds(c), w).otherwise(0.0)
    reasons = F.array_compact(F.array(*(F.when(holds(c), F.lit(n)) for n, c, _ in [*terms, *penalties])))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4), reasons


def decide(scored: DataFrame, candidate: str, person: str, score: str) -> DataFrame:
    """(candidate, decision, person, best, competing): one row per candidate with at least one scored pair.

    MATCH: a sure score, clear of the next and unique. AMBIGUOUS: several share the best, or two are sure and close.
    POSSIBLE_MATCH: above the floor. NO_MATCH otherwise. Ties go by person id.
    """
    w = Window.partitionBy(candidate).orderBy(F.col(score).desc(), F.col(person))
    rows = scored.withColumn("__rn", F.row_number().over(w)).withColumn("__next", F.lead(score).over(w)).withColumn("__top", F.max(score).over(Window.partitionBy(candidate)))
    by = rows.groupBy(candidate).agg(
        F.min_by(person, "__rn").alias("__person"), F.max(score).alias("best"), F.coalesce(F.min_by("__next", "__rn"), F.lit(0.0)).alias("__second"),
        F.sum((F.col(score) == F.col("__top")).cast("int")).alias("__ties"),
        F.array_sort(F.collect_set(F.when(F.col(score) >= POSSIBLE, F.col(person)))).alias("__all"),
    )
    margin = F.col("best") - F.col("__second")
    decision = (
        F.when((F.col("best") >= MATCH) & (margin >= MARGIN) & (F.col("__ties") == 1), "MATCH")
        .when(((F.col("__ties") >= 2) & (F.col("best") >= POSSIBLE)) | ((F.col("best") >= SURE) & (margin < MARGIN) & (F.col("__second") >= SURE)), "AMBIGUOUS")
        .when(F.col("best") >= POSSIBLE, "POSSIBLE_MATCH")
        .otherwise("NO_MATCH")
    )
    matched = F.when(decision.isin("MATCH", "POSSIBLE_MATCH"), F.col("__person"))
    competing = F.when(matched.isNotNull(), F.array_except("__all", F.array("__person"))).otherwise(F.col("__all"))
    return by.select(candidate, decision.alias("decision"), matched.alias(person), "best", competing.alias("competing"))


def through_merges(df: DataFrame, person: str, merges: DataFrame) -> DataFrame:
    """``df`` with ``person`` replaced by the person its row was merged into, where the merge is active.

    merges: loser, winner, active. Nothing is rewritten: dropping or deactivating a row undoes a merge.
    """
    live = merges.filter("active").select(F.col("loser").alias(person), F.col("winner").alias("__winner"))
    joined = df.join(live, person, "left")
    return joined.withColumn(person, F.coalesce("__winner", person)).select(*df.columns)


def check_merge(merges: DataFrame, loser: str, winner: str) -> None:
    """Refuse a merge of a person into itself or of one already merged."""
    if loser == winner:
        raise ValueError("a person can't be merged into itself")
    if not merges.filter(F.col("active") & (F.col("loser") == loser)).isEmpty():
        raise ValueError(f"{loser} is merged already")


def live_ids(person: DataFrame, key: str = "person_id", into: str = "merged_into_id") -> DataFrame:
    """(person_id, live_id): the live person each row stands for, through merges of any length.

    Chains are halved in every round, so the rounds are the logarithm of the longest one. People merged in a circle, or
    into themselves, stand for themselves; people with a null key are left out.
    """
    people = person.select(F.col(key).alias("person_id"), F.col(into).alias("live_id")).filter("person_id is not null")
    step = cut(people.filter("live_id is not null and live_id <> person_id").groupBy("person_id").agg(F.min("live_id").alias("live_id")))
    onward = lambda: step.select(F.col("person_id").alias("live_id"), F.col("live_id").alias("__next"))
    for _ in range(step.count().bit_length()):
        if step.join(onward(), "live_id", "left_semi").isEmpty():
            break
        step = cut(step.join(onward(), "live_id", "left").select("person_id", F.coalesce("__next", "live_id").alias("live_id")))
    circle = step.join(onward(), "live_id", "left_semi").select("person_id", F.lit(True).alias("__circle"))
    ends = step.join(circle, "person_id", "left").select("person_id", F.when(F.col("__circle"), F.col("person_id")).otherwise(F.col("live_id")).alias("__live"))
    return people.select("person_id").distinct().join(ends, "person_id", "left").select("person_id", F.coalesce("__live", "person_id").alias("live_id"))


#: Weights of a candidate's agreement with a person: fixed values.
LINKEDIN, PROVIDER_ID, EMAIL, GITHUB, NAME, NAME_SUBSET = 0.55, 0.50, 0.42, 0.35, 0.20, 0.08
EMPLOYER_EACH, EMPLOYER_CAP, EDUCATION, GEOGRAPHY, OTHER_EMPLOYER = 0.18, 0.32, 0.12, 0.06, -0.15
#: Score from which a single possible match of a monitored subject is attached: fixed value.
ATTACH = 0.5


def employers(jobs: DataFrame, organization: DataFrame) -> DataFrame:
    """(person_id, employers): names of all employers, lower case; at most as many as there are organisations."""
    o = organization.select("organization_id", F.nullif(F.lower(F.trim("canonical_name")), F.lit("")).alias("e")).filter("e is not null")
    return jobs.join(o, "organization_id").groupBy("person_id").agg(F.array_sort(F.collect_set("e")).alias("employers"))


def alias_map(aliases: DataFrame) -> DataFrame:
    """(person_id, aliases): values by alias type, lower case; a person's own few."""
    kept = aliases.select("person_id", "alias_type", F.lower("alias_value").alias("v")).filter("person_id is not null and v is not null and v <> '' and alias_type is not null")
    by = kept.groupBy("person_id", "alias_type").agg(F.array_sort(F.collect_set("v")).alias("v"))
    return by.groupBy("person_id").agg(F.map_from_entries(F.collect_list(F.struct("alias_type", "v"))).alias("aliases"))


def scored_pairs(candidates: DataFrame, people: DataFrame, aliases: DataFrame, jobs: DataFrame, education: DataFrame | None = None) -> DataFrame:
    """(candidate_id, person_id, score, reasons): every pair that shares an address, an alias or a normalised name.

    candidates: candidate_id, name, linkedin_url, email, github_username, provider_ids, current_employer, prior_employers,
    geography, education (arrays where plural). people: person_id, canonical_name, primary_linkedin_url, primary_email,
    primary_location, live ones. aliases: person_id, alias_type, alias_value. jobs: person_id, employers. education: person_id,
    schools. reasons maps the terms that hold to their weights; a name alone stays below every threshold.
    """
    none = F.array().cast("array<string>")
    texts = lambda c: F.filter(F.transform(F.coalesce(c, none), lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != ""))
    c = candidates.select(
        "candidate_id", normal_address(F.col("linkedin_url")).alias("c_url"), F.lower("email").alias("c_mail"), F.lower("github_username").alias("c_git"), texts(F.col("provider_ids")).alias("c_ids"),
        normal_name(F.coalesce("name", F.lit(""))).alias("c_name"), F.nullif(F.lower(F.trim("current_employer")), F.lit("")).alias("c_employer"), texts(F.col("prior_employers")).alias("c_prior"),
        F.lower(F.trim(F.split("geography", ",")[0])).alias("c_place"), texts(F.col("education")).alias("c_schools"),
    )
    c = c.withColumn("c_employers", F.array_distinct(F.array_compact(F.array_append("c_prior", F.col("c_employer")))))
    p = people.select("person_id", normal_address(F.col("primary_linkedin_url")).alias("p_url"), F.lower("primary_email").alias("p_mail"), normal_name(F.coalesce("canonical_name", F.lit(""))).alias("p_name"), F.lower("primary_location").alias("p_place"))
    p = p.join(alias_map(aliases), "person_id", "left").join(jobs.select("person_id", "employers"), "person_id", "left")
    p = p.join(education.select("person_id", "schools"), "person_id", "left") if education is not None else p.withColumn("schools", none)
    flat = aliases.select("person_id", F.lower("alias_value").alias("key"))
    keyed = lambda df, rule, key, name: df.select(F.col(name), F.lit(rule).alias("rule"), key.alias("key"))
    said = c.select("candidate_id", F.explode(F.array_distinct(F.concat(F.array_compact(F.array("c_url", "c_git", "c_mail")), "c_ids"))).alias("key"))
    left = keyed(c, "url", F.col("c_url"), "candidate_id").union(keyed(c, "name", F.col("c_name"), "candidate_id")).union(keyed(said, "alias", F.col("key"), "candidate_id"))
    right = keyed(p, "url", F.col("p_url"), "person_id").union(keyed(p, "name", F.col("p_name"), "person_id")).union(keyed(flat.join(p, "person_id", "left_semi"), "alias", F.col("key"), "person_id"))
    held = lambda df: df.filter("key is not null and key <> ''")
    pairs = held(left).join(held(right), ["rule", "key"]).select("candidate_id", "person_id").distinct()
    j = pairs.join(c, "candidate_id").join(p, "person_id")
    alias = lambda kind: F.coalesce(F.try_element_at("aliases", F.lit(kind)), none)
    sure = lambda x: F.coalesce(x, F.lit(False))
    words = lambda n: F.split(n, " ")
    both = (F.col("c_name") != "") & (F.col("p_name") != "")
    same = both & (F.col("c_name") == F.col("p_name"))
    subset = both & ~same & ((F.size(F.array_except(words("c_name"), words("p_name"))) == 0) | (F.size(F.array_except(words("p_name"), words("c_name"))) == 0))
    shared = F.size(F.array_intersect("c_employers", F.coalesce("employers", none)))
    exact = {
        "linkedin_url_exact": (sure(F.col("c_url") == F.col("p_url")) | sure(F.array_contains(alias("LINKEDIN_URL"), F.col("c_url"))), LINKEDIN),
        "provider_id_exact": (F.arrays_overlap("c_ids", alias("PROVIDER_ID")), PROVIDER_ID),
        "github_exact": (sure(F.array_contains(alias("GITHUB_USERNAME"), F.col("c_git"))), GITHUB),
        "email_exact": (sure((F.col("c_mail") == F.col("p_mail")) & (F.col("c_mail") != "")) | sure(F.array_contains(alias("EMAIL"), F.col("c_mail"))), EMAIL),
        "name_exact": (same, NAME),
    }
    any_exact = reduce(lambda a, b: a | b, (sure(t) for t, _ in exact.values()))
    other = sure(F.col("c_employer").isNotNull() & (F.size(F.coalesce("employers", none)) > 0) & (shared == 0)) & ~any_exact
    rest = {
        "name_subset": (subset, F.lit(NAME_SUBSET)), "employer_overlap": (shared > 0, F.least(F.lit(EMPLOYER_CAP), EMPLOYER_EACH * shared)), "different_current_employer": (other, F.lit(OTHER_EMPLOYER)),
        "education_overlap": (F.arrays_overlap("c_schools", F.coalesce("schools", none)), F.lit(EDUCATION)), "geography_match": (sure(F.col("p_place").contains(F.col("c_place"))), F.lit(GEOGRAPHY)),
    }
    terms = {k: (sure(t), F.lit(w)) for k, (t, w) in exact.items()} | {k: (sure(t), w) for k, (t, w) in rest.items()}
    total = reduce(lambda a, b: a + b, (F.when(t, w).otherwise(0.0) for t, w in terms.values()))
    reasons = F.map_from_entries(F.array_compact(F.array(*(F.when(t, F.struct(F.lit(k).alias("k"), F.round(w, 4).alias("v"))) for k, (t, w) in terms.items()))))
    return j.select("candidate_id", "person_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)) + 1e-9, 4).alias("score"), reasons.alias("reasons"))


def audit(decisions: DataFrame) -> DataFrame:
    """The decisions that are kept for review: all but NO_MATCH."""
    return decisions.filter("decision <> 'NO_MATCH'")


def attached(decisions: DataFrame, person: str) -> DataFrame:
    """Decisions of a monitored subject's resolution with ``attach``: 'review' for an ambiguous one, 'person' for a match or
    for a possible one that is likely enough or without competitors, else 'new'."""
    possible = (F.col("decision") == "POSSIBLE_MATCH") & ((F.col("best") >= ATTACH) | (F.size("competing") == 0))
    fits = F.col(person).isNotNull() & ((F.col("decision") == "MATCH") | possible)
    return decisions.withColumn("attach", F.when(F.col("decision") == "AMBIGUOUS", "review").when(fits, "person").otherwise("new"))

"""The models on a small world: golden scores, access, confidence, resolution and discovery."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon.operators import bundles, config, extraction, modelrun, resolve, rules, scoring
from quillon.plans import model_queries, models

AS_OF = datetime(2026, 9, 6, 23, 59, 59)
WHEN = datetime(2026, 8, 1)


def at():
    return F.lit("2026-09-06 23:59:59").cast("timestamp_ntz")


THESIS = {"sectors": ["inference", "robotics"], "technologies": ["inference infrastructure"], "technical_topics": ["gpu"], "business_models": ["open core"], "stages": ["seed"], "geographies": ["Canada"]}


def world(spark, people, facts=(), jobs=(), organizations=(), events=(), inferences=(), edges=(), classes=(), feedback=(), roles=(), thesis=THESIS):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return bundles.World(
        make([(p, p, s, "ACTIVE_MONITORING", seed) for p, s, seed in people], "person_id string, canonical_name string, entity_resolution_status string, monitoring_status string, is_team_seed boolean"),
        make([(f"{p}:{t}:{i}", p, t, (st, None if v is None else str(v), None), WHEN, WHEN, 0.9, None, None) for i, (p, t, v, st) in enumerate(facts)],
             "fact_id string, person_id string, fact_type string, value struct<status:string,value:string,unit:string>, valid_from timestamp_ntz, created_at timestamp_ntz, extraction_confidence double, strength double, provider string"),
        make(jobs, "person_id string, organization_id string, function string, seniority string, started_at date, ended_at date, current boolean"),
        make(organizations, "organization_id string, canonical_name string, organization_type string, location string, aum_usd decimal(20,2), is_portfolio boolean, attributes struct<sector:string,sectors:array<string>,stage:string>"),
        make(events, "person_id string, event_type string, occurred_at timestamp_ntz, detected_at timestamp_ntz, confidence double"),
        make(inferences, "person_id string, inference_type string, probability double, created_at timestamp_ntz, expires_at timestamp_ntz"),
        make(edges, "src string, dst string, strength int, confidence double, verified timestamp_ntz"),
        make(classes, "person_id string, person_class string"),
        make(feedback, "connector_person_id string, feedback_type string"),
        make(roles, "role_id string, function string, seniority string, domains array<string>, stages array<string>, metro string, country string, remote_ok boolean"),
        thesis,
    )


SARAH = [("sarah", "HEADLINE_TEXT", "Staff ML Engineer - inference infrastructure", "known"), ("sarah", "YEARS_DOMAIN_EXPERIENCE", 5.4, "known"), ("sarah", "YEARS_ENGINEERING_EXPERIENCE", 8.0, "known"), ("sarah", "PRIOR_FOUNDER", "true", "known"),
         ("sarah", "PRODUCT_SHIPPED", "true", "known"), ("sarah", "PROMOTION_COUNT", 2, "known"), ("sarah", "FUNDRAISING_STATUS", None, "unknown"), ("sparse", "HEADLINE_TEXT", "Engineer", "known")]
PEOPLE = [("sarah", "RESOLVED", False), ("sparse", "NEEDS_REVIEW", False), ("seed", "RESOLVED", True), ("far", "UNRESOLVED", False)]


def test_founder_scores_add_up(spark):
    w = world(spark, PEOPLE, SARAH, events=[("sparse", "EMPLOYMENT_ENDED", datetime(2026, 8, 31), WHEN, 0.9), ("far", "EMPLOYMENT_ENDED", datetime(2026, 1, 1), WHEN, 0.9)],
              inferences=[("sparse", "POSSIBLE_COMPANY_FORMATION", 0.74, WHEN, None)], edges=[("seed", "sarah", 2, 0.85, datetime(2026, 8, 1))])
    model = config.parse(models.FOUNDER)
    rows = {r.person_id: r for r in model_queries.run(w, "founder", at()).collect()}
    s = rows["sarah"]
    # Quality by hand: known weights and those that count as zero; unknown features are left out of the denominator.
    have = {"prior_founder": (0.10, 1 / 3), "product_shipped": (0.08, 1), "years_domain_experience": (0.09, 5.4 / 8), "years_engineering_experience": (0.07, 0.8), "promotions": (0.04, 0.5)}
    zero = 0.15 + 0.09 + 0.06 + 0.04 + 0.04 + 0.04 + 0.03 + 0.03
    assert s.dim_quality == pytest.approx(100 * sum(w_ * v for w_, v in have.values()) / (sum(w_ for w_, _ in have.values()) + zero), abs=0.01)
    assert s.access == 75 * 0.85 and s.timing == 0.0
    assert s.priority == pytest.approx(0.35 * s.quality + 0.25 * s.fit + 0.15 * s.access, abs=0.01)
    assert 0 <= s.confidence <= 1 and "years_domain_experience" in rows["sparse"].missing and "fundraising_status" not in s.missing
    assert rows["seed"].access == 100 and rows["far"].access == 0 and rows["sparse"].timing > rows["far"].timing > 0
    assert set(s.missing) >= {"org_built_team_size", "early_employee_rank", "thesis_embedding_similarity"}
    assert model.full_version == "founder_v0.1"


def test_paths_and_their_scores(spark):
    people = [(p, "RESOLVED", p == "seed") for p in ("seed", "a", "b", "c", "t", "two", "unknown", "alone")]
    fresh, old = datetime(2026, 9, 1), datetime(2026, 9, 6, 23, 59, 59) - timedelta(days=365 + 60)
    edges = [("seed", x, 2, 0.85, fresh) for x in "abc"] + [(x, "t", 3, 0.85, fresh) for x in "abc"] + [("seed", "t", 2, 0.85, fresh), ("seed", "unknown", 0, None, None), ("a", "two", 3, None, old)]
    got = {r.person_id: r for r in modelrun.access_of(world(spark, people, edges=edges), models.ACCESS, at()).collect()}
    assert got["t"].access == 70.55 and got["t"].routes == 4 and got["seed"].access == 100.0 and got["alone"].access == 0.0 and got["unknown"].access is None
    assert got["two"].access == pytest.approx((30 - 8) * 0.85, abs=0.01)
    # Without anybody of the team all is known to be zero.
    nobody = world(spark, [("a", "RESOLVED", False)], edges=[("a", "b", 3, None, None)])
    assert [r.access for r in modelrun.access_of(nobody, models.ACCESS, at()).collect()] == [0.0]


ORGS = [("o1", "Acme Robotics", "family_office", "Paris, FR", Decimal("2500000000"), True, ("Robotics", ["robotics", "Vision"], "Seed")), ("o2", "Blank", None, None, None, None, None)]


def test_lp_talent_and_connector(spark):
    people = [("p", "RESOLVED", False), ("q", "MERGED", True), ("r", "UNRESOLVED", False)]
    facts = [("p", "CURRENT_TITLE", "Chief Investment Officer and Partner", "known"), ("p", "LOCATION", "Greater Paris", "known"), ("r", "LOCATION", "Oslo", "known"), ("p", "PROMOTION_COUNT", "x", "known")]
    jobs = [("p", "o1", "engineering", "VP", date(2020, 9, 6), None, True), ("p", "o2", None, "Founder", date(2000, 1, 1), None, True), ("r", "o2", "product", "ic", None, None, True)]
    roles = [("r2", "engineering", "vp", ["robotics", "payments"], ["seed"], "paris", "FR", False), ("r1", "engineering", "vp", ["robotics", "payments"], ["seed"], "paris", "FR", False), ("r3", "operations", "ic", [], [], "", "", True)]
    w = world(spark, people, facts, jobs, ORGS, events=[("p", "CIO_ROLE_STARTED", AS_OF, WHEN, 0.8), ("p", "OPEN_TO_WORK_SIGNAL", None, WHEN, 0.8)], edges=[("p", "q", 1, None, datetime(2026, 1, 1)), ("p", "q", 3, None, None), ("p", "r", 2, None, None)],
              classes=[("r", "FOUNDER"), ("r", "LP"), ("q", "PORTFOLIO_EXECUTIVE")], feedback=[("p", "MEETING_BOOKED"), ("p", "NOTE")], roles=roles, thesis={"geographies": ["paris"]})
    lp = {r.person_id: r for r in model_queries.run(w, "lp", at()).collect()}
    assert lp["p"].dim_authority == 44.0 and lp["p"].dim_timing == 100.0 and lp["p"].dim_capital_relevance == pytest.approx(100 * (0.45 + 0.35 * 0.5)) and lp["p"].dim_house_fit == pytest.approx(100 * (0.8 * 0.4 + 0.2))
    assert lp["r"].disclosed_aum is None and lp["q"].dim_house_fit == 0.0 and lp["q"].stage_fit is None
    c = {r.person_id: r for r in model_queries.run(w, "connector", at()).collect()}
    assert (c["p"].relevant_connections, c["p"].founder_connectivity, c["p"].lp_connectivity, c["p"].portfolio_connectivity, c["p"].independent_path_count) == (2, 1, 1, 1, 1)
    assert c["p"].fresh_edge_share == 0.3333 and c["p"].successful_intros == 1 and c["r"].fresh_edge_share == 0.0 and c["r"].distinct_sectors == 2
    t = {r.person_id: r for r in model_queries.run(w, "talent", at()).collect()}
    p = t["p"]
    assert p.role_id == "r1" and p.dim_functional == 100.0 and p.dim_domain == 50.0 and p.dim_stage_experience == 100.0 and p.dim_location == 100.0 and p.dim_availability_timing == 100.0
    assert p.dim_seniority == 40.0  # a founder's rank is two above a vice president's
    assert p.dim_operating_experience == 75.0 and t["q"].dim_functional == 0.0
    # Without open roles nobody has a talent score; without a thesis the founder's fit is unknown.
    assert model_queries.run(world(spark, people), "talent", at()).count() == 0
    assert {r.sector_match for r in model_queries.run(world(spark, people, thesis=None), "founder", at()).collect()} == {None}


def test_confidence_components(spark):
    kind = "array<struct<fact_id:string,at:timestamp_ntz,extraction:double,strength:double,provider:string>>"
    df = spark.createDataFrame([(1, []), (2, [("a", AS_OF, 0.8, 0.7, "x"), ("b", AS_OF - timedelta(days=100), 0.6, 0.9, "x"), ("c", AS_OF, None, None, None)])], f"id int, feeding {kind}")
    got = {r.id: r for r in df.select("id", *(c.alias(n) for n, c in scoring.evidence_components(F.col("feeding"), at()).items())).collect()}
    assert tuple(got[1])[1:] == (0.5, 0.5, 0.5, 1.0)
    assert tuple(got[2])[1:] == (0.8, 0.75, round((2 + 2.718281828 ** -0.5) / 3, 4), 0.7)


def test_configurations(tmp_path):
    for raw in models.MODELS.values():
        m = config.parse(raw)
        assert m.hash == config.parse(json.loads(json.dumps(raw))).hash
    bad = [
        {**models.FOUNDER, "priority": {"quality": 0.5}}, {**models.FOUNDER, "priority": {"nothing": 1.0}}, {k: v for k, v in models.FOUNDER.items() if k != "target"},
        {"name": "m", "version": "1", "target": "lp", "priority": {"q": 1}, "dimensions": {"q": {"kind": "other"}}}, {"name": "m", "version": "1", "target": "lp", "priority": {"q": 1}, "dimensions": {"q": {"features": {"a": {"normalization": "no"}}}}},
        {"name": "m", "version": "1", "target": "lp", "priority": {"q": 1}, "dimensions": {"q": {"features": {"a": {"missing_behavior": "no"}}}}}, {"name": "m", "version": "1", "target": "lp", "priority": {"q": 1}, "dimensions": {"q": {"features": {"gender": {}}}}},
    ]
    for raw in bad:
        with pytest.raises(ValueError):
            config.parse(raw)
    (tmp_path / "m.json").write_text(json.dumps(models.LP))
    (tmp_path / "other.json").write_text(json.dumps(models.ACCESS))
    assert list(config.models(tmp_path)) == ["lp"]
    with pytest.raises(ValueError):
        bundles.build("talent", None, [])
    with pytest.raises(KeyError):
        bundles.build("nobody", None, [])


def resolved(spark, people, candidate):
    none = []
    c = spark.createDataFrame([("c", candidate.get("name"), candidate.get("url"), candidate.get("email"), candidate.get("git"), candidate.get("ids", none), candidate.get("employer"), candidate.get("prior", none), candidate.get("place"), candidate.get("schools", none))],
                              "candidate_id string, name string, linkedin_url string, email string, github_username string, provider_ids array<string>, current_employer string, prior_employers array<string>, geography string, education array<string>")
    p = spark.createDataFrame([(str(i), n, u, m, loc) for i, (n, u, m, loc, _, _) in enumerate(people)], "person_id string, canonical_name string, primary_linkedin_url string, primary_email string, primary_location string")
    jobs = spark.createDataFrame([(str(i), e) for i, (*_, e, _) in enumerate(people)], "person_id string, employers array<string>")
    al = spark.createDataFrame([(str(i), k, v) for i, (*_, a) in enumerate(people) for k, v in a] or [("-", "EMAIL", None)], "person_id string, alias_type string, alias_value string")
    schools = spark.createDataFrame([("0", ["mit"])], "person_id string, schools array<string>")
    pairs = resolve.scored_pairs(c, p, al, jobs, schools)
    d = resolve.attached(resolve.decide(pairs, "candidate_id", "person_id", "score"), "person_id").collect()
    return d[0] if d else None, {r.person_id: (r.score, r.reasons) for r in pairs.collect()}


def test_golden_identities(spark):
    lee = [("Alex Lee", "linked.example/in/alex-lee-s", None, None, ["s"], []), ("Alex Lee", "linked.example/in/alex-lee-g", None, None, ["g"], [])]
    d, _ = resolved(spark, lee, {"name": "Alex Lee"})
    assert (d.decision, d.person_id, sorted(d.competing), d.attach) == ("AMBIGUOUS", None, ["0", "1"], "review")
    dana = [("Dana Reyes", "linked.example/in/dana-reyes", "d@x.example", "Lyon, FR", ["acme"], [])]
    d, s = resolved(spark, dana, {"name": "Dana Reyes", "url": "https://www.linked.example/in/dana-reyes/", "employer": "Acme"})
    assert (d.decision, d.person_id, d.best, d.attach) == ("MATCH", "0", 0.93, "person") and s["0"][1] == {"linkedin_url_exact": 0.55, "name_exact": 0.2, "employer_overlap": 0.18}
    d, _ = resolved(spark, [("Jordan Diaz", None, None, None, ["cirrus"], [])], {"name": "Jordan Diaz"})
    assert (d.decision, d.best, d.attach) == ("POSSIBLE_MATCH", 0.2, "person")
    assert resolved(spark, dana, {"name": "Brand New"})[0] is None and resolved(spark, dana, {})[0] is None
    # Each other term, and the penalty where nothing exact agrees.
    alias = [("Dana A Reyes", None, None, "Lyon, FR", ["acme", "bolt"], [("PROVIDER_ID", "X9"), ("GITHUB_USERNAME", "dr"), ("EMAIL", "D@old.example")])]
    _, s = resolved(spark, alias, {"name": "Dana Reyes", "git": "DR", "email": "d@OLD.example", "ids": ["x9"], "prior": ["Acme", "BOLT"], "place": "Lyon area, FR", "schools": ["MIT"]})
    assert s["0"][0] == 1.0 and s["0"][1] == {"provider_id_exact": 0.5, "github_exact": 0.35, "email_exact": 0.42, "name_subset": 0.08, "employer_overlap": 0.32, "education_overlap": 0.12}
    _, s = resolved(spark, [("Dana Reyes", None, None, "Greater Lyon", ["acme"], [("PROVIDER_ID", "z")])], {"name": "Reyes Dana Maria", "git": "z", "employer": "Other", "place": "lyon, FR"})
    assert s["0"] == (0.0, {"name_subset": 0.08, "different_current_employer": -0.15, "geography_match": 0.06}) or s["0"][1] == {"different_current_employer": -0.15, "geography_match": 0.06, "name_subset": 0.08}


def test_discovery_rules(spark):
    rule = {"keywords": ["stealth", "robot"], "titles": ["founder"], "excluded_keywords": ["recruiter"], "required_events": ["EMPLOYMENT_ENDED"], "min_signals": 3}
    rows = [("Robot founder", ["EMPLOYMENT_ENDED", "OTHER"]), ("Robot founder", ["OTHER"]), ("Robot founder, recruiter", ["EMPLOYMENT_ENDED"]), ("robot", ["EMPLOYMENT_ENDED"]), (None, ["EMPLOYMENT_ENDED"]), ("", None)]
    df = spark.createDataFrame(rows, "t string, e array<string>")
    holds, reasons, signals = rules.rule_match(F.col("t"), F.col("e"), rule)
    got = [tuple(r) for r in df.select(holds, reasons, signals).collect()]
    assert [g[0] for g in got] == [True, False, False, False, False, False]
    assert got[0][1:] == (["keywords:robot", "titles:founder", "events:EMPLOYMENT_ENDED"], 3)
    first = rules.first_rule(df, "t", "e", [{"name": "off", "active": False, "keywords": ["robot"]}, {"name": "a", "keywords": ["robot"]}, {"name": "b", "titles": ["founder"]}])
    assert {r.rule for r in first.collect()} == {"a"} and rules.first_rule(df, "t", "e", []).count() == 0
    assert config.discovery_rules([{"name": "x", "keywords": ["k"], "minimum_evidence": {"min_signals": 2, "require_any_event_types": ["E"]}}, {"name": "y", "active": False}]) == [
        {"name": "x", "target_class": None, "keywords": ["k"], "technical_topics": [], "titles": [], "excluded_keywords": [], "required_events": ["E"], "min_signals": 2}]


def test_extraction_by_content(spark):
    doc = json.dumps
    rows = [
        ("first", "profile_snapshot", None, doc({"observed_on": "2026-01-02", "profile": {"headline": "Eng", "current_title": "Eng", "patent_count": 3, "prior_exit": False, "location": ""}}), None),
        ("pair", "profile_snapshot", None, doc(doc({"current_company": "B"})), doc({"current_company": "A"})),
        ("fact", "csv_row", "has left Acme after ten years at the firm", doc({"fact_type": "PATENT_COUNT", "value": {"value": 4, "status": "known", "unit": "count"}, "confidence": "0.5"}), None),
        ("raw", "json_record", None, doc({"fact_type": "PATENT_COUNT", "raw_value": "7", "unit": "n", "occurred_at": "2026-03-04T00:00:00"}), None),
        ("none", "json_record", None, doc({"fact_type": "PATENT_COUNT", "value": None}), None),
        ("event", "json_record", None, doc({"event_type": "PROMOTION", "organization_name": "Acme"}), None),
        ("guess", "json_record", None, doc({"event_type": "STEALTH_COMPANY_SIGNAL", "probability": 0.4}), None),
        ("text", "news_article", None, doc({"title": "Ann", "summary": "Ann has left Acme after ten years at the firm."}), None),
        ("broken", "profile_snapshot", "has left Acme after ten years at the firm", "{", None),
        ("empty", None, None, None, None),
    ]
    o = spark.createDataFrame([(i, c, "Ann", t, j, b) for i, c, t, j, b in rows], "observation_id string, content_type string, subject_hint string, raw_text string, raw_json string, previous_snapshot string")
    got = {}
    for r in extraction.extracted(o, ["observation_id"]).collect():
        got.setdefault(r.observation_id, {})[(r.kind, r.name)] = r
    assert {k[1]: r.value for k, r in got["first"].items()} == {"HEADLINE_TEXT": "Eng", "PATENT_COUNT": "3", "PRIOR_EXIT": "false", "FUNDRAISING_STATUS": None}
    assert {r.occurred for r in got["first"].values()} == {datetime(2026, 1, 2)} and got["first"][("fact", "PATENT_COUNT")].unit == "count"
    assert ("event", "EMPLOYMENT_ENDED") in got["pair"] and ("event", "EMPLOYMENT_STARTED") in got["pair"]
    f = got["fact"][("fact", "PATENT_COUNT")]
    assert (f.value, f.unit, f.confidence, len(got["fact"])) == ("4", "count", 0.5, 1)
    assert got["raw"][("fact", "PATENT_COUNT")].value == "7" and got["raw"][("fact", "PATENT_COUNT")].occurred == datetime(2026, 3, 4) and got["none"][("fact", "PATENT_COUNT")].value is None
    assert got["event"][("event", "PROMOTION")].organization == "Acme" and got["guess"][("inference", "STEALTH_COMPANY_SIGNAL")].confidence == 0.4
    assert set(got["text"]) == {("event", "NEWS_MENTION"), ("event", "EMPLOYMENT_ENDED"), ("fact", "EMPLOYMENT_ENDED_AT")} and got["text"][("event", "EMPLOYMENT_ENDED")].organization == "Acme"
    assert "broken" not in got and "empty" not in got

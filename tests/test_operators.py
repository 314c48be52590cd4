"""Functions, rules, events, resolution, graph, scores, measures, sources, sinks and streams on small tables."""

from __future__ import annotations

import json
import math
import random
from datetime import date, datetime, timedelta

import parity
import pytest
from pyspark.sql import functions as F

from quillon.functions import numbers, text, values
from quillon.operators import events, features, graph, ingest, metrics, ranking, resolve, rules, scoring, timeline
from quillon.sources import readers, writers
from quillon.streaming import observations

D0 = datetime(2026, 9, 6)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


NORMAL = [
    ("binary", 1.0, {}, 1), ("binary", 0.0, {}, 0), ("capped_count", 0.0, {"max": 3}, 0), ("capped_count", 2.0, {"max": 3}, 0.6667), ("capped_count", 5.0, {"max": 3}, 1),
    ("linear_cap", 25.0, {"divisor": 50}, 0.5), ("linear_cap", 100.0, {"divisor": 50}, 1), ("linear_cap", -5.0, {"divisor": 50}, 0), ("min_ratio", 6.4, {"target": 8}, 0.8),
    ("min_ratio", 20.0, {"target": 8}, 1), ("min_ratio", 3.0, {"target": 6, "invert": True}, 0.5), ("min_ratio", 9.0, {"target": 6, "invert": True}, 0), ("exp_decay", 45.0, {"half_life": 45}, 0.5),
    ("exp_decay", 0.0, {"half_life": 45}, 1), ("exp_decay", 90.0, {"lambda": math.log(2) / 45}, 0.25), ("tiered", "exact", {"tiers": {"exact": 1.0, "adjacent": 0.6}}, 1),
    ("tiered", "adjacent", {"tiers": {"exact": 1.0, "adjacent": 0.6}}, 0.6), ("tiered", "other", {"tiers": {"exact": 1.0}}, 0), ("bucket", 5.0, {"thresholds": [10, 50, 200], "values": [1, 0.7, 0.4, 0.1]}, 1),
    ("bucket", 40.0, {"thresholds": [10, 50, 200], "values": [1, 0.7, 0.4, 0.1]}, 0.7), ("bucket", 500.0, {"thresholds": [10, 50, 200], "values": [1, 0.7, 0.4, 0.1]}, 0.1), ("passthrough_unit", 1.5, {}, 1), ("passthrough_unit", -0.2, {}, 0),
]


def test_normalizers_at_their_bounds(spark):
    row = spark.range(1).select(*(F.round(numbers.normalized(n, F.lit(v), p), 4).alias(f"c{i}") for i, (n, v, p, _) in enumerate(NORMAL))).first()
    assert list(row) == [pytest.approx(want, abs=1e-4) for *_, want in NORMAL]
    assert one(spark, numbers.normalized("linear_cap", F.lit(None).cast("double"), {"divisor": 2})) is None
    with pytest.raises(ValueError):
        numbers.normalized("nothing", F.lit(1.0))


@pytest.mark.parametrize(("a", "b", "want"), [("Staff Engineer at X", "staff engineer at x.", False), ("Staff Engineer at X", "Senior Staff Engineer at X", False), ("Staff ML Engineer at Synthetic AI Labs", "Building", True), (None, None, False)])
def test_headline_change(spark, a, b, want):
    assert one(spark, text.material_change(F.lit(a).cast("string"), F.lit(b).cast("string"))) is want


def test_text_functions(spark):
    assert one(spark, text.normal_name(F.lit(" J.-P.  O'Neil "))) == "j p o neil"
    assert one(spark, text.normal_address(F.lit("https://www.Host.example/in/x/?a=1"))) == "host.example/in/x"
    assert one(spark, text.normal_address(F.lit(" "))) is None
    assert one(spark, text.domain(F.lit("https://www.a.example:80/x"))) == "a.example:80" and one(spark, text.domain(F.lit("no url"))) is None
    assert one(spark, text.story_key(F.lit("Acme raises funding round today"))) == one(spark, text.story_key(F.lit("Today: ACME raises funding round!")))
    assert one(spark, text.snippet(F.lit("x" * 100 + "needle" + "y" * 200), ["absent", "NEEDLE".lower()])).startswith("x" * 39 + "needle"[:0])
    assert one(spark, text.titled_name(F.lit("Jane Doe - Founder at Acme | Site"), F.lit("https://s.example/in/jane"))) == "Jane Doe"
    for title, url in (("jane doe - x", "/in/"), ("Jane - x", "/in/"), ("Jane Doe - x", "/company/"), ("Jane 3 Doe - x", "/in/"), ("A B C D E F - x", "/in/"), ("", "/in/")):
        assert one(spark, text.titled_name(F.lit(title), F.lit(url))) is None
    assert one(spark, text.listed(F.lit("['New York', \"USA\"]"))) == "New York, USA"
    assert one(spark, text.clean_org(F.lit(" ,Acme  Labs. "))) == "Acme Labs"
    assert one(spark, text.hits(F.lit("A Clinic"), ["clinic", "lab"])) == ["clinic"] and one(spark, text.hits(F.lit(None).cast("string"), ["x"])) == []


def test_values(spark):
    assert one(spark, values.is_unknown(values.known(F.lit(None).cast("string")))) is True and one(spark, values.is_unknown(values.known(F.lit(0)))) is False
    canon = lambda s: one(spark, values.canonical_json(F.lit(s)))
    assert canon('{"b": 1, "a": [1,2]}') == canon('{ "a":[1, 2],"b":1}') and canon("{") is None
    assert one(spark, values.path(F.lit('{"profile": {"x": 1}, "y": 2}'), "x")) == "1" and one(spark, values.path(F.lit('{"y": 2}'), "y")) == "2"
    assert [one(spark, values.truthy(F.lit(x))) for x in ("true", "false", "0", "2", "", "text")] == [True, False, False, True, False, True]
    assert one(spark, numbers.lenient_timestamp(F.lit("2026-01-02 junk"))) == datetime(2026, 1, 2) and one(spark, numbers.lenient_timestamp(F.lit("x"))) is None
    assert values.config_hash({"a": 1, "b": 2}) == values.config_hash({"b": 2, "a": 1})
    assert one(spark, numbers.delta(F.lit(None).cast("double"), F.lit(1.0))) is None and one(spark, numbers.delta(F.lit(2.0), F.lit(None).cast("double"))) == 2.0


def test_profile_findings(spark):
    fields = "headline string, company string, title string, seniority string, location string, building boolean, founder boolean, open boolean"
    flags = (None, None, None)
    df = spark.createDataFrame([
        (("Staff ML Engineer at Acme - inference", "Acme", "Staff ML Engineer", "senior_ic", "X", *flags), ("Building", None, None, None, "X", *flags), 1),
        (("Principal Engineer at Acme", "Acme", "Principal Engineer", "ic", "X", *flags), ("Principal Engineer at Acme", "Acme", "Principal Engineer", "ic", "X", *flags), 2),
        (("Senior Engineer at Acme", "Acme", "Senior Engineer", "senior_ic", "X", *flags), ("Director of Engineering at Acme", "Acme", "Director of Engineering", "director", "Y", None, None, True), 3),
        ((None, None, None, None, None, *flags), (None, None, None, None, None, *flags), 4),
        (("VP Engineering at Acme", "Acme", "VP", "vp", "X", *flags), ("VP Engineering - payments, distributed systems. Considering what's next.", None, None, None, None, *flags), 5),
    ], f"b struct<{fields}>, a struct<{fields}>, id int")
    got = {}
    for r in rules.findings(df, rules.profile_rules("b", "a"), ["id"]).collect():
        got.setdefault(r.id, {}).setdefault(r.kind, {})[r.name] = r.confidence
    assert got[1]["inference"] == {"POSSIBLE_COMPANY_FORMATION": 0.75} and {"EMPLOYMENT_ENDED", "HEADLINE_CHANGED"} == set(got[1]["event"])
    assert set(got[1]["fact"]) == {"EMPLOYMENT_ENDED_AT", "HEADLINE_CHANGED", "HEADLINE_TEXT"}
    assert 2 not in got and 4 not in got
    assert set(got[3]["event"]) == {"TITLE_CHANGED", "PROMOTION", "HEADLINE_CHANGED", "OPEN_TO_WORK_SIGNAL"} and "LOCATION" in got[3]["fact"]
    assert set(got[5]["event"]) == {"EMPLOYMENT_ENDED", "HEADLINE_CHANGED"} and "inference" not in got[5]


NEWS = [
    ("Former Labs engineer Ann Lee has left the company and is building a new inference infrastructure project. The project is currently in stealth.", {"NEWS_MENTION", "EMPLOYMENT_ENDED", "STEALTH_COMPANY_SIGNAL", "POSSIBLE_COMPANY_FORMATION"}),
    ("The office named Partner Ann Lee with a new venture allocation mandate.", {"NEWS_MENTION", "PARTNER_ROLE_STARTED", "INVESTMENT_MANDATE_CHANGED"}),
    ("Foundry has raised $28M in a Series A.", {"NEWS_MENTION", "FUNDRAISE_ANNOUNCED"}),
    ("Cobalt, where Ann Lee was head of product, has been acquired by a larger data platform.", {"NEWS_MENTION", "COMPANY_ACQUIRED"}),
    ("Quiet weather today.", {"NEWS_MENTION"}),
]


def test_text_findings(spark):
    df = spark.createDataFrame([(i, t, "Ann Lee", "news_article") for i, (t, _) in enumerate(NEWS)] + [(9, None, "x", "news_article")], "id int, t string, s string, c string")
    got = {}
    for r in rules.findings(df.filter("t is not null"), rules.text_rules("t", "s", "c"), ["id"]).collect():
        got.setdefault(r.id, {}).setdefault(r.kind != "fact", {})[r.name] = r
    for i, (_, want) in enumerate(NEWS):
        assert set(got[i][True]) == want
    assert got[0][False]["EMPLOYMENT_ENDED_AT"].value.startswith("Former Labs")
    a = spark.createDataFrame([(1, "It raised a $28M Series A", None, "news_article")], "id int, t string, s string, c string")
    assert rules.findings(a, rules.text_rules("t", "s", "c"), ["id"]).count() == 0 and rules.findings(a, rules.text_rules("t", "s", "c", rules.RAISED_A), ["id"]).count() == 2


def test_first_match_and_unknown_operands(spark):
    decision, reasons = rules.first_match([{"when": {"p_gte": 60, "stale": True}, "then": "A", "reason_codes": ["X"]}, {"when": {"p_gte": 50}, "then": "B"}], ["p", "stale"])
    df = spark.createDataFrame([(70.0, True), (70.0, None), (None, True)], "p double, stale boolean")
    assert [tuple(r) for r in df.select(decision, reasons).collect()] == [("A", ["X"]), ("B", []), ("UNKNOWN", [])]
    # An unknown number is below every threshold, a rule that never holds and one on a missing column don't match.
    for when, want in (({"p_lt": 70}, [False, False, True]), ({"always": False}, [False] * 3), ({"other_gte": 1}, [False] * 3), ({"stale": False}, [False, True, False])):
        assert [r[0] for r in df.select(rules.condition(when, df.columns)).collect()] == want


def test_collapse_keeps_by_the_last_kept(spark):
    at = lambda *days: [(i, "p", D0 + timedelta(d)) for i, d in enumerate(days)]
    df = spark.createDataFrame([*at(0, 40, 61, 100, 125), (8, "p", None), (9, "p", None)], "id int, person string, at timestamp")
    assert sorted(r.id for r in events.collapsed(df, ["person"], "at", "id").collect()) == [0, 2, 4, 8]
    assert events.collapsed(df.limit(0), ["person"], "at", "id").count() == 0


def test_new_events_and_reconciliation(spark):
    e = spark.createDataFrame([(1, "p", "T", D0), (2, "p", "T", D0 + timedelta(hours=2)), (3, "p", "T", None)], "id int, person_id string, event_type string, occurred_at timestamp")
    active = e.filter("id = 3").select(values.event_key(F.col("person_id"), F.col("event_type"), F.col("occurred_at")).alias("dedupe_key"))
    assert [r.id for r in events.new_events(e, active, ["id"]).collect()] == [1]
    jobs = spark.createDataFrame([("p", "a", date(2020, 1, 1), None, True)], "person_id string, organization_id string, started_at date, ended_at date, current boolean")
    moves = lambda o: spark.createDataFrame([("p", o, date(2026, 1, 1))], "person_id string, organization_id string, at date")
    got = sorted((r.organization_id, r.ended_at, r.current) for r in events.reconciled(jobs, moves("a"), moves("b")).collect())
    assert got == [("a", date(2026, 1, 1), False), ("b", None, True)]


def test_resolution_decisions(spark):
    df = spark.createDataFrame([("c1", "p1", 0.95), ("c1", "p2", 0.2), ("c2", "p1", 0.2), ("c2", "p2", 0.2), ("c3", "p1", 0.2), ("c4", "p1", 0.1), ("c5", "p1", 0.95), ("c5", "p2", 0.9)], "c string, p string, s double")
    got = {r.c: (r.decision, r.p, r.competing) for r in resolve.decide(df, "c", "p", "s").collect()}
    assert got == {"c1": ("MATCH", "p1", ["p2"]), "c2": ("AMBIGUOUS", None, ["p1", "p2"]), "c3": ("POSSIBLE_MATCH", "p1", []), "c4": ("NO_MATCH", None, []), "c5": ("AMBIGUOUS", None, ["p1", "p2"])}


def test_merge_and_unmerge(spark):
    jobs = spark.createDataFrame([("a", 1), ("b", 2)], "person string, x int")
    merges = spark.createDataFrame([("a", "b", True)], "loser string, winner string, active boolean")
    assert {r.person for r in resolve.through_merges(jobs, "person", merges).collect()} == {"b"}
    assert {r.person for r in resolve.through_merges(jobs, "person", merges.withColumn("active", F.lit(False))).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        resolve.check_merge(merges, "a", "c")
    with pytest.raises(ValueError):
        resolve.check_merge(merges, "x", "x")


def test_paths_and_access(spark):
    e = graph.undirected(spark.createDataFrame([("s", "a", 2), ("a", "b", 1), ("b", "c", 3), ("s", "d", 3), ("d", "b", 3), ("c", "z", 1), ("s", "s", 1)], "src string, dst string, strength int"))
    p = graph.paths(e, spark.createDataFrame([("s",)], "node string"), 3)
    got = {(r.target, r.hops, r.first_hop, r.weakest) for r in p.collect()}
    assert {("a", 1, "a", 2), ("b", 2, "a", 1), ("b", 2, "d", 3), ("c", 3, "d", 3), ("c", 3, "a", 1)} <= got and not any(t == "z" for t, *_ in got)
    base = F.when(F.col("weakest") == 3, 45.0).when(F.col("weakest") == 2, 30.0).otherwise(F.lit(None))
    scores = {r.target: (r.base, r.routes, r.score) for r in graph.access(p, base).collect()}
    assert scores["b"] == (45.0, 2, 49.0)
    assert {r.target: r.path for r in graph.access(p, base).collect()}["b"] == ["s", "d", "b"]
    none = graph.access(p, F.lit(None).cast("double")).collect()
    assert none and all(r.score is None for r in none)


def test_access_adjustments(spark):
    old = datetime(2025, 3, 1)
    e = spark.createDataFrame([("s", "t", 2, D0, 0.85), ("s", "a", 2, D0, 0.85), ("a", "t", 2, D0, 0.85), ("s", "b", 2, D0, 0.85), ("b", "t", 2, D0, 0.85), ("s", "w", 3, old, 0.2)], "src string, dst string, strength int, verified timestamp, confidence double")
    p = graph.paths(graph.undirected(e), spark.createDataFrame([("s",)], "node string"), 2)
    base = F.when(F.col("hops") == 1, 75.0).otherwise(30.0)
    got = {r.target: r.score for r in graph.access(p, base, as_of=F.lit("2026-09-06").cast("timestamp")).collect()}
    assert got["t"] == 70.55
    assert got["w"] == pytest.approx((75 - 15) * 0.5)


def test_scores_add_up_and_unknown_stays_out(spark):
    model = {"dimensions": {"q": {"weight": 0.7, "features": {"x": {"weight": 0.6, "normalization": "linear_cap", "params": {"divisor": 10}}, "y": {"weight": 0.4, "normalization": "binary"}}}, "t": {"weight": 0.3, "features": {"z": {"weight": 1.0, "normalization": "passthrough_unit"}}}}}
    scoring.check_model(model)
    df = spark.createDataFrame([(1, 5.0, 1.0, None), (2, None, 0.0, 0.5), (3, None, None, None)], "id int, x double, y double, z double")
    long = scoring.contributions(df, "id", model)
    dims = {(r.id, r.dimension): r.score for r in scoring.dimension_scores(long, "id").collect()}
    assert dims == {(1, "q"): 70.0, (1, "t"): None, (2, "q"): 0.0, (2, "t"): 50.0, (3, "q"): None, (3, "t"): None}
    for r in long.filter("not included").collect():
        assert r.contribution == 0 and r.normalized is None
    with pytest.raises(ValueError):
        scoring.check_model({"dimensions": {"q": {"weight": 0.5, "features": {}}}})
    two = spark.createDataFrame([(60.0, 40.0, 20.0, None)], "q double, f double, t double, a double")
    assert two.select(scoring.priority({"q": (F.col("q"), 0.35), "f": (F.col("f"), 0.25), "t": (F.col("t"), 0.25), "a": (F.col("a"), 0.15)})).first()[0] == 42.3529


def test_decay_is_monotone(spark):
    s = spark.createDataFrame([("fresh", 6.0), ("stale", 248.0), ("ahead", -3.0), ("undated", None)], "who string, age double")
    got = {r.who: r.score for r in scoring.signal_score(s, "who", F.lit(0.5), F.col("age"), F.lit(30.0)).collect()}
    assert got["ahead"] == got["undated"] == 50.0 > got["fresh"] > got["stale"] > 0


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([("u", 90.0), ("u", 80.0), ("u", 80.0), ("u", 70.0), (None, 1.0), ("u", None)], "u string, s double")
    got = sorted((r.s or -1, r.rank, r.percentile) for r in ranking.ranked(df, ["u"], "s").collect())
    assert got == [(-1, None, None), (1.0, 1, 100.0), (70.0, 4, 25.0), (80.0, 2, 75.0), (80.0, 2, 75.0), (90.0, 1, 100.0)]
    first = ranking.page(df.filter("s is not null"), "-s", {"s": "s"}, "u", 1, 2).collect()
    assert [r.s for r in first] == [90.0, 80.0]


def test_ingest(spark):
    d = spark.createDataFrame([(1, "h1", "s", "a"), (2, "h1", "s", "b"), (3, "h2", "s", "c"), (4, "h3", "s", "x"), (5, "h4", None, None)], "seq int, h string, src string, rid string")
    stored = spark.createDataFrame([("h2", "s", "q"), ("h9", "s", "x")], "h string, src string, rid string")
    assert sorted(r.seq for r in ingest.accept_new(d, stored, "h", ["src", "rid"], ["seq"]).collect()) == [1, 5]
    again = ingest.accept_new(d, d, "h", ["src", "rid"], ["seq"])
    assert again.count() == 0
    up = ingest.merged(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, up.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_measures(spark):
    df = spark.createDataFrame([("a", True, True), ("a", False, True), ("b", False, False)], "c string, g boolean, p boolean")
    got = {r.c: (r.precision, r.recall, r.f1) for r in metrics.prf(df, "c", "g", "p").collect()}
    assert got == {"a": (0.5, 1.0, 0.666667), "b": (1.0, 1.0, 1.0)}
    v = spark.createDataFrame([("g", float(x)) for x in range(1, 12)], "g string, v double")
    assert tuple(metrics.distribution(v, ["g"], "v").first()) == ("g", 11, 6.0, 6.0, 10.0, 11.0)
    r = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a int, b int")
    assert metrics.spearman(r, "a", "b").first().rho == 0.5


def test_neighbours_tenure_and_tiers(spark):
    e = spark.createDataFrame([("a", "b", date(2026, 1, 1)), ("a", "c", None)], "src string, dst string, at date")
    m = spark.createDataFrame([("b", True)], "node string, lp boolean")
    assert tuple(features.neighbour_features(e, m, ["lp"], "at", F.lit("2026-02-01").cast("date")).first()) == ("a", 2, 1, 0.5)
    arr = lambda *x: F.array(*(F.lit(v) for v in x))
    assert one(spark, features.tier(arr("x"), arr("y"), arr("x"))) == "adjacent" and one(spark, features.overlap(arr("a", "b"), arr("b", "c"))) == 0.5


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"observations": [{"provider_record_id": "1", "mode": "discover", "content_type": "news_article", "observed_at": "2026-01-01T00:00:00Z", "raw_json": {"a": {"b": 1}}}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"provider_record_id": "2", "observed_at": "2027-01-01"}]))
    (tmp_path / "c.json").write_text("{broken")
    j = readers.read_json(spark, str(tmp_path))
    assert sorted((r.provider_record_id, r.raw_json) for r in j.collect()) == [("1", '{"a":{"b":1}}'), ("2", None)]
    seen = readers.visible(j, F.lit("2026-09-06 23:59:59").cast("timestamp"))
    assert [r.provider_record_id for r in seen.collect()] == ["1"] and readers.visible(j, F.lit("2028-01-01").cast("timestamp"), "update").count() == 1
    (tmp_path / "people.csv").write_text("record_id,person,value,mode\nr1,Ann, ,discover\n,Bob,3,\n")
    c = {r.subject_hint: r for r in readers.read_csv(spark, str(tmp_path / "people.csv"), F.lit("2026-01-01 00:00:00")).collect()}
    assert c["Ann"].provider_record_id == "r1" and c["Ann"].mode == "discover" and "value" not in json.loads(c["Ann"].raw_json)
    assert c["Bob"].provider_record_id == "people:1" and json.loads(c["Bob"].raw_json) == {"person": "Bob", "value": "3"}
    (tmp_path / "feed.xml").write_text("<rss><channel><item><guid>g1</guid><title>T</title><link>https://a.example/1</link><description>D</description><pubDate>Mon, 05 Jan 2026 10:00:00 +0000</pubDate><category>Ann</category><category>Bob</category></item></channel></rss>")
    f = readers.read_feed(spark, str(tmp_path / "feed.xml"))
    r = f.first()
    assert (r.provider_record_id, r.subject_hint, r.observed_at, r.raw_text) == ("g1", "Ann", datetime(2026, 1, 5, 10), "T. D")
    assert readers.about(f, spark.createDataFrame([("BOB",)], "name string")).count() == 1 and readers.about(f, spark.createDataFrame([("Eve",)], "name string")).count() == 0
    assert readers.inline(spark, [{"subject_hint": "x"}], "run").first().provider_record_id == "import:run:0"
    posts = spark.createDataFrame([("p", "1", "x", 1), ("p", "5", "2", 2), ("p", None, None, 3)], "person string, likes string, views string, id int")
    assert [r.id for r in readers.top_posts(posts, "person", ["likes", "views"], 1, "id").collect()] == [2]
    reg = readers.Registry()
    reg.add("json", lambda s: readers.read_json(s, str(tmp_path)))
    reg.add("gone", lambda s: readers.read_csv(s, str(tmp_path / "none"), F.lit("x")))
    reg.add("off", lambda s: s.range(1))
    assert {r.provider: r.status for r in reg.health(spark, ["json", "gone"]).collect()} == {"json": "ok", "gone": "failed", "off": "disabled"}
    assert reg.read(spark, ["json"]).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    t = str(tmp_path / "t")
    assert writers.publish(df, t) == 2
    before = writers.published(spark, t)
    assert writers.publish(df.limit(0), t, dry_run=True) == 0 and writers.published(spark, t).count() == 2
    assert writers.publish(df.union(df), t) == 4 and writers.published(spark, t).count() == 4
    assert before.count() == 2  # readers of the version before go on reading it
    with pytest.raises(Exception):
        writers.publish(df.select(F.raise_error(F.lit("no"))), t)
    writers.publish(df.limit(1), t)
    assert writers.published(spark, t).count() == 1 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2
    for _ in range(2):
        writers.replace_partitions(df, str(tmp_path / "p"), ["w"])
    writers.replace_partitions(df.filter("k = 1"), str(tmp_path / "p"), ["w"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    writers.append(df, str(tmp_path / "a"), ["w"])


def test_streams_equal_batches(spark, tmp_path):
    data = spark.createDataFrame([(i % 3, D0 + timedelta(days=7 * i)) for i in range(30)], "person int, at timestamp")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = observations.collapsed(stream, "person", "at").writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.collapsed(data.withColumn("id", F.monotonically_increasing_id()), ["person"], "at", "id")
    assert sorted(map(tuple, spark.table("kept").collect())) == sorted((r.person, r.at) for r in want.collect())
    for _ in range(2):
        observations.append_new(observations.deduplicated(stream, ["person", "at"], "at"), str(tmp_path / "out"), ["person", "at"], str(tmp_path / f"cp{_}")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        observations.append_new(stream, str(tmp_path / "bad"), ["person", "at"], str(tmp_path / "cpbad")).awaitTermination(120)


def test_visibility(spark):
    df = spark.createDataFrame([(1, None, D0), (2, D0, D0 + timedelta(5)), (3, D0 + timedelta(9), D0)], "id int, valid_from timestamp, created_at timestamp")
    at = F.lit("2026-09-07").cast("timestamp")
    assert [r.id for r in df.filter(timeline.fact_visible(at)).collect()] == [1, 2] and [r.id for r in df.filter(timeline.fact_visible(at, at)).collect()] == [1]
    e = df.withColumnsRenamed({"valid_from": "occurred_at", "created_at": "detected_at"})
    assert [r.id for r in e.filter(timeline.event_visible(at)).collect()] == [1, 2] and [r.id for r in e.filter(timeline.event_visible(at, at)).collect()] == [1]
    i = df.withColumnRenamed("valid_from", "expires_at")
    assert [r.id for r in i.filter(timeline.inference_visible(at)).collect()] == [1, 3]


def test_every_node_is_a_seed(spark, tmp_path):
    """Access paths start from all users and edges of all people count, whatever their ids; against brute force."""
    from quillon.plans import reference_queries

    edges = [(700, 1), (700, 2), (800, 2), (900, 3), (2, 1)]
    rows = [(u, "purchase", 120.0, D0, f'{{"k": {k}}}') for u, k in edges] + [(700, "purchase", 10.0, D0, '{"k": 9}')]
    spark.createDataFrame(rows, "user_id bigint, event_type string, value double, ts timestamp_ntz, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(2,), (700,), (900,), (1000,)], "c_custkey bigint").write.parquet(f"{tmp_path}/customer.parquet")
    run = lambda q: {tuple(r) for r in reference_queries.QUERIES[q](spark, str(tmp_path)).collect()}
    near: dict = {}
    for u, k in edges:
        near.setdefault(u, set()).add(10**6 + k)
        near.setdefault(10**6 + k, set()).add(u)
    found, seeds = set(), {u for u, _ in edges}
    for s in seeds:
        reached, walks = set(), [[s, t] for t in near[s]]
        for hops in (1, 2, 3):
            found |= {(s, w[-1], hops, w[1]) for w in walks}
            onward = [w for w in walks if hops == 1 or w[-1] not in reached]
            reached |= {w[-1] for w in walks}
            walks = [[*w, t] for w in onward for t in near[w[-1]] if t not in (s, w[1])]
    assert run("access_paths") == {(h, sum(f[2] == h for f in found), len({f[1] for f in found if f[2] == h})) for h in (1, 2, 3)}
    assert {r[0] for r in run("access_score")} == {f[1] for f in found}
    assert run("access_unknown") == {(len({f[1] for f in found if f[2] <= 2}),) * 2}
    assert run("or_edge_join") == {(2, 1, 2), (700, 2, 2), (900, 1, 2)}


def test_merges_of_any_length(spark):
    chain = [(f"p{i}", f"p{i + 1}" if i < 9 else None) for i in range(10)]
    rows = [*chain, ("x", "y"), ("y", "x"), ("into_x", "x"), ("self", "self"), ("gone", "nobody"), (None, "p0"), ("p3", "p4")]
    got = {r.person_id: r.live_id for r in resolve.live_ids(spark.createDataFrame(rows, "person_id string, merged_into_id string")).collect()}
    assert all(got[f"p{i}"] == "p9" for i in range(10)) and got["self"] == "self" and got["gone"] == "nobody"
    assert got["x"] == "x" and got["y"] == "y" and len(got) == 15
    assert resolve.live_ids(spark.createDataFrame([], "person_id string, merged_into_id string")).count() == 0


def test_places_without_one_task(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "id int, v int")
    got = {r.id: r.place for r in ranking.placed(df, [F.desc("v"), F.asc("id")]).collect()}
    want = sorted(range(100), key=lambda i: (-(i % 3), i))
    assert [got[i] for i in want] == list(range(1, 101)) and ranking.placed(df.limit(0), [F.asc("id")]).count() == 0


def test_near_pairs_are_counted(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), D0 + timedelta(days=rng.randint(0, 30))) for _ in range(80)] + [("a", None), (None, D0)]
    want = {}
    for i, (k, t) in enumerate(rows):
        for k2, t2 in rows[:i]:
            if t and t2 and k == k2 and abs((t - t2).days) <= 5:
                want[k] = want.get(k, 0) + 1
    got = {r.k: r.pairs for r in events.near_counts(spark.createDataFrame(rows, "k string, at timestamp"), ["k"], "at", 5).collect()}
    assert got == want


def test_end_and_restart_in_one_batch(spark):
    jobs = spark.createDataFrame([("p", "o", date(2020, 1, 1), None, True), ("q", "o", date(2020, 1, 1), None, None)], "person_id string, organization_id string, started_at date, ended_at date, current boolean")
    moves = spark.createDataFrame([("p", "o", date(2026, 1, 1))], "person_id string, organization_id string, at date")
    back = moves.withColumn("at", F.lit("2026-02-01").cast("date"))
    got = sorted((r.person_id, str(r.started_at), str(r.ended_at), r.current) for r in events.reconciled(jobs, moves, back).collect())
    assert got == [("p", "2020-01-01", "2026-01-01", False), ("p", "2026-02-01", "None", True), ("q", "2020-01-01", "None", None)]


def test_search_and_large_json(spark, tmp_path):
    rules_ = [{"name": "a", "titles": ["x y", "z"], "geographies": ["Q"]}, {"name": "b", "titles": []}, {"name": "c", "active": False, "titles": ["x"]}]
    assert readers.search_queries(rules_, "s.example") == {"a": "site:s.example ('x y' OR 'z') ('Q')"}
    found = spark.createDataFrame([("https://a.example/1", "T", "C", None)], "url string, title string, content string, published string")
    r = readers.search_drafts(found, "q", F.lit("Ann"), F.lit("2026-01-01").cast("timestamp")).first()
    assert (r.provider_record_id, r.subject_hint, r.mode, r.raw_text, r.occurred_at) == ("https://a.example/1", "Ann", "discover", "T. C", datetime(2026, 1, 1))
    (tmp_path / "l.json").write_text('{"provider_record_id": "1"}\nbroken\n{"provider_record_id": "2"}\n')
    assert sorted(r.provider_record_id for r in readers.read_json(spark, str(tmp_path), lines=True).collect()) == ["1", "2"]


def test_any_number_of_roles(spark, tmp_path):
    """More roles than a row could hold, and odd rows on both sides, against SQL."""
    from quillon.plans import reference_queries

    roles = [(i, "Brand#11", f"{'ABCé'[i % 4]}x", i % 15 - 2) for i in range(20_000)]
    roles += [(-1, "Brand#12", "Bx", 1), (None, "Brand#11", "Zx", 9), (30_000, "Brand#11", None, 10), (-5, "Brand#11", '"', 11), (-6, "Brand#11", "", 12), (-7, "Brand#11", "A", None), (-8, None, "A", 1)]
    people = [(i, i % 25, "ABCZé"[i % 5] + "y") for i in range(40)] + [(7, 3, "Cy"), (50, None, "Ay"), (51, 4, None), (52, None, None), (53, 9, "Zy"), (54, 11, '"'), (55, 12, ""), (None, 1, "Ay"), (56, 40, "Qy")]
    write = lambda rows, kinds, name: spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    write(roles, "p_partkey bigint, p_brand string, p_type string, p_size int", "part")
    write(people, "c_custkey bigint, c_nationkey int, c_mktsegment string", "customer")
    assert parity.compare(spark, parity.duck(str(tmp_path)), reference_queries.QUERIES["role_match_best"], reference_queries.SQL["role_match_best"], str(tmp_path)) == ""


def test_paths_are_counted(spark, tmp_path):
    """Numbers of paths and scores of graphs with triangles, loops, parallel edges and unknown ends, against SQL."""
    from quillon.plans import reference_queries

    rng = random.Random(7)
    for i, (users, items, n) in enumerate(((8, 8, 20), (30, 10, 45), (4, 12, 25), (40, 3, 60))):
        # Some users have the id of an item.
        ids = [rng.choice([u, 10**6 + u]) for u in range(users)]
        rows = [(rng.choice(ids), "purchase", rng.choice([90.0, 120.0, 160.0]), D0, f'{{"k": {rng.randrange(items)}}}') for _ in range(n)]
        rows += [(10**6 + 1, "purchase", 90.0, D0, '{"k": 1}'), (10**6 + 2, "purchase", 160.0, D0, '{"k": 3}'), (10**6 + 3, "purchase", 90.0, D0, '{"k": 2}')]
        rows += [(None, "purchase", 90.0, D0, '{"k": 0}'), (ids[0], "purchase", 90.0, D0, None), (ids[1], "purchase", 90.0, D0, "{}"), (77, "view", 1.0, D0, "{}"), (ids[2], "purchase", None, D0, '{"k": 0}')]
        d = f"{tmp_path}/{i}"
        spark.createDataFrame(rows, "user_id bigint, event_type string, value double, ts timestamp_ntz, props string").write.parquet(f"{d}/events.parquet")
        for q in ("access_paths", "access_score"):
            assert parity.compare(spark, parity.duck(d), reference_queries.QUERIES[q], reference_queries.SQL[q], d) == "", (i, q)

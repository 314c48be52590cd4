"""The general data operators on small tables, by hand or against plain Python."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.operators import asof, dedupe, nested, snapshots
from quillon.plans import data_queries

D0 = datetime(2026, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# 1: messages delivered more than once

MESSAGES = "id string, source string, rid string, at timestamp, arrived timestamp, __rank int"


def messages(spark, data):
    return spark.createDataFrame(data, MESSAGES)


CASES = [
    ("a", "s1", "X-1", D0, D0, 1),
    ("b", "s1", " x-1 ", D0 + timedelta(1), D0, 2),
    ("c", "s2", "x-1", D0, D0, 3),
    ("d", "s1", None, D0, D0, 4),
    ("e", "s1", None, D0, D0, 5),
    ("f", "s1", "tie", D0, D0, 6),
    ("g", "s1", "TIE ", D0, D0, 7),
    ("h", None, "x-1", D0, D0, 8),
    ("i", "s1", "late", None, D0, 9),
    ("j", "s1", "late", D0, None, 10),
]


def test_first_copy_stays(spark):
    df = messages(spark, CASES)
    keys = [F.col("source"), dedupe.identifier("rid")]
    assert rows(dedupe.later_copies(df, "id", keys, ["at", "arrived"])) == [("b",), ("g",), ("i",)]
    kept = dedupe.keep_first(df, keys, ["at", "arrived", "id"])
    assert kept.columns == df.columns
    assert sorted(r.id for r in kept.collect()) == ["a", "c", "d", "e", "f", "h", "j"]


def test_copies_of_empty_and_repeated_rows(spark):
    empty = messages(spark, [])
    keys = [F.col("source"), dedupe.identifier("rid")]
    assert dedupe.keep_first(empty, keys, ["at"]).count() == dedupe.later_copies(empty, "id", keys, ["at"]).count() == 0
    same = messages(spark, [CASES[0]] * 3)
    assert dedupe.keep_first(same, keys, ["at", "id"]).count() == 1


def test_later_batches_against_stored(spark):
    df = messages(spark, CASES)
    stored = df.filter("id = 'c'")
    batch = messages(spark, [("k", "s2", "X-1 ", D0, D0, 1), ("l", "s3", "new", D0, D0, 2), ("m", "s3", "NEW", D0 + timedelta(1), D0, 3), ("n", "s3", None, D0, D0, 4)])
    assert sorted(r.id for r in dedupe.admit(batch, stored, ["source", "rid"], ["at", "id"]).collect()) == ["l", "n"]
    assert dedupe.admit(batch, stored, ["source", "rid"], ["at"]).columns == batch.columns


# 2: nested records

PROFILE = {"headline": "h", "experience": [{"company": "A", "roles": [{"title": "t", "projects": [{"name": "p"}, 3, None]}, "no role"]}, None, {"company": "B", "roles": {"title": "only", "projects": {"name": "q"}}}]}


def node_rows(spark, raw, before=None):
    df = spark.createDataFrame([("o1", raw, before, "x")], "id string, raw_json string, previous string, node string")
    return nested.nodes(df, "id", "raw_json", "previous")


def test_positions_and_levels(spark):
    got = sorted((r.node, r.job_pos, r.role_pos, r.project_pos) for r in node_rows(spark, json.dumps({"profile": PROFILE})).collect())
    assert got == [("job", 0, -1, -1), ("job", 2, -1, -1), ("profile", -1, -1, -1), ("project", 0, 0, 0), ("project", 2, 0, 0), ("role", 0, 0, -1), ("role", 2, 0, -1)]


@pytest.mark.parametrize("raw", [None, "", "  ", "{", '{"profile": {"a": 1}', "[1]", '"text"', "3", "null", '"{\\"a\\": "'])
def test_unreadable_texts_hold_nothing(spark, raw):
    assert node_rows(spark, raw, raw).count() == 0


def test_json_in_a_string_and_objects_in_place_of_arrays(spark):
    raw = json.dumps(json.dumps({"positions": {"company": "A"}, "profile": None}))
    got = sorted((r.document, r.node, r.job_pos) for r in node_rows(spark, raw, json.dumps(json.dumps({"headline": 1}))).collect())
    assert got == [("previous", "previous", -1), ("raw", "job", 0), ("raw", "profile", -1)]


def random_profile(rng):
    make = lambda field, below: {field: rng.choice([[below(rng) if below else {} for _ in range(rng.randint(0, 3))], None, "x", below(rng) if below else {}])}
    project = lambda r: {"name": r.random()}
    role = lambda r: make("projects", project)
    job = lambda r: make("roles", role)
    return make(rng.choice(["experience", "positions"]), job)


def test_intervals_contain_exactly_the_descendants(spark):
    rng = random.Random(3)
    docs = [(f"o{i}", json.dumps({"profile": random_profile(rng)}), None) for i in range(60)]
    n = nested.nodes(spark.createDataFrame(docs, "id string, raw string, prev string"), "id", "raw", "prev").cache()
    pairs = {(r.record_id, r.ancestor_pre, r.descendant_pre) for r in nested.contained(n, n).collect()}
    parent = {(r.record_id, r.pre): r.parent_pre for r in n.collect()}
    want = set()
    for (rid, pre), up in parent.items():
        while up >= 0:
            want.add((rid, up, pre))
            up = parent[rid, up]
    assert pairs == want and want


def test_deep_nesting_is_no_error(spark):
    deep = '{"profile": ' + "[" * 100_000 + "]" * 100_000 + "}"
    assert node_rows(spark, deep).count() in (0, 1)
    long = json.dumps({"profile": {"headline": "x" * 2_000_000}})
    assert node_rows(spark, long).count() == 1


def test_typed_table(spark):
    n = node_rows(spark, json.dumps({"profile": PROFILE}))
    assert [tuple(r) for r in nested.typed(n, "job", ["company"]).orderBy("position").select("position", "company").collect()] == [(0, "A"), (2, "B")]


# 5: full snapshots


def changed(spark, data):
    df = spark.createDataFrame(data, "day string, id string, title string, extra int")
    return rows(snapshots.changes(df.withColumn("title", snapshots.canonical_text(F.col("title"))), "day", "id", ["title"]))


def test_added_removed_changed(spark):
    data = [("d1", "a", "T", 1), ("d1", "b", "T", 1), ("d1", "c", " X  y", 1), ("d2", "a", "U", 1), ("d2", "c", "x Y\t", 2), ("d2", "e", None, 1), ("d4", "a", "U", 1), ("d4", "e", "  ", 1), ("d4", "b", "T", 1)]
    assert changed(spark, data) == [("d2", "a", "changed"), ("d2", "b", "removed"), ("d2", "e", "added"), ("d4", "b", "added"), ("d4", "c", "removed")]


def test_snapshots_nulls_repeats_and_single(spark):
    assert changed(spark, []) == []
    assert changed(spark, [("d1", "a", "T", 1)]) == []
    assert changed(spark, [("d1", "a", "T", 1), (None, "a", "U", 1), ("d2", None, "T", 1), ("d2", "a", "T", 1)]) == []


# 6: attributes as known


def brute(events, versions):
    out = set()
    for e in events:
        for a in {v[1] for v in versions}:
            best = [v for v in versions if v[0] == e[0] and v[0] is not None and v[1] == a and None not in (e[2], v[3], v[4]) and v[3] <= e[2] and v[4] <= e[2] and (v[5] is None or v[5] > e[2])]
            if best and a is not None:
                best.sort(key=lambda v: (-v[3].timestamp(), -v[4].timestamp(), v[2]))
                out.add((e[1], a, best[0][2]))
    return out


def timeline_case(rng, n):
    t = lambda: D0 + timedelta(days=rng.randint(0, 20))
    maybe = lambda v: None if rng.random() < 0.15 else v
    events = [(maybe(rng.choice("pq")), f"e{i}", maybe(t())) for i in range(n)]
    versions = [(maybe(rng.choice("pq")), maybe(rng.choice("TL")), f"f{i:03}", maybe(t()), maybe(t()), rng.choice([None, t(), t()])) for i in range(n)]
    return events, versions


@pytest.mark.parametrize("hot", [10**6, 0])
def test_as_known_equals_brute_force(spark, hot):
    rng = random.Random(5)
    for n in (0, 1, 40, 150):
        events, versions = timeline_case(rng, n)
        e = spark.createDataFrame(events, "entity string, event_id string, at timestamp")
        v = spark.createDataFrame(versions, "entity string, attribute string, version_id string, start timestamp, known timestamp, until timestamp")
        got = {tuple(r) for r in asof.as_known(e, v, hot_rows=hot, slices=4).collect()}
        assert got == brute(events, versions)


def test_hot_entities_are_split(spark, monkeypatch):
    monkeypatch.setattr(asof, "HOT_SHARE", 10**9)
    rng = random.Random(8)
    events, versions = timeline_case(rng, 200)
    e = spark.createDataFrame(events, "entity string, event_id string, at timestamp")
    v = spark.createDataFrame(versions, "entity string, attribute string, version_id string, start timestamp, known timestamp, until timestamp")
    assert {tuple(r) for r in asof.as_known(e, v, hot_rows=10, slices=5).collect()} == brute(events, versions)


def test_carry_forward(spark):
    e = spark.createDataFrame([("p", "e1", 1), ("p", "e2", 5), ("q", "e3", 5)], "entity string, event_id string, at int")
    c = spark.createDataFrame([("p", 5, "new"), ("p", 2, "old"), ("q", 6, "x")], "entity string, available_at int, title string")
    assert rows(asof.carry_forward(e, c, ["title"]).select("event_id", "title")) == [("e1", None), ("e2", "new"), ("e3", None)]


@settings(max_examples=25, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["experience", "roles", "projects", "profile", "a"]), x, max_size=3), max_leaves=20))
def test_any_json_is_labelled(value):
    record = nested.read_object(json.dumps(value))
    if record is None:
        assert not isinstance(value, dict) and not (isinstance(value, str) and value.startswith("{"))
    else:
        labelled = nested.linked("r", "raw", nested.label("profile", nested.profile_of(record)))
        assert sorted(x for r in labelled for x in (r[3], r[4])) == list(range(2 * len(labelled)))


def test_queries_run_on_all_tables(spark):
    for name, q in data_queries.QUERIES.items():
        assert q(spark, "/root/testdata/sf0.001").count() >= 0, name


def test_profiles_in_json_strings(spark, tmp_path):
    """raw_json and previous_snapshot may be JSON strings that hold the object, and profiles may be flat."""
    from quillon.plans import reference_queries

    acme, flat, other = {"profile": {"headline": "Engineer at Acme", "current_company": "Acme"}}, {"headline": "Engineer at Acme", "current_company": "Acme"}, {"headline": "Chief of staff", "current_company": "Other"}
    text = lambda x: json.dumps(json.dumps(x))
    pairs = {"same": (text(acme), json.dumps(flat)), "moved": (text(other), json.dumps(acme)), "both": (text(acme), text(other)), "flat": (json.dumps(flat), text(acme)), "list": ("[1]", json.dumps(acme)), "first": (json.dumps(acme), "null"), "word": ('"x"', json.dumps(acme))}
    rows = [(k, "p", datetime(2026, 1, 1 + i), "profile_snapshot", now, before) for i, (k, (now, before)) in enumerate(pairs.items())]
    spark.createDataFrame(rows, "observation_id string, person_id string, observed_at timestamp_ntz, content_type string, raw_json string, previous_snapshot string").write.parquet(f"{tmp_path}/observation.parquet")
    run = lambda q: reference_queries.QUERIES[q](spark, str(tmp_path)).collect()
    ended = {r.observation_id: r.value for r in run("profile_findings") if r.name == "EMPLOYMENT_ENDED"}
    assert ended == {"moved": "Acme", "both": "Other"}
    assert {r.observation_id for r in run("profile_findings")} == {"moved", "both"}
    assert {r.observation_id: r.material for r in run("headline_materiality")} == {"same": False, "moved": True, "both": True, "flat": False}
    assert [tuple(r) for r in run("headline_pairs")] == [(3, 2)]

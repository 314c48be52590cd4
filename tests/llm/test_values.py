"""Typed values, name spellings and entity matching on small fixtures with known answers."""

from __future__ import annotations

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import canonical, matching, names, people, queries, spelling

DATA = "/root/testdata/sf0.001"

TITLES = [("t0", "Software Engineer", None), ("t1", "Senior Software Engineer", None), ("t2", "Vice President of Sales", None), ("t3", "Chief Executive Officer", None), ("t4", "Founder", None), ("t5", "Co-Founder", None), ("t6", "Product Manager", None), ("t7", "Portfolio Manager", None), ("t8", "Principal Product Manager", None)]
COMPANIES = [("c0", "Norvale Robotics", None), ("c1", "Norvale Health", None), ("c2", "Quillmark Capital", None), ("c3", "Ester Family Office", None)]
PLACES = [("p0", "Elster, BQ", "Basq"), ("p1", "Elster, KS", "Kest"), ("p2", "Fort Orith, KS", "Kest"), ("p3", "Gilønby, OL", "Olv")]


@pytest.mark.parametrize(("value", "want"), [
    ("software engineer", "t0"), ("SENIOR SOFTWARE ENGINEER (contract)", "t1"), ("Snr. S/W Engr", "t1"), ("Sr Sofware Engineer", "t1"), ("VP Sales", "t2"), ("sales, vice president of", "t2"), ("C.E.O.", "t3"), ("CEO", "t3"),
    ("Co-Founder", "t5"), ("Founder / interim", "t4"), ("Prod Mgr", "t6"), ("Prtfolio Manager", "t7"), ("Pincipal Product Manager", "t8"), ("Poet", ""), ("???", ""), ("n/a", ""), ("manager", ""), ("", ""),
])
def test_titles(value, want):
    assert canonical.Mapper(TITLES, canonical.TITLES).find(value) == want


@pytest.mark.parametrize(("value", "want"), [
    ("NORVALE ROBOTICS INC.", "c0"), ("Norvale Rob.", "c0"), ("Norvale", ""), ("Norvale Capital", ""), ("ex-Quillmark", "c2"), ("quillmark.capital", "c2"), ("QuillmarkCapital", "c2"), ("Quilmark Capital, S.A.", "c2"),
    ("The Ester Fam. (acquired)", "c3"), ("EsterFamilyOffice", "c3"), ("Stealth", ""), ("self-employed", ""),
])
def test_companies(value, want):
    assert canonical.Mapper(COMPANIES, canonical.COMPANIES).find(value) == want


@pytest.mark.parametrize(("value", "want"), [("Elster", ""), ("elster (ks)", "p1"), ("Elster / Basq", "p0"), ("KS: Elster", "p1"), ("Ft. Orith & remote", "p2"), ("Greater Gilonby Area", "p3"), ("Gilnøby,OL", "p3"), ("Remote", ""), ("Elster, XX, Kest", "p1")])
def test_places(value, want):
    assert canonical.Mapper(PLACES, canonical.PLACES).find(value) == want


def test_longest_mentions_win():
    m = canonical.Mapper(TITLES, canonical.TITLES)
    words = canonical.words_of("founder and senior software engineer")
    assert [(s, e) for s, e, _ in sorted(m.mentions(words))] == [(0, 1), (2, 5)]


def test_mapping_of_empty_lists_and_odd_values(spark):
    assert canonical.Mapper([], canonical.TITLES).find("anything") == ""
    df = spark.createDataFrame([("a", json.dumps({"profile": {"current_title": " CEO "}})), ("b", None), ("c", "{"), ("d", json.dumps({"current_title": "Founder"})), ("e", json.dumps({"profile": {"current_title": 3}})), ("f", json.dumps({"current_title": "x" * 100_000})), ("g", '{"current_title": " \\t"}')], "id string, raw_json string").selectExpr("*", "'clash' as field")
    got = sorted(tuple(r) for r in canonical.map_profiles(df, "id", "raw_json", {"current_title": (TITLES, canonical.TITLES)}).collect())
    assert got == [("a", "current_title", "t3"), ("f", "current_title", "")]
    assert canonical.map_profiles(df.limit(0), "id", "raw_json", {"current_title": (TITLES, canonical.TITLES)}).count() == 0
    with pytest.raises(ValueError):
        canonical.Mapper([(str(i), "n", None) for i in range(canonical.MOST_ENTRIES + 1)], canonical.TITLES)


def typo(rng, s):
    i = rng.randrange(1, len(s) - 1)
    return rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + rng.choice("aeiourst") + s[i:]])


def test_held_out_noise_is_mapped(spark):
    rng = random.Random(6)
    entries = canonical.read_list(spark.read.parquet(f"{DATA}/organization.parquet"), "organization_id", "canonical_name")
    m = canonical.Mapper(entries, canonical.COMPANIES)
    heads = [n.split()[0] for _, n, _ in entries]
    noisy = [(i, rng.choice([str.upper, str.lower, str.swapcase, lambda s: s.replace(" ", "-"), lambda s: f"The {s}", lambda s: f"{s}, LLC", lambda s: f"ex-{s}"])(typo(rng, n) if rng.random() < 0.5 else n)) for i, n, _ in entries]
    right = sum(m.find(v) == i for i, v in noisy)
    assert right / len(noisy) > 0.97 and len(heads) == len(entries)


def slow_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 4))
def test_distance(a, b, limit):
    want = slow_distance(a, b)
    assert spelling.distance(a, b) == want
    assert spelling.distance(a, b, limit) == min(want, limit + 1)


def test_near_words_finds_all_within_two():
    rng = random.Random(1)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(5, 8))) for _ in range(60)}
    near = spelling.NearWords(words)
    for w in list(words)[:20]:
        v = typo(rng, typo(rng, w))
        assert {x for x, _ in near.near(v)} == {x for x in words if spelling.word_distance(v, x) <= 2}


SAME = ["Ann Sørenquist", "sorenquist ann", "SORENQUIST, A.", "A. Sørenquist", "Ann (Sorenquist)", "Dr. Ann Sorenquist", "Ann K. Sorenquist", "AnnSorenquist", "ann_sorenquist", "Ann Sorenquist", "Anne Sorenquist", "Ann Sorennquist", "Ann Sorenqu1st", "Ann Sorenquist, PhD"]
OTHER = ["Bob Sorenquist", "Ann Marlowe", "B. Sorenquist", "Sorenquist", "Ann", "A.", "", "Sorenquist Capital", "Ann Sorelli"]


@pytest.mark.parametrize("name", SAME)
def test_spellings_of_one_name(name):
    assert names.similarity(name, "Ann Sørenquist") >= names.ACCEPT


@pytest.mark.parametrize("name", OTHER)
def test_other_names(name):
    assert names.similarity(name, "Ann Sørenquist") < names.ACCEPT


def test_nicknames_and_collision_curve():
    assert names.similarity("Liz Marlowe", "Elizabeth Marlowe") >= names.ACCEPT and names.similarity("Bob Marlowe", "Elizabeth Marlowe") < names.ACCEPT
    b = names.bands_for(0.3, 0.995, 2)
    assert 1 - (1 - 0.3**2) ** b >= 0.995 > 1 - (1 - 0.3**2) ** (b - 1)


def test_linking(spark):
    left = spark.createDataFrame([(n,) for n in [*SAME, *OTHER, None, " ", "Ann Sørenquist"]], "name string").selectExpr("name", "'x' as center")
    right = spark.createDataFrame([("Ann Sørenquist",), ("Bob Sorenquist",), ("Ann Marlowe",), (None,), ("Bob Sorenquist",)], "name string")
    got = {r.name: r.center for r in names.link(left, right).collect()}
    assert all(got[n] == "Ann Sørenquist" for n in SAME)
    assert got["B. Sorenquist"] == "Bob Sorenquist" and "Sorenquist" not in got and "" not in got
    assert names.link(left.limit(0), right).count() == names.link(left, right.limit(0)).count() == 0


def test_ties_stay_unlinked(spark):
    df = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert names.link(df("A. Marlowe"), df("Ann Marlowe", "Amy Marlowe")).count() == 0


def test_found_names_equal_all_pairs(spark):
    got = {tuple(r) for r in queries.p7_found(spark, DATA).collect()}
    people_ = {r.canonical_name: r.person_id for r in spark.read.parquet(f"{DATA}/watchlist.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{DATA}/observation.parquet").filter("subject_hint is not null").collect():
        best = sorted(((names.similarity(r.subject_hint, n), n) for n in people_), reverse=True)[:2]
        if r.subject_hint not in people_ and best[0][0] >= names.ACCEPT and best[0][0] > best[1][0]:
            want.add((r.observation_id, people_[best[0][1]]))
    assert got == want and want


def test_star_clusters(spark):
    v = spark.createDataFrame([(n, 1) for n in "abcdef"], "name string, weight int")
    e = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("c", "d", 0.95), ("a", "d", 0.5)], "a string, b string, similarity double")
    got = {r.name: r.center for r in names.star_clusters(e, v).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f"}


def test_given_centers_and_ties(spark):
    """Given names are centers whatever their degree; a spelling as near to two of them is nobody's."""
    v = spark.createDataFrame([(n, n in "XY", 0) for n in "XYabcd"], "name string, given boolean, weight int")
    e = spark.createDataFrame([("a", "X", 0.9), ("b", "X", 0.8), ("b", "Y", 0.8), ("c", "Y", 0.85), ("c", "X", 0.84), ("a", "b", 0.99), ("X", "Y", 0.9)], "a string, b string, similarity double")
    got = {r.name: r.center for r in names.star_clusters(e, v, given=True).collect()}
    assert got == {"X": "X", "Y": "Y", "a": "X", "b": "b", "c": "Y", "d": "d"}
    # A chain longer than any fixed number of rounds ends, every vertex once.
    line = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 0.9) for i in range(120)], "a string, b string, similarity double")
    every = spark.createDataFrame([(f"n{i:03d}", 0) for i in range(121)], "name string, weight int")
    assert names.star_clusters(line, every).count() == 121


def test_addresses():
    assert people.address(" HTTPS://www.Site.example/in/X/?a=1#b ") == "site.example/in/x" and people.address(None) == "" and people.mail(" A@B ") == "a@b"


def test_calibration(spark):
    df = spark.createDataFrame([(i / 100, i + random.Random(i).randint(-20, 20) > 50) for i in range(100)], "score double, label boolean")
    got = matching.calibrated(df, "score", "label").orderBy("score").collect()
    conf = [r.confidence for r in got]
    assert conf == sorted(conf) and conf[0] < 0.2 and conf[-1] > 0.8
    assert matching.calibrated(df.limit(0), "score", "label").count() == 0


def test_walks_stay_on_the_graph(spark):
    edges = spark.createDataFrame([(f"r{i}", f"t{j}") for i in range(30) for j in (i % 7, i % 5, 9)], "record string, token string")
    w = matching.walks(edges, per_record=2).collect()
    known = {r.b for r in edges.select(matching.bucket(edges.token).alias("b")).collect()}
    assert len(w) == 60 and all(set(r.walk) <= known and len(r.walk) == 6 for r in w)


def test_matching_against_brute_force(spark, monkeypatch):
    left, right = (x.collect() for x in people.sides(spark, DATA))
    want = {}
    for a in left:
        p, best = json.loads(a.payload), []
        for b in right:
            q = json.loads(b.payload)
            n = [len(set(p[k]) & set(q[k])) for k in ("urls", "emails", "orgs", "places")]
            if names.similarity(a.name, b.name) >= names.ACCEPT and (n[0] + n[1] or n[2] >= 2 and n[3]):
                best.append((-sum(n), b.record))
        if best:
            want[a.record] = min(best)[1]
    got = {r.candidate_id: r.person_id for r in queries.p4_found(spark, DATA).collect()}
    assert set(got.items()) <= set(want.items()) and len(got) == len(want) > 0


def test_value_queries_run(spark):
    for name in ("p3_found", "p3_unmatched", "p7_candidates"):
        assert queries.QUERIES[name](spark, DATA).count() > 0


def test_distant_spellings_of_candidates(spark, tmp_path):
    """Pairs of little q-gram similarity that the final rule accepts are met."""
    from quillon.llm import queries

    pairs = {"Abby Bleozer": "Abigail Belozer", "Mateo Kelefax": "Teo Elufax", "Greta Kalonner": "Margaret Kalonley", "Dalovnik, Izzy": "Isabella Dalovnik"}
    spark.createDataFrame(list(enumerate(pairs)), "candidate_id int, name string").write.parquet(f"{tmp_path}/er_candidate.parquet")
    spark.createDataFrame([(n, None) for n in pairs.values()], "canonical_name string, merged_into_id string").write.parquet(f"{tmp_path}/person.parquet")
    got = queries.p7_candidates(spark, str(tmp_path)).join(spark.createDataFrame(list(enumerate(pairs)), "candidate_id int, name string"), "candidate_id")
    assert {r["name"]: r.canonical_name for r in got.collect()} == pairs

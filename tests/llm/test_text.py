"""Encoding, packing and shared spans against plain or third-party versions."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import packing, queries, spans, tokens

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder()


@pytest.fixture(scope="module")
def other(enc):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


TEXTS = ["", " ", "hello  world\r\n\r\n", "<|endoftext|>", "naïve日本語🙂‍", "a" * 3000, "don't I'LL we've", "  x", "1234567 ½²", "ﬀ́\x00\x7f"]


def test_ids_equal_another_implementation(enc, other):
    for t in TEXTS:
        assert enc.encode(t) == other.encode_ordinary(t) and enc.decode(enc.encode(t)) == t
    assert enc.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("ab '\nétionIng  \t12"), max_size=80))
def test_any_text(text):
    e = tokens.encoder(tokens.VOCABULARY)
    ids = e.encode(text)
    assert e.decode(ids) == text and e.count(text) == len(ids)
    assert sum((tokens.merge(w.encode(), e.ranks) for w in e.split(text)), []) == ids


def test_long_word_and_cache_bound(enc, other, monkeypatch):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    assert enc.encode(word) == other.encode_ordinary(word) and word not in enc.words
    monkeypatch.setattr(tokens, "CACHE_WORDS", 0)
    assert tokens.Encoder().encode("some words here") == other.encode_ordinary("some words here")


def test_encode_table(spark, other):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, "long " * 50_000)], "doc_id bigint, text string").selectExpr("*", "'z' as lang", "1 as n_tokens")
    got = sorted(((r.doc_id, tuple(r.ids)) for r in tokens.encode(df, "doc_id", "text").collect()), key=str)
    want = sorted(((r.doc_id, tuple(other.encode_ordinary(r.text) if r.text else ())) for r in df.collect()), key=str)
    assert got == want
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0
    back = tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_whole_corpus_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    back = {r.doc_id: r.text for r in tokens.decode(queries.p8_ids(spark, DATA), "doc_id", "ids").collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}


def packed(spark, sizes, capacity=10, **kw):
    df = spark.createDataFrame(sizes, "id bigint, n int").selectExpr("id", "n", "'x' as container")
    return packing.pack(df, "id", "n", capacity, **kw).collect()


def check_packing(rows, sizes, capacity):
    room = defaultdict(int)
    pieces = defaultdict(list)
    for r in rows:
        if r.container is not None:
            room[r.container] += r.n
            pieces[r.id].append((r.start, r.n))
    assert all(v <= capacity for v in room.values())
    for i, n in sizes:
        if n and n > 0:
            got = sorted(pieces[i])
            assert sum(k for _, k in got) == n and (len(got) == 1 or n > capacity)
            assert [s for s, _ in got] == list(range(0, n, capacity))
    return len(room)


def test_packing_keeps_items_whole(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([rng.randint(1, 10), rng.randint(1, 35)])) for i in range(300)]
    n = check_packing(packed(spark, sizes), sizes, 10)
    assert n <= 1.05 * sum(s for _, s in sizes) / 10 + 1
    check_packing(packed(spark, sizes, shard_items=40), sizes, 10)


def test_packing_of_nothing(spark):
    assert packed(spark, []) == []
    rows = packed(spark, [(1, 0), (2, None), (None, 3), (3, 10), (3, 10)])
    assert sorted((r.id is None, r.id or 0, r.n, r.container is None) for r in rows) == [(False, 1, 0, True), (False, 2, 0, True), (False, 3, 10, False), (False, 3, 10, False), (True, 0, 3, False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_assign_is_tight(sizes):
    sizes.sort(reverse=True)
    where = packing.assign(sizes, 64)
    room = defaultdict(int)
    for n, c in zip(sizes, where):
        room[c] += n
    assert all(v <= 64 for v in room.values())
    if sizes:
        assert len(room) <= 1.5 * -(-sum(sizes) // 64) + 1


def test_costs_are_balanced():
    sizes = sorted([random.Random(4).randint(1, 200) for _ in range(4000)], reverse=True)
    cost = defaultdict(float)
    for n, c in zip(sizes, packing.assign(sizes, 1000)):
        cost[c] += packing.cost(n, 1000)
    full = sorted(cost.values())[5:-5]
    assert max(full) <= 1.15 * min(full)


def brute_pairs(docs, length):
    at = defaultdict(set)
    for k, t in docs:
        for i in range(len(t or "") - length + 1):
            at[t[i : i + length]].add(k)
    return {(a, b) for ks in at.values() for a in ks for b in ks if a < b}


def shared_case(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcd é\n") for _ in range(k))
    passages = [text(rng.randint(15, 60)) for _ in range(8)]
    docs = []
    for i in range(n):
        t = text(rng.randint(0, 90))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            s = rng.randint(0, len(p) - 1)
            j = rng.randint(0, len(t))
            t = t[:j] + p[s:] + t[j:]
        docs.append((i, t))
    docs += [(n + i, docs[i][1]) for i in range(8)] + [(n + 20, None), (n + 21, ""), (n + 22, docs[0][1].upper())]
    return docs


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("length", "seed_length"), [(20, 10), (20, 19), (24, 6)])
def test_pairs_equal_brute_force(spark, seed, length, seed_length):
    docs = shared_case(seed)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "0 as window", "'k' as key")
    s = spans.SharedSpans(df, "doc_id", "text", length, seed_length)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(docs, length)


def test_intervals_cover_exactly_what_is_shared(spark):
    docs = shared_case(3)
    distinct = {}
    for k, t in docs:
        if t:
            distinct.setdefault(t, k)
    rep = [(k, t) for t, k in distinct.items()]
    s = spans.SharedSpans(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text", 20, 10)
    got = defaultdict(set)
    for r in s.intervals().collect():
        got[r.text_key] |= set(range(r.start, r.end))
    seen = defaultdict(set)
    for k, t in rep:
        for i in range(len(t) - 19):
            seen[t[i : i + 20]].add(k)
    want = defaultdict(set)
    for k, t in rep:
        for i in range(len(t) - 19):
            if len(seen[t[i : i + 20]]) > 1:
                want[k] |= set(range(i, i + 20))
    assert {k: v for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_shared_spans_of_long_texts_and_none(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 700)
    spans._powers.cache_clear()
    rng = random.Random(9)
    text = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    p = text(40)
    long = text(3000) + p + text(2000)
    who, at, h = spans.seeds_of([long, text(100) + p], 40, 20)
    a = {x for x, w in zip(h, who) if w == 0}
    b = {x for x, w in zip(h, who) if w == 1}
    assert a & b
    spans._powers.cache_clear()
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.SharedSpans(empty, "doc_id", "text").pairs().count() == 0


def test_text_queries_run(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert queries.p10_shared(spark, DATA).count() == n
    c = queries.p9_containers(spark, DATA).first()
    assert c.tokens + c.unused == 2048 * c.containers
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in queries.p10_found(spark, DATA).collect()} == brute_pairs(docs, 200)

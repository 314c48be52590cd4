"""Variant spellings of names typed by people, linked to the names they stand for.

Names become sets of padded q-grams of their words; MinHash bands find candidates, the band layout chosen from the
collision curve for a wanted recall; Monge-Elkan similarity with word-level rules for initials, nicknames and typing
errors verifies them; star clustering makes the given names centers and gives every spelling to the most similar one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.spelling import looks, plain, spaced, word_distance
from quillon.session import broadcast_if_small, cut, spread

Q = 3
#: Jaccard similarity of q-gram sets that a true variant has at least (an initial for the first name and a typing
#: error in a short last name), and the share of such pairs that the bands must bring together.
LEAST_SIMILARITY, RECALL = 0.3, 0.995
#: Rows of a band; more rows make buckets smaller.
BAND_ROWS = 2
#: Similarity at which a spelling is taken for a center's.
ACCEPT = 0.8

#: Forms of address and degrees that are no part of a name: fixed values.
TITLES = frozenset("mr mrs ms miss mx dr prof professor sir dame phd md mba cfa cpa esq jr sr ii iii iv msc bsc ma ba".split())
#: Words between given and family names: fixed values.
PARTICLES = frozenset("de da do dos del della di du la le van von der den ter ten al el bin ibn st san o".split())
#: Given names and their familiar forms: fixed values.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex xander sasha alec lex sandy al", "alexandra": "alex sandra sasha lexi",
    "andrew": "andy drew", "anthony": "tony ant", "benjamin": "ben benji benny benjy", "cassandra": "cass cassie sandra",
    "catherine": "cathy kate katie cat", "charles": "charlie chuck chas", "charlotte": "charlie lottie", "christopher": "chris kit topher",
    "christina": "chris tina chrissy", "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie debby debra", "edward": "ed eddie ted teddy ned",
    "dimitri": "dima mitya dmitri dimi", "eleanor": "ellie nell nora", "elizabeth": "liz beth lizzie lizzy eliza betty betsy libby lisa bess", "emily": "em emmy", "francesca": "fran frankie cesca chesca",
    "francisco": "paco pancho cisco kiko frank fran", "frederick": "fred freddie freddy rick", "gabriel": "gabe gabi gab", "gabrielle": "gabby gabi", "gregory": "greg",
    "guillaume": "guy gui guigui", "isabella": "bella izzy isa ella", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny jenn",
    "johannes": "jo hannes hans jan johann", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "jose": "pepe", "josephine": "jo josie josephina",
    "katherine": "kate kathy katie kat kitty kay", "lawrence": "larry", "leonard": "leo len lenny lennie", "ivan": "vanya", "irina": "ira irisha", "maria": "mia maru", "mateo": "teo", "nadia": "nadya", "yuri": "yura", "magdalena": "magda lena maggie", "margaret": "maggie meg peggy marge margie greta megan madge",
    "matthew": "matt matty", "maximilian": "max maxi", "michael": "mike mick mickey mikey", "mohammed": "mo mohamed muhammad", "natalia": "nat talia natasha natalie", "nathaniel": "nat nate",
    "nicholas": "nick nico nicky klaus", "olivia": "liv livvy", "pamela": "pam", "patricia": "pat patty tricia trish patsy", "patrick": "pat paddy", "philip": "phil", "philippa": "pip pippa", "rebecca": "becca becky bex beck",
    "richard": "rick dick rich ricky richie", "robert": "bob rob bobby robbie bert", "ronald": "ron ronnie", "samantha": "sam sammy", "samuel": "sam sammy", "sebastian": "seb bas", "stephanie": "steph stevie stef", "stephen": "steve",
    "susan": "sue susie", "theodore": "ted theo teddy", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim timmy", "valentina": "val tina vale", "victoria": "vicky tori vic vicki",
    "vincent": "vince vinny", "william": "will bill billy liam willy willie", "zachary": "zach zack zak",
}
_FAMILIAR = {(short, full) for full, forms in NICKNAMES.items() for short in forms.split()}


@lru_cache(maxsize=200_000)
def parts(name: str) -> tuple[str, ...]:
    """Words of a name: plain, lower case, without titles; hyphens and apostrophes inside a word go, its parts stay one."""
    text = spaced(plain(name.strip()))
    text = re.sub(r"(?<=[^\W_])['’-](?=[^\W_])", "", text).lower()
    words = [w for w in re.split(r"[^a-z0-9]+", text) if w]
    kept = tuple(w for w in words if w not in TITLES)
    return kept or tuple(words)


def grams(name: str, q: int = Q) -> set[str]:
    """Padded q-grams of every word, lookalike characters made equal."""
    pad = "\0" * (q - 1)
    return {p[i : i + q] for w in parts(name) for p in [pad + looks(w) + pad] for i in range(len(p) - q + 1)}


@lru_cache(maxsize=500_000)
def _letters(word: str) -> tuple[int, int]:
    """The characters of a word, and of its form with lookalikes made equal, as bits."""
    bits = lambda w: sum(1 << b for b in {ord(c) & 63 for c in w})
    return bits(word), bits(looks(word))


def word_similarity(a: str, b: str) -> float:
    """1 for equal words, less for familiar forms, initials and typing errors, 0 for different words.

    An edit adds and takes away one kind of character at most, so words too different in their characters are told apart
    without their distance.
    """
    if a == b:
        return 1.0
    if (a, b) in _FAMILIAR or (b, a) in _FAMILIAR:
        return 0.95
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) == 1:
        return 0.85 if long[0] == short else 0.0
    edits = 2 if len(short) >= 5 else 1
    (x, lx), (y, ly) = _letters(a), _letters(b)
    if (x ^ y).bit_count() > 2 * edits and (lx ^ ly).bit_count() > 2 * (edits - 1):
        return 0.0
    d = word_distance(a, b)
    if d == 1:
        return 0.9 if len(long) > 3 else 0.8
    if d == 2 and len(short) >= 5:
        return 0.75
    return 0.0


def _monge_elkan(of: tuple[str, ...], to: tuple[str, ...]) -> float:
    """Mean over the words of one name of their best similarity in the other, long words counting for more."""
    weight = [min(len(w), 6) for w in of]
    return sum(n * max((word_similarity(w, v) for v in to), default=0.0) for n, w in zip(weight, of)) / sum(weight)


def similarity(a: str, b: str) -> float:
    """Symmetric Monge-Elkan similarity of two names; the lesser side where both last names must agree.

    Middle initials and particles that only one side has are passed over; a name that is one word is compared with the
    other's words run together as well.
    """
    x, y = parts(a), parts(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    run = 0.0
    # A lost blank joins two words, a stray one parts a word: the letters in order then tell.
    if len(x) != len(y) and min(len(jx := "".join(x)), len(jy := "".join(y))) >= 6 and abs(len(jx) - len(jy)) <= 2:
        d = word_distance(jx, jy)
        run = 1.0 - 0.05 * d if d <= 2 else 0.0
    full = lambda n: [w for w in n if len(w) > 1 and w not in PARTICLES]
    fx, fy = full(x), full(y)
    if not fx or not fy:
        return run
    # Every full word must find its partner, save a middle initial or particle: the family name can't be left out.
    if not any(word_similarity(v, w) >= 0.75 for v in fx for w in fy):
        return run
    main = lambda n, m: tuple(w for w in n if len(w) > 1 and w not in PARTICLES or len(n) <= 2 or max(word_similarity(w, v) for v in m) > 0)
    mx, my = main(x, y), main(y, x)
    if len(mx) < 2 or len(my) < 2:
        return run
    strongest = max((word_similarity(v, w) for v in fx for w in fy if min(len(v), len(w)) >= 3), default=0.0)
    if strongest < 0.75 or not _paired(mx, my):
        return run
    return max(run, min(_monge_elkan(mx, my), _monge_elkan(my, mx)))


def _paired(x: tuple[str, ...], y: tuple[str, ...]) -> bool:
    """Whether the words of the shorter name find different partners in the other."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    left = list(long)
    for w in sorted(short, key=lambda w: -max(word_similarity(w, v) for v in long)):
        best = max(left, key=lambda v: word_similarity(w, v))
        if word_similarity(w, best) == 0:
            return False
        left.remove(best)
    return True


def bands_for(similarity: float = LEAST_SIMILARITY, recall: float = RECALL, rows: int = BAND_ROWS) -> int:
    """Bands so that 1 - (1 - s^rows)^bands reaches ``recall`` at similarity s."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _signatures(names: list[str], bands: int, rows: int):
    """One array of band keys per name."""
    import numpy as np
    import xxhash

    rng = np.random.default_rng(20_240_607)
    a = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 62, bands * rows, dtype=np.uint64)
    mix = rng.integers(1, 1 << 62, rows, dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(names), bands), np.int64)
    for i, name in enumerate(names):
        h = np.array([xxhash.xxh64_intdigest(g) for g in grams(name)] or [0], np.uint64)
        m = h[:, None] * a[None, :] + b[None, :]
        m ^= m >> np.uint64(31)
        least = (m * np.uint64(0x9E3779B97F4A7C15)).min(axis=0).reshape(bands, rows)
        out[i] = ((least ^ (least >> np.uint64(29))) * mix[None, :]).sum(axis=1, dtype=np.uint64).view(np.int64)
    return out


def banded(df: DataFrame, name: str, bands: int, rows: int = BAND_ROWS) -> DataFrame:
    """(name, band_keys array<bigint>): key i belongs to band i; names without letters or digits have no keys."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            names = [n for n in batch["name"].tolist() if parts(n)]
            yield pd.DataFrame({"name": names, "band_keys": list(_signatures(names, bands, rows))})

    return spread(df.select(F.col(name).alias("name")).filter("name is not null")).mapInPandas(run, "name string, band_keys array<bigint>")


def candidates(left: DataFrame, right: DataFrame, least: float = LEAST_SIMILARITY, rows: int = BAND_ROWS) -> DataFrame:
    """(name, center): every name of ``left`` with each name of ``right`` that shares a band; pairs may repeat.

    Both have distinct values in ``name``. Bands join by key.
    """
    n = bands_for(least, rows=rows)
    keyed = lambda df: banded(df, "name", n, rows).select("name", F.posexplode("band_keys").alias("band", "key"))
    centers = broadcast_if_small(cut(keyed(right).withColumnRenamed("name", "center")))
    return keyed(left).join(centers, ["band", "key"]).select("name", "center")


#: Centers that one row of gathered pairs holds, about, at most.
ROW_CENTERS = 10_000


def verified(pairs: DataFrame, centers: int, accept: float = ACCEPT) -> DataFrame:
    """(name, center, similarity) of candidate pairs at or above ``accept``, each once.

    Pairs are folded by name, partly before they shuffle, into as many rows as keep ROW_CENTERS of all ``centers`` to a row,
    and then spread evenly over all tasks, so neither a name that meets many centers nor small bytes make one task long.
    """

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = [(n, c, s) for n, cs in zip(batch["name"], batch["centers"]) for c in cs if (s := similarity(n, c)) >= accept]
            yield pd.DataFrame(out, columns=["name", "center", "similarity"])

    part = F.pmod(F.xxhash64("center"), F.lit(centers // ROW_CENTERS + 1)).alias("part")
    met = pairs.groupBy("name", part).agg(F.collect_set("center").alias("centers"))
    return spread(met, "name", "part").mapInPandas(run, "name string, center string, similarity double")


def link(spellings: DataFrame, centers: DataFrame, accept: float = ACCEPT, least: float = LEAST_SIMILARITY, rows: int = BAND_ROWS) -> DataFrame:
    """(name, center, similarity) of distinct spellings that stand for a center; exact centers are their own.

    spellings and centers have a column ``name``; nulls, blanks and names without letters or digits link to nothing;
    repeated names count once. Star clustering with the given centers decides; a spelling as similar to two centers stays
    unlinked. More ``rows`` to a band keep chance meetings rare where there are many centers.
    """
    left = spellings.select("name").filter("name is not null").distinct()
    right = centers.select("name").filter("name is not null").distinct()
    near = cut(verified(candidates(left, right, least, rows), right.count(), accept))
    edges = near.filter("name <> center").select(F.col("name").alias("a"), F.col("center").alias("b"), "similarity")
    known = right.withColumn("given", F.lit(True))
    met = near.select("name").union(near.select("center")).distinct().join(known, "name", "left").select("name", F.coalesce("given", F.lit(False)).alias("given"), F.lit(0).alias("weight"))
    clusters = star_clusters(edges, met, given=True)
    ends = clusters.join(known.select(F.col("name").alias("center")), "center", "left_semi").join(left, "name", "left_semi")
    scored = near.select("name", "center", "similarity")
    return ends.join(scored, ["name", "center"]).select("name", "center", "similarity")


def star_clusters(edges: DataFrame, vertices: DataFrame, given: bool = False) -> DataFrame:
    """(name, center) of all vertices by star clustering of a similarity graph.

    edges (a, b, similarity) once per pair; vertices (name, weight), and with ``given`` a boolean ``given``: those are
    centers whatever their neighbours, and no other vertex becomes one while a given one is near it. In each round a free
    vertex that outranks all its free neighbours, by degree, weight, hash, then name, becomes a center and takes its free
    neighbours, each going to its most similar new center. One as similar to two is its own center, as are isolated
    vertices. In every round the highest free vertex becomes a center, so rounds end when none is free.
    """
    both = edges.select("a", "b", "similarity").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).filter("a <> b")
    both = cut(both.groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    degree = both.groupBy("a").agg(F.count("*").alias("degree"))
    first = F.coalesce("given", F.lit(False)) if given else F.lit(False)
    rank = F.struct(first.alias("g"), F.coalesce("degree", F.lit(0)).alias("d"), F.col("weight").alias("w"), F.xxhash64("name").alias("h"), F.col("name").alias("n")).alias("rank")
    free = cut(vertices.join(degree, F.col("name") == F.col("a"), "left").select("name", rank))
    done = None
    while not free.isEmpty():
        ranked = both.join(free.select(F.col("name").alias("a"), F.col("rank").alias("mine")), "a").join(free.select(F.col("name").alias("b"), F.col("rank").alias("theirs")), "b")
        beaten = ranked.filter("theirs > mine and not mine.g").select(F.col("a").alias("name")).distinct()
        centers = cut(free.join(beaten, "name", "left_anti").select("name"))
        satellites = both.join(centers.withColumnRenamed("name", "a"), "a").join(free.select(F.col("name").alias("b")), "b")
        satellites = satellites.join(centers.withColumnRenamed("name", "b"), "b", "left_anti")
        top = satellites.groupBy("b").agg(F.max("similarity").alias("top"))
        best = satellites.join(top, "b").filter("similarity >= top - 1e-9").groupBy("b").agg(F.count("*").alias("n"), F.min("a").alias("center"))
        taken = best.select(F.col("b").alias("name"), F.when(F.col("n") == 1, F.col("center")).otherwise(F.col("b")).alias("center"))
        now = cut(taken.union(centers.select("name", F.col("name").alias("center"))))
        done = now if done is None else done.union(now)
        free = cut(free.join(now, "name", "left_anti"))
    return done if done is not None else vertices.select("name", F.col("name").alias("center"))

"""Bounded paths from seeds over an undirected graph, and the access score of the best one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import clip, days_between
from quillon.functions.numbers import lookup as numbers_lookup
from quillon.session import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, without loops: src, dst and the other columns."""
    other = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *other)
    return edges.select("src", "dst", *other).unionByName(back).filter("src <> dst")


def paths(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(seed, target, hops, first_hop, weakest, verified, confidence, path) of simple paths that end at first reach.

    edges: src, dst, strength (int), undirected() already, and if known verified (timestamp) and confidence; of
    parallel edges the strongest counts. seeds: node. A path of n+1 edges goes on from a path of n whose end is no
    neighbour of the seed at a lesser depth. Of the paths alike in (seed, target, hops, first hop) only the strongest is
    kept, in a combined maximum before the shuffle, so parallel routes don't multiply. verified is the oldest known
    verification on the path, confidence the mean of the known ones, path its nodes.
    """
    given = lambda c, kind: F.col(c).cast(kind) if c in edges.columns else F.lit(None).cast(kind)
    told = given("confidence", "double")
    edge = F.struct("strength", given("verified", "timestamp").alias("verified"), F.coalesce(told, F.lit(0.0)).alias("sum"), told.isNotNull().cast("int").alias("known"))
    e = edges.groupBy("src", "dst").agg(F.max(edge).alias("e")).select("src", "dst", "e.*")
    s = seeds.select(F.col("node").alias("seed")).distinct()
    carried = ("verified", "sum", "known")
    step = s.join(e, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("target"), F.lit(1).alias("hops"), F.col("dst").alias("first_hop"), F.col("strength").alias("weakest"), *carried, F.array("seed", "dst").alias("path"))
    best = F.max(F.struct("weakest", *carried, "path")).alias("b")
    out, frontier, seen = step, step, step.select("seed", "target")
    for n in range(2, hops + 1):
        ahead = e.withColumnsRenamed({c: f"next_{c}" for c in carried})
        onward = frontier.join(ahead, F.col("target") == F.col("src")).filter("dst <> seed and dst <> first_hop")
        onward = onward.select(
            "seed", F.col("dst").alias("target"), F.lit(n).alias("hops"), "first_hop", F.least("weakest", "strength").alias("weakest"),
            F.least("verified", "next_verified").alias("verified"), (F.col("sum") + F.col("next_sum")).alias("sum"), (F.col("known") + F.col("next_known")).alias("known"), F.array_append("path", F.col("dst")).alias("path"),
        )
        step = onward.groupBy("seed", "target", "hops", "first_hop").agg(best).select("seed", "target", "hops", "first_hop", "b.*")
        out = out.unionByName(step)
        frontier = step.join(seen.distinct(), ["seed", "target"], "left_anti")
        seen = seen.unionByName(step.select("seed", "target"))
    mean = F.round(F.col("sum") / F.nullif(F.col("known"), F.lit(0)), 3)
    return out.select("seed", "target", "hops", "first_hop", "weakest", "verified", mean.alias("confidence"), "path")


def routes(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(first_hop, target, hops, paths, weakest): of how many seeds a path of up to three hops leads by a first hop to a target.

    The paths are those of paths(), but counted and not listed: a hub of n neighbours alone would have n² of two hops. edges:
    src, dst, strength (few ranks), each in both directions; parallel edges are paths of one hop each, one edge further on; a
    loop counts as a first and as a last step. seeds: node. weakest is that of the strongest path, null at three hops.

    Seeds of a first hop are its neighbours, so two hops are counted by edge. At three hops all seeds of the first hop count
    but the target and those for which every middle node is blocked, being the seed or its neighbour. Listed are the pairs of
    edges behind first hops, at the cost of the middle nodes' squared degrees.
    """
    s = cut(seeds.select("node").filter("node is not null").distinct())
    u = cut(edges.select("src", "dst", "strength"))
    one = u.join(s, F.col("src") == F.col("node"), "left_semi").groupBy(F.col("dst").alias("first_hop")).agg(F.count("*").alias("paths"), F.max("strength").alias("weakest"))
    e = cut(u.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.max("strength").alias("strength")))
    start = e.join(s, F.col("src") == F.col("node"), "left_semi").select(F.col("src").alias("seed"), F.col("dst").alias("first_hop"), "strength")
    levels = F.sort_array(F.collect_list(F.struct("strength", "n")), False)
    by = start.groupBy("first_hop", "strength").agg(F.count("*").alias("n")).groupBy("first_hop").agg(F.sum("n").alias("seeds"), levels.alias("levels"))
    ahead = e.filter("src <> dst").select(F.col("src").alias("first_hop"), F.col("dst").alias("target"), "strength")
    # The target may be a seed of the hop before it, over the same edge.
    own = F.col("node").isNotNull()
    alone = own & (F.col("levels")[0]["strength"] == F.col("strength")) & (F.col("levels")[0]["n"] == 1)
    before = F.when(alone, F.get("levels", F.lit(1))["strength"]).otherwise(F.col("levels")[0]["strength"])
    two = ahead.join(by, "first_hop").join(s, F.col("target") == F.col("node"), "left")
    two = two.select("first_hop", "target", (F.col("seeds") - own.cast("bigint")).alias("paths"), F.least("strength", before).alias("weakest"))

    near = start.filter("seed <> first_hop").select("seed", "first_hop")
    firsts = near.groupBy("first_hop").agg(F.count("*").alias("seeds"))
    last = e.select(F.col("src").alias("mid"), F.col("dst").alias("target"))
    middle = ahead.select("first_hop", F.col("target").alias("mid")).join(firsts.select("first_hop"), "first_hop", "left_semi")
    pairs = middle.join(last, "mid").filter("target <> first_hop").select("first_hop", "mid", "target")
    known = pairs.filter("target <> mid").join(near, (near["first_hop"] == pairs["first_hop"]) & (F.col("seed") == F.col("target"))).select("seed", pairs["first_hop"], "mid")
    blocked = near.select("seed", "first_hop", F.col("seed").alias("mid")).unionByName(known)
    through = pairs.groupBy("first_hop", "target").agg(F.count("*").alias("mids"))
    barred = blocked.join(last, "mid").filter("target <> first_hop and target <> seed").groupBy("seed", "first_hop", "target").agg(F.count("*").alias("n"))
    barred = barred.join(through, ["first_hop", "target"]).filter("n = mids").groupBy("first_hop", "target").agg(F.count("*").alias("barred"))
    three = through.join(firsts, "first_hop").join(near.select("first_hop", F.col("seed").alias("target"), F.lit(1).alias("own")), ["first_hop", "target"], "left").join(barred, ["first_hop", "target"], "left")
    left = F.col("seeds") - F.coalesce("own", F.lit(0)) - F.coalesce("barred", F.lit(0))
    three = three.select("first_hop", "target", left.alias("paths"), F.lit(None).cast(e.schema["strength"].dataType).alias("weakest"))

    one = one.withColumn("target", F.col("first_hop"))
    parts = [x.filter("paths > 0").select("first_hop", "target", F.lit(n).alias("hops"), "paths", "weakest") for n, x in ((1, one), (2, two), (3, three))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def access(found: DataFrame, base: Column, bonus: float = 4.0, most_bonus: float = 8.0, as_of: Column | None = None, stale_after: float = 365.0, per_month: float = 4.0, most_penalty: float = 15.0, floor: float = 0.5) -> DataFrame:
    """(target, hops, base, routes, score, path) of the best path to each target.

    ``base`` is a column over hops and weakest, null for a path of unknown strength; a target with only such paths has
    a null score. Routes are distinct first hops; each beyond the first adds ``bonus``. With ``as_of`` a path whose
    oldest verification is older than ``stale_after`` days loses ``per_month`` for every 30 days more; a known mean
    confidence multiplies, by ``floor`` at least. Ties in base go to fewer hops, then to the least path.
    """
    scored = found.withColumn("base", base)
    order = F.struct(F.col("base").isNull(), -F.coalesce("base", F.lit(0.0)), "hops", "path")
    by = scored.groupBy("target").agg(F.min_by(F.struct("base", "hops", "verified", "confidence", "path"), order).alias("b"), F.count_distinct("first_hop").alias("routes"))
    score = F.col("b.base") + F.least(F.lit(most_bonus), bonus * (F.col("routes") - 1))
    if as_of is not None:
        over = days_between(F.col("b.verified"), as_of) - stale_after
        score = score - F.when(over > 0, F.least(F.lit(most_penalty), per_month * over / 30.0)).otherwise(0.0)
    score = score * F.when(F.col("b.confidence").isNotNull(), F.greatest(F.lit(floor), F.col("b.confidence"))).otherwise(1.0)
    return by.select("target", "b.hops", "b.base", "routes", F.round(clip(score, 0.0, 100.0), 4).alias("score"), "b.path")


#: Ranks of relation strengths; others rank 0, which is unknown: fixed values.
STRENGTH = {"WEAK": 1, "MODERATE": 2, "STRONG": 3, "DIRECT": 4}


def path_base(config: dict) -> Column:
    """Base of a path over columns hops and weakest, from a table HOP1_STRONG .. HOP3_ANY; null for an unknown strength
    within two hops. A direct relation has no entry of its own in the table and counts as unknown strength."""
    table = config["path_base"]
    by = lambda hops: numbers_lookup(F.col("weakest"), {rank: float(table.get(f"HOP{hops}_{word}", 0)) for word, rank in STRENGTH.items() if rank <= 3})
    return F.when(F.col("hops") == 1, by(1)).when(F.col("hops") == 2, by(2)).otherwise(float(table.get("HOP3_ANY", 0)))


def access_scores(people: DataFrame, edges: DataFrame, seeds: DataFrame, config: dict, as_of: Column) -> DataFrame:
    """(node, access, hops, weakest, routes, path) of every person: column ``node`` of people and of seeds.

    A seed scores as a direct contact; whoever no path reaches scores zero, which is known; whoever only paths of unknown
    strength reach has a null score. Rounded to 2.
    """
    adjust = config.get("adjustments", {})
    many, stale, clamp = adjust.get("independent_paths", {}), adjust.get("staleness", {}), adjust.get("confidence_clamp", {})
    found = paths(undirected(edges), seeds, int(config.get("max_hops", 3)))
    if not clamp.get("enabled"):
        found = found.withColumn("confidence", F.lit(None).cast("double"))
    best = access(
        found, path_base(config), bonus=float(many.get("per_extra_path", 4)), most_bonus=float(many.get("max_bonus", 8)), as_of=as_of, stale_after=float(stale.get("threshold_days", 365)),
        per_month=float(stale.get("per_month_penalty", 4)), most_penalty=float(stale.get("max_penalty", 15)), floor=float(clamp.get("floor", 0.5)),
    )
    reached = best.select(F.col("target").alias("node"), "score", "hops", "routes", "path", F.lit(True).alias("__reached"))
    marked = people.join(seeds.select("node").distinct().withColumn("__seed", F.lit(True)), "node", "left").join(reached, "node", "left")
    score = F.when(F.col("__seed"), float(config["path_base"]["DIRECT"])).when(F.col("__reached"), F.round("score", 2)).otherwise(0.0)
    seed = F.coalesce("__seed", F.lit(False))
    return marked.select(
        "node", score.alias("access"), F.when(seed, 0).otherwise(F.col("hops")).alias("hops"), F.when(seed, F.lit(1)).otherwise(F.coalesce("routes", F.lit(0))).cast("bigint").alias("routes"),
        F.when(seed, F.array("node")).otherwise(F.col("path")).alias("path"),
    )

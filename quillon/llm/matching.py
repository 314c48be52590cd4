"""Matching entities of two tables without a common key.

Records, their attributes and the attributes' tokens form a graph. Random walks over it train skip-gram vectors of the
tokens, kept in a table of fixed size by hashing, so the model is bounded however large the corpus. A record's vectors
(per attribute and as a whole) are weighted means of its tokens' vectors; random hyperplanes in many tables block
them; the pairs that meet are reranked exactly, and cosines are calibrated to a confidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import cut, spread

#: The hashed table of token vectors.
BUCKETS, DIMENSIONS = 1 << 15, 64
#: Walk length in tokens, walks from each record, negatives per pair and passes of the training.
WALK, WALKS, NEGATIVES, PASSES = 5, 4, 4, 2
#: Shards of the training: one for each SHARD_WALKS walks, SHARDS at least; their tables are averaged MEANS at a time.
SHARD_WALKS, SHARDS, MEANS = 100_000, 24, 64
WINDOW, RATE = 3, 0.05
#: Incident records of a token that are mixed in one task; hotter tokens are split at random.
MIX = 2_000
#: Hyperplane tables of a view that tolerates differences, and hyperplanes of a table at most.
TABLES, MOST_BITS = 48, 32
#: Right records that share a value and need no hyperplanes to be told apart.
FEW = 8
#: Pairs on which the confidence is fitted, at most.
CALIBRATION_ROWS = 50_000


@dataclass(frozen=True)
class View:
    """Attributes that make a vector; ``each``: one vector for each value."""

    attributes: tuple[str, ...]
    each: bool = False


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def walks(edges: DataFrame, length: int = WALK, per_record: int = WALKS, seed: int = 7) -> DataFrame:
    """(walk array<int>): token buckets met on random walks record - token - record - ...

    edges: record, token, distinct. A step from a token goes to the record after this one in a random order of the
    token's records; hot tokens are split at random into groups of about MIX first, which leaves the choice as random
    and no task with more than a group. Random numbers are hashes of the edge and the round, so lost tasks repeat them.
    """
    e = edges.select("record", "token", bucket(F.col("token")).alias("b")).distinct()
    degree = e.groupBy("token").agg(F.count("*").alias("degree"))
    rounds = F.explode(F.sequence(F.lit(0), F.lit(per_record - 1))).alias("round")
    spread_ = e.join(degree, "token").select("record", "token", "b", "degree", rounds)
    spread_ = spread_.withColumn("die", F.xxhash64(F.lit(seed), "round", "record", "token"))
    group = F.pmod(F.shiftright("die", 7), F.greatest(F.lit(1), F.floor(F.col("degree") / MIX))).alias("part")
    w = Window.partitionBy("round", "token", "part").orderBy("die", "record")
    steps = spread_.select("round", "record", "token", "b", "die", group).withColumn("next", F.coalesce(F.lead("record").over(w), F.first("record").over(w)))
    steps = steps.select("round", "record", "b", "next", F.xxhash64("die", F.lit(1)).alias("choice"))
    # Two random edges of each record serve all walks that come through it in one round.
    two = [f(F.struct("b", "next"), "choice").alias(n) for f, n in ((F.min_by, "a"), (F.max_by, "z"))]
    way = cut(steps.groupBy("round", "record").agg(*two))
    line = way.select("round", F.array("a.b", "z.b").alias("walk"), F.col("z.next").alias("at"))
    for _ in range((length - 1) // 2):
        line = line.join(way.select("round", F.col("record").alias("at"), "a", "z"), ["round", "at"])
        line = line.select("round", F.concat("walk", F.array("a.b", "z.b")).alias("walk"), F.col("z.next").alias("at"))
    return line.select("walk")


def _train(shard_rows: Iterator, start, rate: float, seed: int):
    """Skip-gram with negative samples over the walks of one shard; returns the moved table and the pairs seen."""
    import numpy as np

    rng = np.random.default_rng(seed)
    vectors, contexts = start[0].astype(np.float32), start[1].astype(np.float32)
    seen = 0
    for walk in shard_rows:
        a, b = [], []
        for gap in range(1, WINDOW + 1):
            a += [walk[:, :-gap].ravel(), walk[:, gap:].ravel()]
            b += [walk[:, gap:].ravel(), walk[:, :-gap].ravel()]
        center, context = np.concatenate(a), np.concatenate(b)
        order = rng.permutation(len(center))
        for s in range(0, len(order), 2048):
            i = order[s : s + 2048]
            c, o = center[i], context[i]
            n = context[rng.integers(0, len(context), (len(i), NEGATIVES))]
            v, u, un = vectors[c], contexts[o], contexts[n]
            g = 1 / (1 + np.exp(-np.clip((v * u).sum(1), -8, 8))) - 1
            gn = 1 / (1 + np.exp(-np.clip((un * v[:, None, :]).sum(2), -8, 8)))
            dv = g[:, None] * u + (gn[:, :, None] * un).sum(1)
            np.add.at(vectors, c, -rate * dv)
            np.add.at(contexts, o, -rate * g[:, None] * v)
            np.add.at(contexts, n.ravel(), (-rate * gn[:, :, None] * v[:, None, :]).reshape(-1, v.shape[1]))
        seen += len(order)
    return vectors, contexts, seen


def fit(walk_rows: DataFrame, passes: int = PASSES, seed: int = 11):
    """The token table trained on all walks: shards train side by side and their tables are averaged after each pass.

    The table, BUCKETS x DIMENSIONS floats, is all that the driver ever holds; shards grow in number with the walks and are
    averaged on executors, MEANS parts in a task.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIMENSIONS**0.5, (BUCKETS, DIMENSIONS)).astype(np.float32)
    contexts = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    data = cut(walk_rows)
    shards = max(SHARDS, -(-data.count() // SHARD_WALKS))
    data = cut(data.repartition(shards, F.xxhash64("walk")))
    chunk = BUCKETS // 64
    for p in range(passes):
        # Half precision is enough to start from and to average, and halves what passes through the driver.
        start = data.sparkSession.sparkContext.broadcast((vectors.astype(np.float16), contexts.astype(np.float16)))
        rate = RATE * (1 - p / (passes + 1))

        def run(batches: Iterator, start=start, rate=rate, p=p) -> Iterator:
            import pandas as pd

            rows = (np.stack(b["walk"].to_numpy()) for b in batches if len(b))
            v, c, seen = _train(rows, start.value, rate, seed + p)
            if seen:
                both = np.concatenate([v, c], axis=1).astype(np.float16)
                group = int(TaskContext.get().partitionId()) // MEANS
                for i in range(64):
                    yield pd.DataFrame({"chunk": [i], "part": [group], "seen": [float(seen)], "table": [both[i * chunk : (i + 1) * chunk].tobytes()]})

        def mean(key, frame):
            import pandas as pd

            tables = np.stack([np.frombuffer(t, np.float16) for t in frame["table"]])
            whole = np.average(tables.astype(np.float32), axis=0, weights=frame["seen"]).astype(np.float16).tobytes()
            return pd.DataFrame({"chunk": [key[0]], "part": [key[1] // MEANS], "seen": [frame["seen"].sum()], "table": [whole]})

        kind = "chunk int, part int, seen double, table binary"
        moved = data.mapInPandas(run, kind)
        groups = -(-shards // MEANS)
        while True:
            moved = moved.groupBy("chunk", "part").applyInPandas(mean, kind)
            if groups == 1:
                break
            groups = -(-groups // MEANS)
        parts = moved.select("chunk", "table").collect()
        for r in parts:
            both = np.frombuffer(r["table"], np.float16).reshape(chunk, 2 * DIMENSIONS)
            vectors[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = both[:, :DIMENSIONS]
            contexts[r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = both[:, DIMENSIONS:]
        start.destroy()
    return spread_out(vectors, data)


#: Directions that all frequent tokens share and that tell no records apart; taken out of the vectors.
COMMON = 3


def spread_out(vectors, walk_rows: DataFrame):
    """Unit vectors without their common direction: the mean and the first COMMON components, weighted by occurrence.

    Skip-gram vectors of frequent tokens crowd into a narrow cone, where every hyperplane leaves all on one side.
    Occurrences are counted over all walks; there are at most BUCKETS of them.
    """
    import numpy as np

    counts = np.full(BUCKETS, 1e-3, np.float32)
    met = walk_rows.select(F.explode("walk").alias("b")).groupBy("b").count().toPandas()
    counts[met["b"].to_numpy()] = met["count"].to_numpy()
    v = vectors.astype(np.float32)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    v -= counts @ v / counts.sum()
    _, axes = np.linalg.eigh((v * counts[:, None]).T.astype(np.float64) @ v)
    top = axes[:, -COMMON:].astype(np.float32)
    v -= (v @ top) @ top.T
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return v


def _seeded(bits: int, tables: int, seed: int):
    import numpy as np

    return np.random.default_rng(seed).normal(size=(tables * bits, DIMENSIONS)).astype(np.float32)


def hashed(views: DataFrame, table, bits: dict[str, int], tables: dict[str, int], seed: int = 23) -> DataFrame:
    """(record, view, vector, keys) of rows record, view, tokens array<int>, weights array<double>.

    A vector is the weighted mean of its tokens' unit vectors; key i of a view is its side of ``bits`` hyperplanes.
    """
    import numpy as np

    unit = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    shared = views.sparkSession.sparkContext.broadcast(unit.astype(np.float16))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        planes = {v: _seeded(bits[v], tables[v], seed + i) for i, v in enumerate(sorted(bits))}
        units = shared.value.astype(np.float32)
        for batch in batches:
            vectors = np.zeros((len(batch), DIMENSIONS), np.float32)
            for i, (t, w) in enumerate(zip(batch["tokens"], batch["weights"])):
                vectors[i] = np.asarray(w, np.float32) @ units[np.asarray(t, int)]
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            keys: list = [None] * len(batch)
            for v in batch["view"].unique():
                at = np.nonzero((batch["view"] == v).to_numpy())[0]
                sides = (vectors[at] @ planes[v].T > 0).reshape(len(at), tables[v], bits[v])
                numbers = sides @ (1 << np.arange(bits[v], dtype=np.int64))
                for i, row in zip(at, numbers):
                    keys[i] = row
            yield pd.DataFrame({"record": batch["record"], "view": batch["view"], "vector": list(vectors), "keys": keys})

    return spread(views, "record").mapInPandas(run, "record string, view string, vector array<float>, keys array<bigint>")


def blocked(left: DataFrame, right: DataFrame, met_in: DataFrame, bears: DataFrame) -> DataFrame:
    """Pairs (left_record, right_record) that share a value and there a key of a table of a view; pairs may repeat.

    left and right: record, view, keys, of MOST_BITS sides each. met_in: left_record, value; bears: right_record, value. Of
    a key only so many sides count as tell the right records of the value apart, none for up to FEW of them: a rare value
    brings all its records together, and one that a third of all records have is cut as finely as the whole table would be.
    A bucket that is hot all the same is split by the optimizer's skew join.
    """
    sizes = bears.groupBy("value").agg(F.count("*").alias("n"))
    sides_ = F.when(F.col("n") <= FEW, 0).otherwise(F.least(F.lit(MOST_BITS), F.ceil(F.log2("n")).cast("int"))).cast("int")
    bits = cut(sizes.select("value", sides_.alias("bits")))
    many = bits.filter("bits > 0")

    def keyed(values: DataFrame, side_: DataFrame, name: str) -> DataFrame:
        rows = values.join(many, "value").join(side_.select(F.col("record").alias(name), "view", "keys"), name)
        mask = F.expr("shiftleft(1L, bits) - 1")
        return rows.select(name, "value", "bits", "view", F.posexplode("keys").alias("number", "key")).withColumn("key", F.xxhash64("value", "view", "number", F.col("key").bitwiseAND(mask))).select(name, "key")

    near = keyed(met_in, left, "left_record").join(keyed(bears, right, "right_record"), "key").select("left_record", "right_record")
    few = bits.filter("bits = 0").select("value")
    all_ = met_in.join(few, "value").join(bears, "value").select("left_record", "right_record")
    return near.union(all_)


def curve(pairs: DataFrame, score: str, label: str) -> tuple[float, float, int, float]:
    """(intercept, slope, rows, error) of a logistic curve of truth over a score.

    Fitted by Newton steps on the driver on at most CALIBRATION_ROWS labelled pairs, those of least hash of all their
    columns; every second one is held out, and error is the mean distance, over tenths of the held-out scores, of their
    mean confidence and their share of true labels. With one kind of label only, the curve is its share.
    """
    import numpy as np

    sample = pairs.filter(f"{score} is not null and {label} is not null").select(F.col(score).cast("double"), F.col(label).cast("double"), F.xxhash64(*pairs.columns).alias("h"))
    rows = np.array([(r[0], r[1]) for r in sample.orderBy("h").limit(CALIBRATION_ROWS).collect()] or [(0.0, 0.0)])
    own, held = rows[::2], rows[1::2] if len(rows) > 1 else rows
    x, y = np.stack([np.ones(len(own)), own[:, 0]], 1), own[:, 1]
    beta = np.zeros(2)
    if 0 < y.mean() < 1:
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            beta += np.linalg.solve(h, x.T @ (y - p) - 1e-3 * beta)
    else:
        share = (y.sum() + 1) / (len(y) + 2)
        beta[0] = np.log(share / (1 - share))
    said = 1 / (1 + np.exp(-(beta[0] + beta[1] * held[:, 0])))
    parts = [np.abs(said[i].mean() - held[i, 1].mean()) * len(i) for i in np.array_split(np.argsort(held[:, 0], kind="stable"), 10) if len(i)]
    return float(beta[0]), float(beta[1]), len(rows), float(sum(parts) / len(held))


def confident(pairs: DataFrame, score: str, intercept: float, slope: float) -> DataFrame:
    """``pairs`` with the confidence that a logistic curve reads from the score, null where the score is null."""
    return pairs.withColumn("confidence", F.round(1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * F.col(score)))), 4))


def calibrated(pairs: DataFrame, score: str, label: str) -> DataFrame:
    """``pairs`` with a confidence: the share of true labels at such a score, by curve(). Null labels teach nothing."""
    intercept, slope, _, _ = curve(pairs, score, label)
    return confident(pairs, score, intercept, slope)


class Space:
    """The vector space of two tables' records.

    Sides are rows (record, attribute, value, tokens array<string>), one per attribute value. Rows with null tokens
    speak for nothing. Walks, token weights and vectors cover all records of both sides.
    """

    def __init__(self, left: DataFrame, right: DataFrame):
        edges = cut(both_sides(left, right).select("record", F.explode("tokens").alias("token")).distinct())
        self.table = fit(walks(edges))
        n = right.select("record").distinct().count()
        document = edges.groupBy("token").agg(F.count("*").alias("df"))
        self.weights = cut(document.select("token", F.log(F.lit(2.0 + n) / F.col("df")).alias("idf")))

    def vectors(self, side: DataFrame, views: dict[str, View], bits: int = 0, tables: int = 0) -> DataFrame:
        """(record, view, vector, keys): each record's views, with ``tables`` keys of ``bits`` sides of hyperplanes."""
        tokens = side.select("record", "attribute", "value", F.explode("tokens").alias("token"))
        weighed = tokens.join(self.weights, "token").select("record", "attribute", "value", bucket(F.col("token")).alias("b"), "idf")
        out = None
        for view, v in views.items():
            rows = weighed.filter(F.col("attribute").isin(*v.attributes))
            by = ["record", "value"] if v.each else ["record"]
            grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("b", "idf"))).alias("t"))
            grouped = grouped.select("record", F.lit(view).alias("view"), F.col("t.b").alias("tokens"), F.col("t.idf").alias("weights"))
            out = grouped if out is None else out.unionByName(grouped)
        return hashed(out, self.table, dict.fromkeys(views, bits), dict.fromkeys(views, tables))


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of two sides in one table, their records marked L and R."""
    mark = lambda df, m: df.withColumn("record", F.concat(F.lit(m), "record"))
    return mark(left, "L").unionByName(mark(right, "R"))


def side(df: DataFrame, mark: str) -> DataFrame:
    """The rows of one side of both_sides(), the mark taken off."""
    return df.filter(F.col("record").startswith(mark)).withColumn("record", F.substring("record", 2, 1 << 30))


def cosine(pairs: DataFrame, a: DataFrame, b: DataFrame, view: str) -> DataFrame:
    """``pairs`` with the cosine of a view's vectors, null where a side has none."""
    of = lambda df, name, vec: df.filter(F.col("view") == view).select(F.col("record").alias(name), F.col("vector").alias(vec))
    joined = pairs.join(of(a, "left_record", "va"), "left_record", "left").join(of(b, "right_record", "vb"), "right_record", "left")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn("cosine", F.round(dot, 6)).drop("va", "vb")

"""Long exact spans shared between records.

Tokens are Unicode characters, so white space and letter case count. Every fixed-length window of every text gets its
Rabin-Karp hash. Three passes find the shared spans exactly without shuffling a hash for every position:

1. Seeds: of the hashes of ``seed`` characters each text sends the least of every ``length - seed + 1`` neighbouring
   ones (winnowing), about one in fifty. Any span of ``length`` characters holds such a run of neighbours, and equal
   text selects equal seeds, so two texts that share a span share a seed in it. Spark counts the seeds by text.
2. Windows: around repeated seeds only, the hashes of all windows of ``length`` characters, counted by text. A window
   found in two texts is a shared span; neighbouring repeated windows of a text merge into maximal intervals.
3. Groups: windows found in the same texts have the same signature, and one window stands for them all, so the texts
   of a shared passage are paired once and not once per character.

Equal texts are one text throughout and are spread to their records at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import broadcast_if_small, cut

LENGTH = 200
#: Characters of a seed for spans of LENGTH; the windows winnowed together are LENGTH - SEED + 1.
SEED = 100
#: Odd base of the rolling hash modulo 2^64: a fixed value.
BASE = 0x9E3779B97F4A7C15
#: Positions hashed at once; bounds a worker's memory. Longer texts are hashed in overlapping parts.
CHUNK = 1 << 20


@lru_cache(maxsize=2)
def _powers(n: int):
    import numpy as np

    def series(base: int):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return series(BASE), series(pow(BASE, -1, 1 << 64))


def window_hashes(codes, k: int):
    """Hash of every window of k of the given code points, mixed so that order says nothing about content."""
    import numpy as np

    up, down = _powers(2 * CHUNK)
    n = len(codes)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minima(h, w: int):
    """Least of every w neighbours, by running minima within blocks of w from both sides."""
    import numpy as np

    n = len(h)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _parts(texts: list[str], k: int) -> Iterator:
    """(codes, text number, start) of runs of whole texts, or of overlapping parts of one long text, up to CHUNK."""
    import numpy as np

    held, who, size = [], [], 0
    for i, t in enumerate(texts):
        c = _codes(t)
        if size and size + len(c) > CHUNK:
            yield np.concatenate(held), who
            held, who, size = [], [], 0
        at = 0
        while len(c) - at > CHUNK:
            yield c[at : at + CHUNK], [(i, at, CHUNK)]
            at += CHUNK - k + 1
        held.append(c[at:])
        who.append((i, at, len(c) - at))
        size += len(c) - at
    if held:
        yield np.concatenate(held), who


def seeds_of(texts: list[str], length: int, seed: int) -> tuple:
    """(text number, position, hash) arrays of the winnowed seeds; texts shorter than ``length`` have none."""
    import numpy as np

    w = length - seed + 1
    top = np.uint64(np.iinfo(np.uint64).max)
    whos, ats, hashes = [], [], []
    for codes, parts in _parts(texts, length):
        h = window_hashes(codes, seed)
        if not len(h):
            continue
        number = np.repeat(np.array([p[0] for p in parts]), np.array([p[2] for p in parts]))
        shift = np.repeat(np.array([p[1] for p in parts]) - np.concatenate([[0], np.cumsum([p[2] for p in parts])[:-1]]), np.array([p[2] for p in parts]))
        crossing = number[: len(h)] != number[seed - 1 :]
        h[crossing] = top
        if len(h) < w:
            continue
        least = window_minima(h, w)
        # A window of ``length`` characters must lie within one text.
        inside = number[: len(least)] == number[length - 1 : length - 1 + len(least)]
        # Position of the minimum: equal hashes in reach of the minimum's window are all kept, so ties need no rule.
        chosen = np.zeros(len(h), bool)
        widest = np.where(inside, least, np.uint64(0))
        # h[i] is chosen if it is the least of one of the windows i-w+1..i, i.e. if the largest of their minima equals it.
        reach = ~window_minima(~np.concatenate([np.zeros(w - 1, np.uint64), widest, np.zeros(w - 1, np.uint64)]), w)
        chosen = (reach[: len(h)] == h) & ~crossing
        at = np.nonzero(chosen)[0]
        whos.append(number[at])
        ats.append(at + shift[at])
        hashes.append(h[at])
    if not whos:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(whos), np.concatenate(ats), np.concatenate(hashes).view(np.int64)


def _seed_rows(length: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                keys = batch.column(0).slice(a, 500).to_numpy(zero_copy_only=False)
                who, at, h = seeds_of(batch.column(1).slice(a, 500).to_pylist(), length, seed)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.asarray(keys)[who] if len(who) else np.empty(0, np.int64), pa.int64()), pa.array(at.astype(np.int32))], ["seed", "text_key", "at"])

    return run


def _window_rows(length: int, seed: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys, texts, seeds = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for key, text, ats in zip(keys, texts.to_pylist(), seeds.to_pylist()):
                codes = _codes(text)
                marks = np.zeros(len(codes) - length + 2, np.int32)
                a = np.array(ats, np.int64)
                np.add.at(marks, np.clip(a + seed - length, 0, len(marks) - 1), 1)
                np.add.at(marks, np.clip(a + 1, 0, len(marks) - 1), -1)
                wanted = np.cumsum(marks)[:-1] > 0
                hs, ps = [], []
                for at in range(0, len(codes) - length + 1, CHUNK - length + 1):
                    h = window_hashes(codes[at : at + CHUNK], length)
                    keep = np.nonzero(wanted[at : at + len(h)])[0]
                    hs.append(h[keep])
                    ps.append(keep + at)
                h, p = np.concatenate(hs).view(np.int64), np.concatenate(ps).astype(np.int32)
                first = np.zeros(len(h), bool)
                first[np.unique(h, return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), key, np.int64)), pa.array(p), pa.array(first)], ["window", "text_key", "at", "first"])

    return run


class SharedSpans:
    """Spans of ``length`` or more characters shared by different texts of one table.

    key must be a unique int64; rows with a null key or text are left out, texts shorter than ``length`` share
    nothing. The text itself never leaves its partition but in the pass that looks again at texts with repeated seeds.
    """

    def __init__(self, df: DataFrame, key: str, text: str, length: int = LENGTH, seed: int = SEED):
        if not 0 < seed < length:
            raise ValueError("seed must be shorter than length")
        self.length = length
        rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).filter(f"key is not null and length(text) >= {length}")
        # Equal texts: members (key, text_key), where text_key is the least key of the text.
        hashed = rows.select("key", F.xxhash64("text").alias("h1"), F.crc32(F.col("text")).alias("h2"), F.length("text").alias("n"))
        first = hashed.groupBy("h1", "h2", "n").agg(F.min("key").alias("text_key"), F.count("*").alias("copies"))
        self.classes = cut(first)
        several = self.classes.filter("copies > 1")
        self.members = cut(hashed.join(broadcast_if_small(several), ["h1", "h2", "n"]).select("key", "text_key"))
        copies = broadcast_if_small(self.members.filter("key <> text_key").select("key"))
        single = rows.join(copies, "key", "left_anti")
        self.seeds = cut(single.mapInArrow(_seed_rows(length, seed), "seed bigint, text_key bigint, at int"))
        # A text sends a seed once per place; the partial count folds those before the shuffle.
        spread = self.seeds.groupBy("seed").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).filter("a <> b")
        repeated = broadcast_if_small(cut(spread.select("seed")))
        places = cut(self.seeds.join(repeated, "seed").select("text_key", "at").groupBy("text_key").agg(F.collect_list("at").alias("ats")))
        # A row of places holds an array, so fewer rows are proof of a small size.
        again = single.join(broadcast_if_small(places.withColumnRenamed("text_key", "key"), 20_000), "key")
        self.windows = cut(again.select("key", "text", "ats").mapInArrow(_window_rows(length, seed), "window bigint, text_key bigint, at int, first boolean"))
        mark = F.xxhash64("text_key")
        # A text's windows come from one row, which marks the first of each, so texts are counted without a distinct.
        held = self.windows.filter("first").groupBy("window")
        groups = held.agg(F.count("*").alias("texts"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("s"))
        self.groups = cut(groups.filter("texts > 1"))

    def passages(self) -> DataFrame:
        """(passage, text_key): the texts of each shared passage, one row for each; windows found in the same texts are one
        passage, named by the least of them. Linear in the texts, however many share one passage."""
        speaking = self.groups.groupBy("texts", "x", "s").agg(F.min("window").alias("window")).select("window")
        of = self.windows.filter("first").select("window", "text_key")
        return of.join(broadcast_if_small(cut(speaking)), "window").select(F.col("window").alias("passage"), "text_key")

    def text_pairs(self) -> DataFrame:
        """(a, b) of different texts, a < b, named by text_key."""
        of = cut(self.passages()).withColumnRenamed("passage", "window")
        left, right = of.withColumnRenamed("text_key", "a"), of.withColumnRenamed("text_key", "b")
        return left.join(right, "window").filter("a < b").select("a", "b").distinct()

    def pairs(self) -> DataFrame:
        """(key_a, key_b), key_a < key_b, of all records that share a span, copies of one text among them."""
        spread = self.members
        ends = self.text_pairs()
        left = spread.select(F.col("text_key").alias("a"), F.col("key").alias("key_a"))
        right = spread.select(F.col("text_key").alias("b"), F.col("key").alias("key_b"))
        across = ends.join(left, "a", "left").withColumn("key_a", F.coalesce("key_a", "a"))
        across = across.join(right, "b", "left").withColumn("key_b", F.coalesce("key_b", "b"))
        copies = left.withColumnRenamed("a", "t").join(right.withColumnRenamed("b", "t"), "t").filter("key_a < key_b").select("key_a", "key_b")
        ordered = across.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))
        return ordered.unionByName(copies)

    def intervals(self) -> DataFrame:
        """(text_key, start, end): maximal intervals of a text, each character of which lies in a span shared elsewhere."""
        found = self.windows.join(broadcast_if_small(self.groups.select("window")), "window").select("text_key", "at")
        w = Window.partitionBy("text_key").orderBy("at")
        apart = (F.col("at") > F.lag("at").over(w) + self.length).cast("int")
        runs = found.withColumn("new", F.coalesce(apart, F.lit(1))).withColumn("run", F.sum("new").over(w))
        return runs.groupBy("text_key", "run").agg(F.min("at").alias("start"), (F.max("at") + self.length).alias("end")).drop("run")

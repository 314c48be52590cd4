"""Packing items of varying length into containers of fixed capacity.

Cost-balanced: an item's cost is linear in its tokens plus quadratic for attention within it. Items go in descending
order to the sequence of lowest cost that still has room, starting from as many sequences as the tokens need at least.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items that one task packs together. A shard wastes part of a container, so larger shards waste less.
SHARD_ITEMS = 20_000


def cost(tokens: int, capacity: int) -> float:
    """Estimated cost: tokens, plus attention that equals the linear part for an item that fills a container."""
    return tokens + tokens * tokens / capacity


class _Open:
    """Open sequences by room left; finds the one of lowest cost with room for an item.

    A segment tree over the room left, 0 to capacity: each leaf has a heap of (cost, sequence), inner nodes the least.
    """

    NONE = (float("inf"), -1)

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.least = [self.NONE] * (2 * self.size)
        self.heaps: dict[int, list] = {}

    def _lift(self, room: int) -> None:
        heap = self.heaps.get(room)
        i = room + self.size
        self.least[i] = heap[0] if heap else self.NONE
        i //= 2
        while i:
            best = min(self.least[2 * i], self.least[2 * i + 1])
            if self.least[i] == best:
                break
            self.least[i] = best
            i //= 2

    def add(self, room: int, price: float, sequence: int) -> None:
        heapq.heappush(self.heaps.setdefault(room, []), (price, sequence))
        self._lift(room)

    def take(self, need: int) -> tuple[int, float, int] | None:
        """(room, cost, sequence) of the cheapest with room for ``need``, removed."""
        best, where = self.NONE, -1
        lo, hi = need + self.size, 2 * self.size
        while lo < hi:
            if lo & 1:
                if self.least[lo] < best:
                    best, where = self.least[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if self.least[hi] < best:
                    best, where = self.least[hi], hi
            lo //= 2
            hi //= 2
        if where < 0:
            return None
        while where < self.size:
            where = 2 * where if self.least[2 * where] == best else 2 * where + 1
        room = where - self.size
        heapq.heappop(self.heaps[room])
        self._lift(room)
        return room, best[0], best[1]


def assign(sizes: list[int], capacity: int) -> list[int]:
    """Container number of each item, the sizes in descending order and none above the capacity."""
    containers = -(-sum(sizes) // capacity)
    tree = _Open(capacity)
    for i in range(containers):
        tree.add(capacity, 0.0, i)
    out = []
    for n in sizes:
        found = tree.take(n)
        if found is None:
            found = (capacity, 0.0, containers)
            containers += 1
        room, price, where = found
        out.append(where)
        tree.add(room - n, price + cost(n, capacity), where)
    return out


def pieces(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, start, n): an item within the capacity is one piece; a longer one is cut at multiples of it."""
    starts = F.posexplode(F.sequence(F.lit(0), F.col(size) - 1, F.lit(capacity)))
    cutting = df.filter(F.col(size) > 0).select(key, size, starts.alias("piece", "start"))
    return cutting.select(key, "piece", "start", F.least(F.lit(capacity), F.col(size) - F.col("start")).alias("n"))


def pack(df: DataFrame, key: str, size: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(key, piece, start, n, container): every piece in a container; no container above ``capacity``.

    Items are spread over shards by a hash of their key and each shard is packed on its own: one shuffle of keys and
    sizes, no text. Null, zero and negative sizes need no room: one row with n 0 and a null container. Repeated keys
    are items of their own. Ties in size go by key and piece.
    """
    items = pieces(df, key, size, capacity)
    rows = df.agg(F.coalesce(F.sum(F.ceil(F.greatest(F.col(size), F.lit(0)) / capacity)), F.lit(0))).first()[0]
    shards = max(1, round(int(rows) / shard_items))
    kind = df.schema[key].dataType.simpleString()
    mixed = F.pmod(F.xxhash64(F.col(key), F.col("piece")), F.lit(shards))
    sharded = items.withColumn("shard", mixed.cast("int"))
    sharded = sharded.repartition(min(shards, 10_000), "shard").sortWithinPartitions("shard", F.desc("n"), key, "piece")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held: list = []
        shard = None

        def close() -> Iterator:
            if held:
                frame = pd.concat(held, ignore_index=True)
                numbers = assign(frame["n"].tolist(), capacity)
                yield frame.assign(container=[f"{shard}-{i}" for i in numbers]).drop(columns="shard")

        for batch in batches:
            for s, part in batch.groupby("shard", sort=False):
                if s != shard:
                    yield from close()
                    held, shard = [], s
                held.append(part)
        yield from close()

    schema = f"`{key}` {kind}, piece int, start int, n int, container string"
    packed = sharded.select(key, "piece", "start", "n", "shard").mapInPandas(run, schema)
    nothing = df.filter(F.coalesce(F.col(size), F.lit(0)) <= 0)
    zero = F.lit(0)
    rest = nothing.select(key, zero.alias("piece"), zero.alias("start"), zero.alias("n"), F.lit(None).cast("string").alias("container"))
    return packed.unionByName(rest)

"""Connected components by union-find over a distributed edge list.

Each task first joins what it can of its own edges (a union-find over one partition keeps a
spanning forest of it), then large-star and small-star rounds move every node to the least node
it can reach. Only edges travel; nothing of a size that grows goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moiety.llm.cluster import cut


class UnionFind:
    """Roots are the least member of each set."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.setdefault(r, r)) != r:
            r = p
        while up[x] != r:
            up[x], x = r, up[x]
        return r

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Nodes that a task's union-find holds before it hands over its forest and begins again.
HOLD = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(sets: UnionFind) -> pa.RecordBatch:
        rows = [(x, sets.root(x)) for x in list(sets.up)]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["u", "v"])

    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sets.union(a, b)
        if len(sets.up) > HOLD:
            yield out(sets)
            sets = UnionFind()
    yield out(sets)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (u, v long) to (node, component): the least node reachable, for nodes with an edge."""
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = cut(e.mapInArrow(_forest, "u long, v long").distinct())
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of a node goes to the node's least neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours go to the least of them
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum("v"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

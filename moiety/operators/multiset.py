"""Levelled multisets: counts, Tanimoto joins, size windows and prefix filters, on plain columns.

A multiset is rows (id, lvl, bit); a circular fingerprint or the tokens of a text are both one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(members: DataFrame) -> DataFrame:
    """(id, lvl, bit, n)."""
    return members.groupBy("id", "lvl", "bit").agg(F.count("*").alias("n"))


def size_window(size: int, threshold: float) -> tuple[int, int]:
    """Sizes that a set of this similarity can have."""
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    return math.floor(size * threshold), math.ceil(size / threshold)


def prefix(bits: dict, frequency: dict, threshold: float) -> list:
    """The rarest bits (by frequency, then bit) whose multiplicities pass ceil(size (1 - threshold)).

    Anything at least this similar holds one of them.
    """
    size, chosen, have = sum(bits.values()), [], 0
    need = math.ceil(size * (1 - threshold))
    for b in sorted(bits, key=lambda b: (frequency.get(b, 0), b)):
        chosen.append(b)
        have += bits[b]
        if have > need:
            break
    return chosen


def tanimoto(shared: Column, a: Column, b: Column) -> Column:
    """32-bit similarity, as thresholds are compared in 32 bits."""
    return (shared.cast("double") / (a + b - shared)).cast("float")


def similar_to(counts: DataFrame, query: DataFrame, threshold: float | None = None) -> DataFrame:
    """(id, score) of all multisets that share something with ``query`` (lvl, bit, n).

    The query is one multiset, so its side is as small as a document.
    """
    n = query.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = counts.groupBy("id").agg(F.sum("n").alias("size"))
    if threshold is not None:
        lo, hi = size_window(n, threshold)
        sizes = sizes.filter(F.col("size").between(lo, hi))
    q = query.select("lvl", "bit", F.col("n").alias("qn"))
    common = counts.join(q, ["lvl", "bit"]).groupBy("id").agg(F.sum(F.least("n", "qn")).alias("shared"))
    out = common.join(sizes, "id").select("id", tanimoto(F.col("shared"), F.col("size"), F.lit(n)).alias("score"))
    return out if threshold is None else out.filter(F.col("score") >= F.lit(threshold).cast("float"))


def _among(keys):
    return lambda x: x.isin(*keys)


def array_overlap(levels: Column, query: list[list[int]]) -> Column:
    """Members that an array of sorted levels shares with a literal multiset; JVM only."""
    total = F.lit(0)
    for d, level in enumerate(query):
        count: dict[int, int] = {}
        for b in level:
            count[b] = count.get(b, 0) + 1
        if not count:
            continue
        mine = F.filter(levels[d], _among(count))
        once = [b for b, c in count.items() if c == 1]
        if once:
            total = total + F.size(F.array_distinct(F.filter(mine, _among(once))))
        for b, c in count.items():
            if c > 1:
                total = total + F.least(F.size(F.filter(mine, _among([b]))), F.lit(c))
    return total


def log_count_bits(features: DataFrame, levels: int = 5) -> DataFrame:
    """(id, bit) counted, and for each the levels 0..floor(log2 n), ``levels`` at most."""
    n = features.groupBy("id", "bit").agg(F.count("*").alias("n"))
    top = F.least(F.lit(levels - 1), F.length(F.bin("n")) - 1)
    return n.select("id", "bit", F.explode(F.sequence(F.lit(0), top)).alias("level"))

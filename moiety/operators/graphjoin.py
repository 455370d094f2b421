"""Labelled-graph patterns as k-way joins of the bond relation, for small patterns over wide tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def directed(bonds: DataFrame) -> DataFrame:
    """(gid, i, j, t) both ways."""
    return bonds.select("gid", "i", "j", "t").unionByName(bonds.select("gid", F.col("j").alias("i"), F.col("i").alias("j"), "t"))


def path_pattern(atoms: DataFrame, bonds: DataFrame, elements: list[int | None], types: list[int | None]) -> DataFrame:
    """Graph ids that hold a path of these elements and bond types (None: any), atoms distinct.

    Every join is on (gid, atom), so one partitioning by gid serves all of them.
    """
    e, a = directed(bonds), atoms.select("gid", "idx", "z")

    def nodes(k: int) -> DataFrame:
        out = a if elements[k] is None else a.filter(F.col("z") == elements[k])
        return out.select("gid", F.col("idx").alias(f"n{k}"))

    out = nodes(0)
    for k, t in enumerate(types):
        step = e if t is None else e.filter(F.col("t") == t)
        step = step.select("gid", F.col("i").alias(f"n{k}"), F.col("j").alias(f"n{k + 1}"))
        out = out.join(step, ["gid", f"n{k}"])
        for p in range(k):
            out = out.filter(F.col(f"n{p}") != F.col(f"n{k + 1}"))
        if elements[k + 1] is not None:
            out = out.join(nodes(k + 1), ["gid", f"n{k + 1}"], "left_semi")
    return out.select("gid").distinct()

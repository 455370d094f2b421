"""Substructure, exact and similarity search over index rows, and pairwise similarity.

Each search is a filter that Catalyst sees (sizes, screening bits), one Arrow step that verifies
what is left (similarity needs none), and a score, order and limit in Catalyst again.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moiety.functions import structures
from moiety.functions.matching import LimitExceeded, Modes, Query, all_matches
from moiety.operators import multiset
from moiety.operators.prepare import each, holders_of_all, holders_of_any
from moiety.operators.rows import SIZES, to_graph

MOST_BITS, COVERAGE = 32, 2
#: Bits of a query that are looked up in the postings.
RARE = 3
#: Rows that are Python objects at a time; Arrow batches hold many more.
AT_ONCE = 500
#: Pairs whose similarity a task remembers.
REMEMBER = 1_000
_TINY = 1.401298464324817e-45  # the least positive 32-bit value


def choose_bits(bits: set[int], cover: dict[int, set[int]], frequency: dict[int, int], atoms: int) -> list[int]:
    """Rare bits first; one is taken if it covers an atom that fewer than two others do; 32 at most."""
    seen, out = [0] * atoms, []
    covered = set().union(*cover.values()) if cover else set()
    for b in sorted(bits, key=lambda b: (frequency.get(b, 0), b)):
        own = cover.get(b, set())
        if any(seen[i] < COVERAGE for i in own):
            out.append(b)
            for i in own:
                seen[i] += 1
            if len(out) == MOST_BITS or all(seen[i] >= COVERAGE for i in covered):
                break
    return out


def frequencies(docfreq: DataFrame | None, field: str, bits: set[int]) -> dict[int, int]:
    """Document frequencies of a query's own bits."""
    if docfreq is None or not bits:
        return {}
    return {r["bit"]: r["df"] for r in docfreq.filter((F.col("field") == field) & F.col("bit").isin(list(bits))).collect()}


def size_filter(q: Query) -> Column:
    """What a target's sizes must be; Catalyst pushes it to the scan."""
    heavy, hyd, xb, hb = q.sizes
    c = F.col
    if q.m.exact:
        return (c("n_heavy") == heavy) & (c("n_hyd") == hyd) & (c("n_xbond") == xb) & (c("n_hbond") == hb)
    if q.extended:
        return (c("n_heavy") + c("n_hyd") >= heavy + hyd) & (c("n_xbond") + c("n_hbond") >= xb + hb)
    return (c("n_heavy") >= heavy) & (c("n_hyd") >= hyd) & (c("n_xbond") >= xb)


def _bit(b) -> Column:
    return F.lit(b).cast("int") if isinstance(b, int) else F.lit(b)


def bits_filter(bits: list, column: str | Column = "sub_bits") -> Column:
    """All of them occur."""
    out = F.lit(True)
    for b in bits:
        out = out & F.array_contains(column, _bit(b))
    return out


def any_bit_filter(bits: list, column: str | Column) -> Column:
    """Some of them occur."""
    return F.arrays_overlap(column, F.array(*[_bit(b) for b in bits]))


def score_column(q: tuple[int, int, int, int]) -> Column:
    def part(n: int, c: str) -> Column:
        return F.when(F.col(c) == 0, F.lit(1.0)).otherwise(F.lit(float(n)) / F.col(c))

    s = (8 * part(q[0], "n_heavy") + 4 * part(q[2], "n_xbond") + 2 * part(q[1], "n_hyd") + part(q[3], "n_hbond")) / 15
    return F.greatest(s.cast("float"), F.lit(_TINY).cast("float"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _id_type(rows: DataFrame) -> str:
    return rows.schema["compound"].dataType.simpleString()


def verify(candidates: DataFrame, query: Query, limit: int = 0) -> DataFrame:
    """Rows that match, and those whose comparison ran out of its budget (``timed_out``)."""
    ddl = f"compound {_id_type(candidates)}, {SIZES}, timed_out boolean"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep, late = [], []
            for i, (a, b, s) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("atoms", "bonds", "sgroups")))):
                try:
                    if query.matches(to_graph(a, b, s), limit):
                        keep.append(i)
                        late.append(False)
                except LimitExceeded:
                    keep.append(i)
                    late.append(True)
            out = batch.select(["compound", "n_heavy", "n_hyd", "n_xbond", "n_hbond"]).take(pa.array(keep, pa.int64()))
            yield out.append_column("timed_out", pa.array(late, pa.bool_()))

    return candidates.select("compound", "n_heavy", "n_hyd", "n_xbond", "n_hbond", "atoms", "bonds", "sgroups").mapInArrow(step, ddl)


def count_matches(molecules: DataFrame, query: str, most: int = 256, screen: bool = True) -> DataFrame:
    """(compound, n): distinct atom sets that the query maps to, ``most`` at most (256 as the fingerprints count)."""
    (v, *_), ddl = structures.variants(query), f"compound {_id_type(molecules)}, n long"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = [len(all_matches(v.graph, to_graph(a, b, s), most)) for a, b, s in zip(*(batch.column(c).to_pylist() for c in ("atoms", "bonds", "sgroups")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["compound", "n"])

    found = molecules.filter(size_filter(v.query))
    if screen and v.bits:
        found = found.filter(bits_filter(choose_bits(v.bits, v.cover, {}, len(v.graph.atoms))))
    return found.select("compound", "atoms", "bonds", "sgroups").mapInArrow(step, ddl)


def ordered(hits: DataFrame, topn: int = -1, sort: bool = False) -> DataFrame:
    """topn > 0: the best n; 0: none; negative: all, ordered by score then compound if ``sort``."""
    if topn == 0:
        return hits.limit(0)
    if topn < 0:
        # bounds of the ranges are sampled first: from the hits, not by a second run of the matcher
        return hits.repartition("compound").orderBy(F.desc("score"), "compound") if sort else hits
    return hits.orderBy(F.desc("score"), "compound").limit(topn)


def substructure_hits(molecules: DataFrame, query: str, search: str = "SUBSTRUCTURE", charge: str = "DEFAULT_AS_ANY", isotope: str = "IGNORE", radical: str = "IGNORE", stereo: str = "IGNORE", aromaticity: str = "AUTO", tautomer: str = "IGNORE", limit: int = 0, docfreq: DataFrame | None = None, screen: bool = True, posting: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(compound, score, timed_out), the best score over the query's variants.

    With ``posting``, the rarest RARE bits are looked up there first; all others are compared with the stored arrays.
    With ``members`` (row, compound), ``molecules`` and ``posting`` are of distinct rows, and their members are returned.
    """
    modes = Modes(search, charge, isotope, radical, stereo)
    parts = []
    for v in structures.variants(query, modes, aromaticity, tautomer):
        found = molecules.filter(size_filter(v.query))
        if modes.exact and not v.graph.sgroups:
            found = found.filter(F.size("sgroups") == 0)
        if screen and v.bits:
            chosen = choose_bits(v.bits, v.cover, frequencies(docfreq, "sub", v.bits), len(v.graph.atoms))
            if posting is not None and chosen:
                found = found.join(holders_of_all(posting, "sub", chosen[:RARE]), "compound", "left_semi")
                chosen = chosen[RARE:]
            found = found.filter(bits_filter(chosen))
        parts.append(verify(found, v.query, limit).select("compound", score_column(v.query.sizes).alias("score"), "timed_out"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if len(parts) > 1:
        out = out.groupBy("compound").agg(F.max(F.when(~F.col("timed_out"), F.col("score"))).alias("s"), F.max("score").alias("m")).select("compound", F.coalesce("s", "m").alias("score"), F.col("s").isNull().alias("timed_out"))
    return each(out, members)


def substructure_search(molecules: DataFrame, query: str, topn: int = -1, sort: bool = False, **modes) -> DataFrame:
    """(compound, score). Null arguments give no rows. Comparisons out of budget are left out
    (``substructure_hits`` lists them)."""
    if query is None or None in modes.values() and any(v is None for k, v in modes.items() if k not in ("docfreq", "posting", "members")):
        return each(molecules.select("compound", F.lit(0.0).cast("float").alias("score")), modes.get("members")).limit(0)
    hits = substructure_hits(molecules, query, **modes)
    return ordered(hits.filter(~F.col("timed_out")).select("compound", "score"), topn, sort)


def substructure_top(molecules: DataFrame, query: str, topn: int, **modes) -> DataFrame:
    """The best ``topn`` as (compound, score, timed_out): hits first, then comparisons out of budget, with score 0."""
    hits = substructure_hits(molecules, query, **modes).withColumn("score", F.when(F.col("timed_out"), F.lit(0.0)).otherwise(F.col("score")).cast("float"))
    return ordered(hits, max(0, topn))


def similarity_search(molecules: DataFrame, query: str, threshold: float = 0.85, radius: int = 1, aromaticity: str = "AUTO", tautomer: str = "IGNORE", topn: int = -1, sort: bool = False, docfreq: DataFrame | None = None, screen: bool = True, posting: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(compound, score): multiset Tanimoto of circular descriptors of radius 0..radius.

    Candidates come from ``posting``, where it is given, else from the arrays of all rows; ``members`` as in ``substructure_hits``.
    """
    if threshold is not None and not threshold > 0:
        raise ValueError("threshold must be above 0")
    empty = each(molecules.select("compound", F.lit(0.0).cast("float").alias("score")), members).limit(0)
    if query is None or threshold is None or radius is None:
        return empty
    if not 0 <= radius <= 3:
        warnings.warn("only radius 0 to 3 is stored", stacklevel=2)
        return empty
    out = None
    for levels in structures.levels_of(query, radius, aromaticity, tautomer):
        n = sum(map(len, levels))
        if not n:
            continue
        lo, hi = multiset.size_window(n, threshold)
        size = F.col(f"sim_cum_{radius}")
        found = molecules.filter(size.between(lo, hi))
        if screen:
            count: dict[int, int] = {}
            for x in levels:
                for b in x:
                    count[b] = count.get(b, 0) + 1
            chosen = multiset.prefix(count, frequencies(docfreq, "sim", set(count)), threshold)
            found = found.filter(any_bit_filter(chosen, F.flatten("sim_levels"))) if posting is None else found.join(holders_of_any(posting, "sim", chosen), "compound", "left_semi")
        common = multiset.array_overlap(F.col("sim_levels"), levels)
        s = multiset.tanimoto(common, size, F.lit(n))
        part = found.select("compound", s.alias("score")).filter(F.col("score") >= F.lit(threshold).cast("float"))
        out = part if out is None else out.unionByName(part).groupBy("compound").agg(F.max("score").alias("score"))
    return empty if out is None else ordered(each(out, members), topn, sort)


def pair_similarity_udf():
    """similarity(a, b, radius, aromaticity) as a pandas UDF; null in, null out; unreadable, null. A task remembers REMEMBER pairs."""
    known: dict = {}

    @F.pandas_udf("float")
    def similarity(a: pd.Series, b: pd.Series, radius: pd.Series, aromaticity: pd.Series) -> pd.Series:
        def one(x, y, r, m):
            if x is None or y is None or r is None or m is None or (isinstance(r, float) and math.isnan(r)):
                return None
            key = (x, y, int(r), m)
            if key not in known:
                if len(known) >= REMEMBER:
                    known.clear()
                try:
                    known[key] = structures.pair_similarity(*key)
                except ValueError:
                    known[key] = None
            return known[key]

        return pd.Series([one(*v) for v in zip(a, b, radius, aromaticity)], dtype="float32")

    return similarity


def similarity(a: Column, b: Column, radius: int = 1, aromaticity: str = "AUTO") -> Column:
    structures.checked_mode("aromaticity", aromaticity)
    return pair_similarity_udf()(a, b, F.lit(radius), F.lit(aromaticity))


def batched_substructure(molecules: DataFrame, queries: dict[int, str], k: int | None = None, **modes) -> DataFrame:
    """(query_id, compound, score) of several queries; the k best of each if given."""
    from pyspark.sql import Window

    out = None
    for i, q in queries.items():
        part = substructure_search(molecules, q, **modes).select(F.lit(i).alias("query_id"), "compound", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no queries")
    if k is not None:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "compound")
        out = out.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= k).drop("n")
    return out

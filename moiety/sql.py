"""The search functions in SQL, over a view of index rows."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.functions import fingerprints, structures
from moiety.functions.matching import LimitExceeded, Modes, score, sizes
from moiety.operators import search
from moiety.operators.rows import to_graph
from moiety.sources.index import IndexStore

_MODES = ("search", "charge", "isotope", "radical", "stereo", "aromaticity", "tautomer")
_DEFAULTS = {"search": "SUBSTRUCTURE", "charge": "DEFAULT_AS_ANY", "isotope": "IGNORE", "radical": "IGNORE", "stereo": "IGNORE", "aromaticity": "AUTO", "tautomer": "IGNORE"}
_SCREEN = "array<struct<exact:boolean,extended:boolean,groups:boolean,heavy:int,hyd:int,xbond:int,hbond:int,bits:array<int>>>"


def _variants(key: tuple):
    q, *modes = key
    m = dict(zip(_MODES, modes))
    return structures.variants(q, Modes(m["search"], m["charge"], m["isotope"], m["radical"], m["stereo"]), m["aromaticity"], m["tautomer"])


def _known(cache: dict, key: tuple):
    """The query's variants, compiled once per task and distinct query; None where an argument is null."""
    if any(x is None for x in key):
        return None
    if key not in cache:
        if len(cache) >= 1000:
            cache.clear()
        cache[key] = _variants(key)
    return cache[key]


def register(spark: SparkSession, molecules: DataFrame, name: str = "molecules", rows: DataFrame | None = None, members: DataFrame | None = None) -> None:
    """similarity, index_size, substructure_search and similarity_search over ``molecules``.

    With ``rows`` and ``members`` (row, compound), distinct rows are searched, and their members returned.

    The table functions take columns too, so they can be called per row with LATERAL. Each query's
    sizes and screening bits are derived once and joined with the index in the JVM; only what is
    left meets the matcher.
    """
    molecules.createOrReplaceTempView(name)
    searched, all_ = name, name
    if members is not None:
        searched, all_ = f"{name}_rows", f"{name}_members"
        rows.createOrReplaceTempView(searched)
        members.createOrReplaceTempView(all_)
    spark.udf.register("similarity", search.pair_similarity_udf())
    screens: dict = {}
    matched: dict = {}

    @F.pandas_udf(_SCREEN)
    def query_screen(query: pd.Series, search_: pd.Series, charge: pd.Series, isotope: pd.Series, radical: pd.Series, stereo: pd.Series, aromaticity: pd.Series, tautomer: pd.Series) -> pd.Series:
        out = []
        for key in zip(query, search_, charge, isotope, radical, stereo, aromaticity, tautomer):
            known = _known(screens, key)
            rows = []
            for v in known or ():
                heavy, hyd, xb, hb = v.query.sizes
                chosen = search.choose_bits(v.bits, v.cover, {}, len(v.graph.atoms))
                rows.append({"exact": v.query.m.exact, "extended": bool(v.query.extended), "groups": bool(v.graph.sgroups), "heavy": heavy, "hyd": hyd, "xbond": xb, "hbond": hb, "bits": chosen})
            out.append(rows)
        return pd.Series(out)

    @F.arrow_udf("float")
    def structure_match(query: pa.Array, search_: pa.Array, charge: pa.Array, isotope: pa.Array, radical: pa.Array, stereo: pa.Array, aromaticity: pa.Array, tautomer: pa.Array, limit: pa.Array, atoms: pa.Array, bonds: pa.Array, sgroups: pa.Array) -> pa.Array:
        out, columns = [], (query, search_, charge, isotope, radical, stereo, aromaticity, tautomer, limit, atoms, bonds, sgroups)
        for *key, most, a, b, s in (x for at in range(0, len(atoms), search.AT_ONCE) for x in zip(*(c.slice(at, search.AT_ONCE).to_pylist() for c in columns))):
            known, got = _known(matched, tuple(key)), []
            if known and a is not None and most is not None:
                g = to_graph(a, b, s)
                for v in known:
                    if v.query.m.exact and not v.graph.sgroups and g.sgroups:
                        continue
                    try:
                        if v.query.matches(g, int(most)):
                            got.append(max(score(v.query.sizes, sizes(g)), 1.401298464324817e-45))
                    except LimitExceeded:
                        pass
            out.append(max(got) if got else None)
        return pa.array(out, pa.float32())

    @F.pandas_udf("float")
    def level_score(query: pd.Series, radius: pd.Series, aromaticity: pd.Series, tautomer: pd.Series, levels: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for q, r, ar, ta, x in zip(query, radius, aromaticity, tautomer, levels):
            if q is None or ar is None or ta is None or pd.isna(r) or not 0 <= r <= 3 or x is None:
                out.append(None)
                continue
            if (q, r, ar, ta) not in known:
                known[q, r, ar, ta] = structures.levels_of(q, int(r), ar, ta)
            own = [list(v) for v in x][: int(r) + 1]
            best = [0.0]
            for y in known[q, r, ar, ta]:
                common = fingerprints.shared(own, y)
                total = sum(map(len, own)) + sum(map(len, y)) - common
                best.append(common / total if total else 0.0)
            out.append(max(best))
        return pd.Series(out, dtype="float32")

    for f, n in ((query_screen, "query_screen"), (structure_match, "structure_match"), (level_score, "level_similarity")):
        spark.udf.register(n, f)

    def modes(function: str) -> str:
        return ", ".join(f"{function}.{m}" for m in _MODES)

    def chosen(function: str, rows: str) -> str:
        """The rows that topn leaves, in order of score where it or ``sort`` asks for that; all rows of a query are numbered together only for topn."""
        return f"""SELECT compound, score FROM (
          SELECT compound, score, row_number() OVER (PARTITION BY spread ORDER BY score DESC, compound) AS place
          FROM (SELECT compound, score, CASE WHEN {function}.topn < 0 THEN compound END AS spread FROM ({rows})))
          WHERE {function}.topn < 0 OR place <= {function}.topn
          ORDER BY CASE WHEN {function}.sort OR {function}.topn > 0 THEN -score END, CASE WHEN {function}.sort OR {function}.topn > 0 THEN compound END"""

    def each(found: str) -> str:
        """Their members, where distinct rows were searched."""
        return found if members is None else f"SELECT o.compound, f.score FROM ({found}) f JOIN {all_} o ON o.row = f.compound"

    s = "substructure_search"
    hits = f"""SELECT compound, score FROM (
        SELECT m.compound, structure_match({s}.query, {modes(s)}, {s}.limit, m.atoms, m.bonds, m.sgroups) AS score
        FROM (SELECT query_screen({s}.query, {modes(s)}) AS screen) q JOIN {searched} m
        ON exists(q.screen, v -> CASE
          WHEN v.exact THEN m.n_heavy = v.heavy AND m.n_hyd = v.hyd AND m.n_xbond = v.xbond AND m.n_hbond = v.hbond
          WHEN v.extended THEN m.n_heavy + m.n_hyd >= v.heavy + v.hyd AND m.n_xbond + m.n_hbond >= v.xbond + v.hbond
          ELSE m.n_heavy >= v.heavy AND m.n_hyd >= v.hyd AND m.n_xbond >= v.xbond END
          AND forall(v.bits, b -> array_contains(m.sub_bits, b)))) WHERE score IS NOT NULL"""
    arguments = ", ".join(f"{m} STRING DEFAULT '{_DEFAULTS[m]}'" for m in _MODES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {s}(query STRING, {arguments}, topn INT DEFAULT -1, sort BOOLEAN DEFAULT FALSE, limit BIGINT DEFAULT 0) RETURNS TABLE(compound BIGINT, score FLOAT) RETURN {chosen(s, each(hits))}")
    s = "similarity_search"
    near = f"""SELECT compound, score FROM (
        SELECT m.compound, level_similarity({s}.query, {s}.radius, {s}.aromaticity, {s}.tautomer, m.sim_levels) AS score FROM {searched} m) WHERE score >= CAST({s}.threshold AS FLOAT)"""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {s}(query STRING, threshold FLOAT DEFAULT 0.85, radius INT DEFAULT 1, aromaticity STRING DEFAULT 'AUTO', tautomer STRING DEFAULT 'IGNORE', topn INT DEFAULT -1, sort BOOLEAN DEFAULT FALSE) RETURNS TABLE(compound BIGINT, score FLOAT) RETURN {chosen(s, each(near))}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION index_size() RETURNS BIGINT RETURN SELECT count(*) FROM {all_}")


def register_index(store: IndexStore, index: str) -> None:
    """The same functions over an index's current version, and its segments as ``<index>_segments``."""
    v = store.view(index)
    register(store.spark, v.each(v.rows.drop("text_key")), index, v.rows, v.members)
    store.segments(index).createOrReplaceTempView(f"{index}_segments")

"""One query per operator; keys begin with the inventory's identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.functions.graph import ANY, Atom, Bond, Graph
from moiety.functions.hashing import fold_columns
from moiety.functions.matching import Modes, Query
from moiety.operators import graphjoin, multiset, search
from moiety.operators import prepare as prepare_
from moiety.operators.prepare import distinct, document_frequency, each, parse, postings, prepare, split
from moiety.plans import fixtures as X
from moiety.sources.index import collapse, event_changes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


# ---- graphs

#: any atom, single bond, carbon, any bond, oxygen
MOTIF = Graph([Atom(-1), Atom(6), Atom(8)], [Bond(0, 1, 1), Bond(1, 2, ANY)])
_EXISTS = """EXISTS (SELECT 1 FROM e e1 JOIN e e2 ON e1.gid = e2.gid AND e1.j = e2.i AND e2.j <> e1.i
  JOIN a c ON c.gid = e1.gid AND c.idx = e1.j AND c.z = 6 JOIN a o ON o.gid = e2.gid AND o.idx = e2.j AND o.z = 8
  WHERE e1.gid = s.gid AND e1.t = 1)"""
_SCORED = f"SELECT CAST(s.gid AS BIGINT) AS compound, CAST((8 * (CAST(3 AS DOUBLE) / s.n_atoms) + 4 * (CAST(2 AS DOUBLE) / k.n_bonds)) / 12 AS FLOAT) AS score FROM sz s JOIN sb k ON s.gid = k.gid WHERE {_EXISTS}"


def _motif_hits(spark: SparkSession, d: str) -> DataFrame:
    q = Query(MOTIF, Modes())
    # the graphs hold no hydrogens, so sizes are compared as they are; carbon and oxygen must occur
    has = [F.exists("atoms", _is(z)) for z in (6, 8)]
    found = X.graphs(spark, d).filter(search.size_filter(q)).filter(has[0] & has[1])
    s = (8 * (F.lit(3.0) / F.col("n_heavy")) + 4 * (F.lit(2.0) / F.col("n_xbond"))) / 12
    return search.verify(found, q).select("compound", s.cast("float").alias("score"))


def _is(z: int):
    return lambda a: a["z"] == z


@query("j4_subgraph_match", X.G + _SCORED)
def subgraph_match(spark: SparkSession, d: str) -> DataFrame:
    return _motif_hits(spark, d)


@query("j4_subgraph_join", X.G + f"SELECT CAST(s.gid AS BIGINT) AS compound FROM sz s WHERE {_EXISTS}")
def subgraph_join(spark: SparkSession, d: str) -> DataFrame:
    atoms, bonds = X.graph_tables(spark, d)
    return graphjoin.path_pattern(atoms, bonds, [None, 6, 8], [1, None]).select(F.col("gid").alias("compound"))


@query("t4_top_k", X.G + f"SELECT * FROM ({_SCORED}) ORDER BY score DESC, compound LIMIT 20")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    return search.ordered(_motif_hits(spark, d), topn=20)


@query("t3_sorted", X.G + f"SELECT * FROM ({_SCORED}) ORDER BY score DESC, compound")
def sorted_hits(spark: SparkSession, d: str) -> DataFrame:
    return search.ordered(_motif_hits(spark, d), sort=True)


@query("t1_none", X.G + f"SELECT * FROM ({_SCORED}) WHERE 1 = 0")
def no_hits(spark: SparkSession, d: str) -> DataFrame:
    return search.ordered(_motif_hits(spark, d), topn=0)


@query("q_sub_exact", X.G + """SELECT CAST(x.gid AS BIGINT) AS compound FROM sz x JOIN sb k ON k.gid = x.gid
  WHERE x.n_atoms = 3 AND k.n_bonds = 2 AND EXISTS (SELECT 1 FROM e e1 JOIN e e2 ON e1.gid = e2.gid AND e1.j = e2.i AND e2.j <> e1.i
  JOIN a p ON p.gid = e1.gid AND p.idx = e1.i AND p.z = 6 JOIN a c ON c.gid = e1.gid AND c.idx = e1.j AND c.z = 6 JOIN a o ON o.gid = e2.gid AND o.idx = e2.j AND o.z = 9
  WHERE e1.gid = x.gid AND e1.t = 1 AND e2.t = 2)""")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    q = Query(Graph([Atom(6), Atom(6), Atom(9)], [Bond(0, 1, 1), Bond(1, 2, 2)]), Modes(search="EXACT"))
    found = X.graphs(spark, d).filter(search.size_filter(q))
    return search.verify(found, q).select("compound")


@query("p6_size_filter", X.G + "SELECT CAST(s.gid AS BIGINT) AS compound, CAST(s.n_atoms AS INT) AS n_atoms, CAST(k.n_bonds AS INT) AS n_bonds FROM sz s JOIN sb k ON s.gid = k.gid WHERE s.n_atoms >= 3 AND k.n_bonds >= 2")
def size_filter(spark: SparkSession, d: str) -> DataFrame:
    return X.graphs(spark, d).filter(search.size_filter(Query(MOTIF, Modes()))).select("compound", F.col("n_heavy").alias("n_atoms"), F.col("n_xbond").alias("n_bonds"))


@query("fp5_atom_counts", X.G + "SELECT CAST(gid AS BIGINT) AS compound, z, COUNT(*) AS n FROM a GROUP BY gid, z")
def atom_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.graph_tables(spark, d)[0].groupBy(F.col("gid").alias("compound"), "z").agg(F.count("*").alias("n"))


@query("a4_log_count_bits", X.G + "SELECT CAST(gid AS BIGINT) AS compound, z, CAST(l.level AS INT) AS level FROM (SELECT gid, z, COUNT(*) AS n FROM a GROUP BY gid, z) f, LATERAL (SELECT UNNEST(generate_series(0, least(4, len(ltrim(bin(f.n), '0')) - 1))) AS level) l")
def log_count_bits(spark: SparkSession, d: str) -> DataFrame:
    atoms = X.graph_tables(spark, d)[0].select(F.col("gid").alias("id"), F.col("z").alias("bit"))
    return multiset.log_count_bits(atoms).select(F.col("id").alias("compound"), F.col("bit").alias("z"), "level")


def _fold_sql(*values: str) -> str:
    """The 32-bit fold in DuckDB, on HUGEINTs; nested, so each step is a column of a subquery."""
    out, s = "", "CAST(0 AS HUGEINT)"
    for v in values:
        x = f"(CAST({v} AS HUGEINT) & 4294967295)"
        s = f"xor({s}, ((({x} * 2654435761) + 2654435769 + ({s} * 64) + ({s} // 4)) & 4294967295))"
    out = s
    return f"CAST(CASE WHEN {out} >= 2147483648 THEN {out} - 4294967296 ELSE {out} END AS BIGINT)"


@query("f3_f4_hash", f"SELECT DISTINCT l_partkey AS x, l_suppkey AS y, {_fold_sql('l_partkey', 'l_suppkey')} AS h FROM lineitem")
def hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).distinct().withColumn("h", fold_columns(F.col("x"), F.col("y")))


@query("fp1_circular_level1", X.G + f""", nb AS (SELECT e.gid, e.i, {_fold_sql('e.t', 'y.z')} AS h FROM e JOIN a y ON y.gid = e.gid AND y.idx = e.j),
  l AS (SELECT gid, i, list_sort(list(h & 4294967295)) AS hs, count(*) AS n FROM nb GROUP BY gid, i),
  s0 AS (SELECT a.gid, a.idx, l.hs, {_fold_sql('a.z', 'l.n')} & 4294967295 AS seed FROM a JOIN l ON l.gid = a.gid AND l.i = a.idx),
  s1 AS (SELECT gid, idx, list_reduce(list_prepend(CAST(seed AS HUGEINT), list_transform(hs, lambda h: CAST(h AS HUGEINT))), lambda s, x: xor(s, ((x * 2654435761) + 2654435769 + (s * 64) + (s // 4)) & 4294967295)) AS v FROM s0)
  SELECT CAST(gid AS BIGINT) AS compound, idx, CAST(CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS BIGINT) AS h FROM s1""")
def circular_level1(spark: SparkSession, d: str) -> DataFrame:
    """Radius-1 descriptors of every atom, in the JVM: hash(z, number of bonds, sorted neighbour hashes)."""
    from moiety.functions.hashing import mix_column

    atoms, bonds = X.graph_tables(spark, d)
    e = graphjoin.directed(bonds).join(atoms.select("gid", F.col("idx").alias("j"), "z"), ["gid", "j"])
    h = fold_columns(F.col("t"), F.col("z")).bitwiseAND(F.lit(0xFFFFFFFF))
    own = e.select("gid", F.col("i").alias("idx"), h.alias("h")).groupBy("gid", "idx").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    seed = fold_columns(F.col("z"), F.size("hs")).bitwiseAND(F.lit(0xFFFFFFFF))
    v = F.aggregate("hs", seed, lambda s, x: mix_column(x, s))
    return own.join(atoms, ["gid", "idx"]).select(F.col("gid").alias("compound"), "idx", F.when(v >= F.lit(1 << 31), v - F.lit(1 << 32)).otherwise(v).alias("h"))


# ---- multisets

_SIM = X.T + """, sh AS (SELECT y.doc_id, SUM(LEAST(x.n, y.n)) AS shared FROM c x JOIN c y ON x.lvl = y.lvl AND x.bit = y.bit WHERE x.doc_id = 0 GROUP BY y.doc_id),
r AS (SELECT CAST(sh.doc_id AS BIGINT) AS compound, CAST(CAST(sh.shared AS DOUBLE) / (q.sz + t.sz - sh.shared) AS FLOAT) AS score
  FROM sh JOIN sz t ON t.doc_id = sh.doc_id JOIN sz q ON q.doc_id = 0)
"""


def _similar(spark: SparkSession, d: str, threshold: float | None) -> DataFrame:
    t = X.tokens(spark, d)
    mine = multiset.counted(t.filter("id = 0")).select("lvl", "bit", "n")
    return multiset.similar_to(multiset.counted(t), mine, threshold).select(F.col("id").alias("compound"), "score")


@query("q_sim_threshold", _SIM + "SELECT compound, score FROM r WHERE score >= CAST(0.05 AS FLOAT)")
def similar_threshold(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, 0.05)


@query("q_sim_top_k", _SIM + "SELECT compound, score FROM r ORDER BY score DESC, compound LIMIT 10")
def similar_top_k(spark: SparkSession, d: str) -> DataFrame:
    return search.ordered(_similar(spark, d, None), topn=10)


@query("j3_multiset_overlap", _SIM + "SELECT CAST(doc_id AS BIGINT) AS compound, CAST(shared AS BIGINT) AS shared FROM sh")
def overlap(spark: SparkSession, d: str) -> DataFrame:
    c = multiset.counted(X.tokens(spark, d))
    q = c.filter("id = 0").select("lvl", "bit", F.col("n").alias("qn"))
    return c.join(q, ["lvl", "bit"]).groupBy(F.col("id").alias("compound")).agg(F.sum(F.least("n", "qn")).alias("shared"))


@query("u3_multiset_difference", _SIM + "SELECT CAST(t.doc_id AS BIGINT) AS compound, CAST(q.sz - coalesce(sh.shared, 0) AS BIGINT) AS remaining FROM sz t JOIN sz q ON q.doc_id = 0 LEFT JOIN sh ON sh.doc_id = t.doc_id")
def difference(spark: SparkSession, d: str) -> DataFrame:
    c = multiset.counted(X.tokens(spark, d))
    q = c.filter("id = 0").select("lvl", "bit", F.col("n").alias("qn"))
    total = q.agg(F.sum("qn")).first()[0] or 0
    return c.join(q, ["lvl", "bit"], "left").groupBy(F.col("id").alias("compound")).agg((F.lit(total) - F.sum(F.least("n", F.coalesce("qn", F.lit(0))))).cast("long").alias("remaining"))


@query("a2_document_frequency", X.T + "SELECT bit, COUNT(*) AS df FROM c GROUP BY bit")
def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return document_frequency(X.word_postings(spark, d).filter("field = 'sub'")).select("bit", "df")


@query("a5_feature_histogram", X.T + "SELECT CAST(doc_id AS BIGINT) AS compound, bit, n FROM c")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return multiset.counted(X.tokens(spark, d)).select(F.col("id").alias("compound"), "bit", "n")


@query("a6_cumulative_sizes", X.T.replace("0 AS lvl", "strlen(u.bit) % 4 AS lvl") + ", l AS (SELECT doc_id, lvl, SUM(n) AS n FROM c GROUP BY doc_id, lvl) SELECT CAST(doc_id AS BIGINT) AS compound, CAST(lvl AS INT) AS lvl, CAST(SUM(n) OVER (PARTITION BY doc_id ORDER BY lvl) AS BIGINT) AS size FROM l")
def cumulative_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Running sizes over levels; here a token's level is its length in bytes modulo 4."""
    t = X.tokens(spark, d).withColumn("lvl", (F.octet_length("bit") % 4).cast("int"))
    return prepare_.cumulative_sizes(t.groupBy("id", "lvl").agg(F.count("*").alias("n"))).withColumnRenamed("id", "compound")


@query("s9_size_range", X.T + "SELECT CAST(doc_id AS BIGINT) AS compound, CAST(sz AS BIGINT) AS size FROM sz WHERE sz BETWEEN (SELECT floor(sz * 0.85) FROM sz WHERE doc_id = 0) AND (SELECT ceil(sz / 0.85) FROM sz WHERE doc_id = 0)")
def size_range(spark: SparkSession, d: str) -> DataFrame:
    s = X.tokens(spark, d).groupBy("id").agg(F.count("*").alias("size"))
    n = s.filter("id = 0").first()
    lo, hi = multiset.size_window(n["size"] if n else 0, 0.85)
    return s.filter(F.col("size").between(lo, hi)).select(F.col("id").alias("compound"), "size")


_WORDS = ("the", "of", "and")


@query("p11_all_bits", X.T + f"SELECT CAST(doc_id AS BIGINT) AS compound FROM c WHERE bit IN {_WORDS} GROUP BY doc_id HAVING COUNT(*) = 3")
def all_bits(spark: SparkSession, d: str) -> DataFrame:
    """Conjunction as a filter on stored arrays: no shuffle."""
    return X.word_rows(spark, d).filter(search.bits_filter(list(_WORDS))).select("compound")


@query("j2_posting_conjunction", X.T + f"SELECT CAST(doc_id AS BIGINT) AS compound FROM c WHERE bit IN {_WORDS} GROUP BY doc_id HAVING COUNT(*) = 3")
def posting_conjunction(spark: SparkSession, d: str) -> DataFrame:
    """Conjunction over posting rows."""
    return prepare_.holders_of_all(X.word_postings(spark, d), "sub", list(_WORDS))


@query("s7_posting_scan", X.T + "SELECT CAST(doc_id AS BIGINT) AS compound, bit FROM c WHERE bit = 'the'")
def posting_scan(spark: SparkSession, d: str) -> DataFrame:
    return prepare_.posting_scan(X.word_postings(spark, d), "sub", ["the"]).select("compound", "bit")


@query("s14_bit_stream", X.T + "SELECT CAST(doc_id AS BIGINT) AS compound, bit FROM c")
def bit_stream(spark: SparkSession, d: str) -> DataFrame:
    return X.word_postings(spark, d).filter("field = 'sub'").select("compound", "bit")


@query("p12_any_bit_in_window", X.T + f"SELECT CAST(s.doc_id AS BIGINT) AS compound FROM sz s WHERE s.sz BETWEEN 50 AND 500 AND EXISTS (SELECT 1 FROM c WHERE c.doc_id = s.doc_id AND c.bit IN {_WORDS})")
def any_bit(spark: SparkSession, d: str) -> DataFrame:
    return X.word_rows(spark, d).filter(F.size("sub_bits").between(50, 500) & search.any_bit_filter(list(_WORDS), F.col("sub_bits"))).select("compound")


@query("u2_level_union", X.T + "SELECT CAST(doc_id AS BIGINT) AS compound, COUNT(DISTINCT bit) AS n_bits FROM c GROUP BY doc_id")
def level_union(spark: SparkSession, d: str) -> DataFrame:
    return X.word_rows(spark, d).select("compound", F.size(prepare_.level_union("sim_levels")).cast("long").alias("n_bits"))


@query("a1_best_variant", X.T + """, q AS (SELECT doc_id AS v, lvl, bit, n FROM c WHERE doc_id IN (0, 1, 2)),
  sh AS (SELECT q.v, y.doc_id, SUM(LEAST(q.n, y.n)) AS shared FROM q JOIN c y ON q.lvl = y.lvl AND q.bit = y.bit GROUP BY q.v, y.doc_id)
  SELECT CAST(sh.doc_id AS BIGINT) AS compound, MAX(CAST(CAST(sh.shared AS DOUBLE) / (a.sz + b.sz - sh.shared) AS FLOAT)) AS score FROM sh JOIN sz a ON a.doc_id = sh.v JOIN sz b ON b.doc_id = sh.doc_id GROUP BY sh.doc_id""")
def best_variant(spark: SparkSession, d: str) -> DataFrame:
    """Three query variants at once; a compound keeps the best score over them."""
    c = multiset.counted(X.tokens(spark, d))
    size = c.groupBy("id").agg(F.sum("n").alias("size"))
    q = c.filter("id IN (0, 1, 2)").select(F.col("id").alias("v"), "lvl", "bit", F.col("n").alias("qn"))
    shared = c.join(q, ["lvl", "bit"]).groupBy("v", "id").agg(F.sum(F.least("n", "qn")).alias("shared"))
    out = shared.join(size, "id").join(size.filter("id IN (0, 1, 2)").select(F.col("id").alias("v"), F.col("size").alias("qsize")), "v")
    return out.groupBy(F.col("id").alias("compound")).agg(F.max(multiset.tanimoto(F.col("shared"), F.col("size"), F.col("qsize"))).alias("score"))


# ---- change log

_E = """WITH ev AS (SELECT event_id, user_id AS compound, CASE WHEN event_type = 'signup' THEN 'INSERT' WHEN event_type IN ('purchase', 'click') THEN 'UPDATE' WHEN event_type = 'error' THEN 'DELETE' END AS kind FROM events),
c AS (SELECT * FROM ev WHERE kind IS NOT NULL), p AS (SELECT compound, bool_or(kind <> 'INSERT') AS "delete" FROM c GROUP BY compound),
t AS (SELECT compound, arg_max(kind, event_id) AS last FROM c GROUP BY compound)
"""


@query("x3_change_capture", _E + 'SELECT compound, "delete" FROM p')
def change_capture(spark: SparkSession, d: str) -> DataFrame:
    return collapse(event_changes(X.changes(spark, d)))


@query("j1_pending_rows", _E + "SELECT p.compound, p.\"delete\" FROM p JOIN t ON t.compound = p.compound WHERE t.last <> 'DELETE'")
def pending_rows(spark: SparkSession, d: str) -> DataFrame:
    log = X.changes(spark, d)
    live = log.groupBy("compound").agg(F.max_by("kind", "event_id").alias("last")).filter("last <> 'DELETE'").select("compound")
    return collapse(event_changes(log)).join(live, "compound")


@query("x4_sync", _E + ", old AS (SELECT c_custkey AS compound FROM customer) SELECT compound, 'old' AS origin FROM old WHERE compound NOT IN (SELECT compound FROM p) UNION ALL SELECT p.compound, 'new' AS origin FROM p JOIN t ON t.compound = p.compound WHERE t.last <> 'DELETE'")
def sync(spark: SparkSession, d: str) -> DataFrame:
    """The next version's rows: the old ones without those pending, and the pending that still exist."""
    log = X.changes(spark, d)
    pending = collapse(event_changes(log))
    live = log.groupBy("compound").agg(F.max_by("kind", "event_id").alias("last")).filter("last <> 'DELETE'").select("compound")
    old = X.table(spark, d, "customer").select(F.col("c_custkey").alias("compound"))
    kept = old.join(pending, "compound", "left_anti").withColumn("origin", F.lit("old"))
    return kept.unionByName(pending.join(live, "compound").select("compound", F.lit("new").alias("origin")))


@query("x6_delete_by_id", _E + 'SELECT c_custkey AS compound FROM customer WHERE c_custkey NOT IN (SELECT compound FROM p WHERE "delete")')
def delete_by_id(spark: SparkSession, d: str) -> DataFrame:
    gone = collapse(event_changes(X.changes(spark, d))).filter("delete")
    return X.table(spark, d, "customer").select(F.col("c_custkey").alias("compound")).join(gone, "compound", "left_anti")


# ---- molecules: what SQL can say of them is derived by hand

_N = len(X.MOLECULES)


def _at(*names: str) -> str:
    return "(" + ", ".join(str(X.MOLECULES.index(n)) for n in names) + ")"


def _index(spark: SparkSession, d: str) -> DataFrame:
    return split(prepare(X.molecules(spark, d)))[0]


def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Index rows of the distinct structures, and the members of each: what a search needs."""
    texts, members = distinct(X.molecules(spark, d))
    return split(parse(texts))[0], members


def _substructure(spark: SparkSession, d: str, text: str, **args) -> DataFrame:
    rows, members = _rows(spark, d)
    return search.substructure_search(rows, text, members=members, **args)


def _near_ethanol(spark: SparkSession, d: str, **args) -> DataFrame:
    rows, members = _rows(spark, d)
    return search.similarity_search(rows, "CCO", threshold=0.3, members=members, **args)


@query("s12_errors", f"SELECT p_partkey AS compound FROM part WHERE p_partkey % {_N} IN {_at('not a molecule(').replace(',)', ')')}")
def errors(spark: SparkSession, d: str) -> DataFrame:
    return split(prepare(X.molecules(spark, d)))[1].select("compound")


@query("a3_index_size", f"SELECT COUNT(*) AS n FROM part WHERE p_partkey % {_N} <> {X.MOLECULES.index('not a molecule(')}")
def index_size(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).agg(F.count("*").alias("n"))


@query("q_sub_benzene", f"SELECT p_partkey AS compound FROM part WHERE p_partkey % {_N} IN {_at('c1ccccc1', 'C1=CC=CC=C1', 'c1ccc2ccccc2c1', 'Oc1ccccc1')}")
def benzene(spark: SparkSession, d: str) -> DataFrame:
    return _substructure(spark, d, "c1ccccc1").select("compound")


@query("q_sub_alcohol", f"""SELECT p_partkey AS compound, CAST(CASE p_partkey % {_N} WHEN {X.MOLECULES.index('CCO')} THEN (8 * (CAST(2 AS DOUBLE) / 3) + 4 * (CAST(1 AS DOUBLE) / 2)) / 15
   WHEN {X.MOLECULES.index('OCCO')} THEN (8 * (CAST(2 AS DOUBLE) / 4) + 4 * (CAST(1 AS DOUBLE) / 3)) / 15
   WHEN {X.MOLECULES.index('CC(=O)O')} THEN (8 * (CAST(2 AS DOUBLE) / 4) + 4 * (CAST(1 AS DOUBLE) / 3)) / 15
   WHEN {X.MOLECULES.index('N[C@@H](C)C(=O)O')} THEN (8 * (CAST(2 AS DOUBLE) / 6) + 4 * (CAST(1 AS DOUBLE) / 5)) / 15
   WHEN {X.MOLECULES.index('N[C@H](C)C(=O)O')} THEN (8 * (CAST(2 AS DOUBLE) / 6) + 4 * (CAST(1 AS DOUBLE) / 5)) / 15
   WHEN {X.MOLECULES.index('CC(O)=C')} THEN (8 * (CAST(2 AS DOUBLE) / 4) + 4 * (CAST(1 AS DOUBLE) / 3)) / 15
   WHEN {X.MOLECULES.index('Oc1ccccc1')} THEN (8 * (CAST(2 AS DOUBLE) / 7) + 4 * (CAST(1 AS DOUBLE) / 7)) / 15
   ELSE (8 * CAST(1 AS DOUBLE) + 4 * CAST(1 AS DOUBLE)) / 15 END AS FLOAT) AS score
   FROM part WHERE p_partkey % {_N} IN {_at('CCO', 'OCCO', 'CC(=O)O', 'N[C@@H](C)C(=O)O', 'N[C@H](C)C(=O)O', 'CC(O)=C', 'Oc1ccccc1', '[2H]OC', '[H]OC')}""")
def alcohol(spark: SparkSession, d: str) -> DataFrame:
    return _substructure(spark, d, "CO")


@query("q_sub_stereo", f"SELECT p_partkey AS compound FROM part WHERE p_partkey % {_N} IN ({X.MOLECULES.index('N[C@@H](C)C(=O)O')})")
def enantiomer(spark: SparkSession, d: str) -> DataFrame:
    return _substructure(spark, d, "OC(=O)[C@H](C)N", stereo="STRICT").select("compound")


@query("q_sub_tautomer", f"SELECT p_partkey AS compound FROM part WHERE p_partkey % {_N} IN {_at('CC(C)=O', 'CC(O)=C')}")
def tautomer(spark: SparkSession, d: str) -> DataFrame:
    return _substructure(spark, d, "CC(O)=C", search="EXACT", tautomer="INCHI").select("compound")


def _hand(query_text: str, *names: str, **modes):
    """A search over the molecule table whose hits are known by hand."""
    return lambda spark, d: _substructure(spark, d, query_text, **modes).select("compound"), f"SELECT p_partkey AS compound FROM part WHERE p_partkey % {_N} IN ({', '.join(str(X.MOLECULES.index(n)) for n in names)})"


for _name, (_run, _sql) in {
    "p3_charge_mode": _hand("CN", "CCN", "N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O", charge="DEFAULT_AS_UNCHARGED"),
    "p3_isotope_mode": _hand("[13C]", "[13CH4]", isotope="DEFAULT_AS_ANY"),
    "p3_radical_free": _hand("[Na+]", "[Na+].[Cl-]"),
    "p1_halogen_query": _hand("[X]C", "CCCl", "F/C=C/F", "F/C=C\\F"),
    "p4_hydrogen_count": _hand("[H]OC", "[2H]OC", "CCO", "CC(=O)O", "N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O", "CC(O)=C", "[H]OC", "OCCO", "Oc1ccccc1"),
    "p8_double_bond_stereo": _hand("F\\C=C\\F", "F/C=C/F", stereo="STRICT"),
    "m2_detected_aromatic": _hand("C1=CC=CC=C1", "c1ccccc1", "C1=CC=CC=C1", "c1ccc2ccccc2c1", "Oc1ccccc1", aromaticity="DETECT"),
    "m2_preserved_kekule": (lambda spark, d: _substructure(spark, d, "C1=CC=CC=C1", aromaticity="PRESERVE").select("compound"), "SELECT p_partkey AS compound FROM part WHERE 1 = 0"),
    "fp6_ring_query": _hand("C1CCCCC1", "C1CCCCC1"),
}.items():
    query(_name, _sql)(_run)


#: (heavy atoms, carbons, oxygens) of every readable structure, and how many circular descriptors of radius 0 and 1 it has
#: and shares with ethanol; counted by hand. Ethanol has C, C, O and C(-C), C(-C, -O), O(-C).
_ATOMS = {
    "CC": (2, 2, 0), "CCO": (3, 2, 1), "CCN": (3, 2, 0), "CC(=O)O": (4, 2, 2), "CCCl": (3, 2, 0), "c1ccccc1": (6, 6, 0), "C1=CC=CC=C1": (6, 6, 0), "c1ccc2ccccc2c1": (10, 10, 0), "[Na+].[Cl-]": (2, 0, 0),
    "C[N+](C)(C)C": (5, 4, 0), "[13CH4]": (1, 1, 0), "[CH3]": (1, 1, 0), "[2H]OC": (2, 1, 1), "[H]OC": (2, 1, 1), "*CC": (3, 2, 0), "N[C@@H](C)C(=O)O": (6, 3, 2), "N[C@H](C)C(=O)O": (6, 3, 2), "F/C=C/F": (4, 2, 0),
    "F/C=C\\F": (4, 2, 0), "CC(C)=O": (4, 3, 1), "CC(O)=C": (4, 3, 1), "c1cc[nH]c1": (5, 4, 0), "OCCO": (4, 2, 2), "CC(C)C": (4, 4, 0), "C1CCCCC1": (6, 6, 0), "Oc1ccccc1": (7, 6, 1),
}
_SHARED = {
    "CC": (4, 3), "CCO": (6, 6), "CCN": (6, 3), "CC(=O)O": (8, 5), "CCCl": (6, 3), "c1ccccc1": (12, 2), "C1=CC=CC=C1": (12, 2), "c1ccc2ccccc2c1": (20, 2), "[Na+].[Cl-]": (2, 0), "C[N+](C)(C)C": (10, 2), "[13CH4]": (1, 1), "[CH3]": (1, 1),
    "[2H]OC": (4, 3), "[H]OC": (4, 3), "*CC": (6, 3), "N[C@@H](C)C(=O)O": (12, 5), "N[C@H](C)C(=O)O": (12, 5), "F/C=C/F": (8, 2), "F/C=C\\F": (8, 2), "CC(C)=O": (8, 4), "CC(O)=C": (8, 5), "c1cc[nH]c1": (10, 2), "OCCO": (8, 5),
    "CC(C)C": (8, 3), "C1CCCCC1": (12, 2), "Oc1ccccc1": (14, 4),
}


def _values(rows: dict[str, tuple]) -> str:
    return ", ".join(str((X.MOLECULES.index(name), *v)) for name, v in rows.items())


@query("q_sim_molecules_all", f"SELECT p_partkey AS compound, CAST(CAST(shared AS DOUBLE) / (6 + n - shared) AS FLOAT) AS score FROM part JOIN (VALUES {_values(_SHARED)}) v(k, n, shared) ON p_partkey % {_N} = k WHERE shared >= 0.3 * (6 + n - shared)")
def similar_molecules_all(spark: SparkSession, d: str) -> DataFrame:
    """Ethanol against all at radius 1, every hit."""
    return _near_ethanol(spark, d)


@query("q_pair_all", f"""SELECT p_partkey AS compound, CAST(CAST(shared AS DOUBLE) / (3 + n - shared) AS FLOAT) AS score
  FROM part LEFT JOIN (SELECT k, n, least(c, 2) + least(o, 1) AS shared FROM (VALUES {_values(_ATOMS)}) v(k, n, c, o)) ON p_partkey % {_N} = k""")
def pair_all(spark: SparkSession, d: str) -> DataFrame:
    """Each row's structure with ethanol, null for the unreadable one."""
    texts, members = distinct(X.molecules(spark, d))
    return each(texts.select("compound", search.similarity(F.col("structure"), F.lit("CCO")).alias("score")), members)


@query("fp6_screening", f"SELECT p_partkey AS compound, TRUE AS screened, TRUE AS \"all\" FROM part WHERE p_partkey % {_N} IN {_at('c1ccccc1', 'C1=CC=CC=C1', 'c1ccc2ccccc2c1', 'Oc1ccccc1')}")
def screening(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with screening bits, against all that match: none may be lost."""
    m, members = _rows(spark, d)
    m = m.cache()
    df = document_frequency(postings(m))
    on = search.substructure_search(m, "c1ccccc1", docfreq=df).select("compound", F.lit(True).alias("screened"))
    off = search.substructure_search(m, "c1ccccc1", screen=False).select("compound", F.lit(True).alias("all"))
    both = on.join(off, "compound", "full_outer").select("compound", F.coalesce("screened", F.lit(False)).alias("screened"), F.coalesce("all", F.lit(False)).alias("all"))
    return each(both, members)


@query("s11_index_rows")
def index_rows(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).select("compound", "name", "n_heavy", "n_hyd", "n_xbond", "n_hbond", "sub_size", "sim_cum_3")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Similarity search over the molecule table."""
    return _near_ethanol(spark, d, sort=True)


from moiety.plans import generated  # noqa: E402

QUERIES |= generated.QUERIES
ORACLE |= generated.ORACLE

"""Labelled graphs, multisets, change logs and molecules derived from the supplied tables.

The SQL text of G and T is the same in Spark and DuckDB, so results of the engine's generic graph
and multiset operators can be held against plain joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.operators.prepare import postings
from moiety.operators.rows import SGROUPS

#: Order graphs: atoms are line numbers, elements come from flags, bonds join consecutive lines; even orders of three lines and more are rings.
G = """
WITH atom AS (
  SELECT l_orderkey AS gid, l_linenumber AS ln, MIN(l_partkey) AS pk, MIN(CONCAT(l_returnflag, l_linestatus)) AS fl
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
a AS MATERIALIZED (
  SELECT gid, CAST(ROW_NUMBER() OVER (PARTITION BY gid ORDER BY ln) - 1 AS INT) AS idx, pk,
         CAST(CASE fl WHEN 'AF' THEN 6 WHEN 'AO' THEN 7 WHEN 'NF' THEN 8 WHEN 'NO' THEN 16 WHEN 'RF' THEN 9 ELSE 17 END AS INT) AS z,
         CAST(COUNT(*) OVER (PARTITION BY gid) AS INT) AS n
  FROM atom),
b AS MATERIALIZED (
  SELECT x.gid, x.idx AS i, y.idx AS j, CAST(1 + x.pk % 3 AS INT) AS t
  FROM a x JOIN a y ON x.gid = y.gid AND y.idx = x.idx + 1
  UNION ALL
  SELECT x.gid, x.idx, y.idx, CAST(1 + x.pk % 3 AS INT)
  FROM a x JOIN a y ON x.gid = y.gid AND y.idx = 0 WHERE x.idx = x.n - 1 AND x.n >= 3 AND x.gid % 2 = 0),
e AS MATERIALIZED (SELECT gid, i, j, t FROM b UNION ALL SELECT gid, j, i, t FROM b),
sz AS (SELECT gid, COUNT(*) AS n_atoms FROM a GROUP BY gid),
sb AS (SELECT gid, COUNT(*) AS n_bonds FROM b GROUP BY gid)
"""

#: Token multisets of documents: level 0 the tokens.
T = """
WITH tok AS (SELECT d.doc_id, 0 AS lvl, u.bit FROM documents d, LATERAL (SELECT UNNEST(string_split(d.text, ' ')) AS bit) u),
c AS (SELECT doc_id, lvl, bit, COUNT(*) AS n FROM tok GROUP BY doc_id, lvl, bit),
sz AS (SELECT doc_id, SUM(n) AS sz FROM c GROUP BY doc_id)
"""

MOLECULES = (
    "CC", "CCO", "CCN", "CC(=O)O", "CCCl", "c1ccccc1", "C1=CC=CC=C1", "c1ccc2ccccc2c1", "[Na+].[Cl-]", "C[N+](C)(C)C", "[13CH4]", "[CH3]", "[2H]OC", "[H]OC",
    "*CC", "N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O", "F/C=C/F", "F/C=C\\F", "CC(C)=O", "CC(O)=C", "c1cc[nH]c1", "not a molecule(", "OCCO", "CC(C)C", "C1CCCCC1", "Oc1ccccc1",
)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ordered_atoms(spark: SparkSession, d: str) -> DataFrame:
    """(gid, v): a graph's atoms in line order, after one shuffle by order key."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat("l_returnflag", "l_linestatus").alias("fl"))
    atom = line.groupBy(F.col("l_orderkey").alias("gid"), F.col("l_linenumber").alias("ln")).agg(F.min("l_partkey").alias("pk"), F.min("fl").alias("fl"))
    z = F.create_map(*[F.lit(x) for kv in (("AF", 6), ("AO", 7), ("NF", 8), ("NO", 16), ("RF", 9)) for x in kv])
    return atom.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("ln", "pk", F.coalesce(F.try_element_at(z, "fl"), F.lit(17)).alias("z")))).alias("v"))


def graph_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Atoms (gid, idx, z, n) and bonds (gid, i, j, t) of G."""
    graph = _ordered_atoms(spark, d)
    atoms = graph.select("gid", F.posexplode("v").alias("idx", "x"), F.size("v").alias("n")).select("gid", "idx", F.col("x.z").alias("z"), "n")
    return atoms, _bonds(graph).select("gid", F.explode("bonds").alias("b")).select("gid", "b.i", "b.j", "b.t")


def _bonds(graph: DataFrame) -> DataFrame:
    n = F.size("v")
    kind = lambda k: (1 + F.col("v")[k]["pk"] % 3).cast("int")
    chain = F.transform(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(k.alias("i"), (k + 1).alias("j"), kind(k).alias("t")))
    ring = F.when((n >= 3) & (F.col("gid") % 2 == 0), F.array(F.struct((n - 1).alias("i"), F.lit(0).alias("j"), kind(n - 1).alias("t")))).otherwise(F.array().cast("array<struct<i:int,j:int,t:int>>"))
    return graph.withColumn("bonds", F.concat(chain, ring))


def graphs(spark: SparkSession, d: str) -> DataFrame:
    """G as index rows for the matcher: compound, atoms, bonds, sgroups, sizes."""
    graph = _bonds(_ordered_atoms(spark, d))
    zero = F.lit(0)
    atoms = F.transform("v", lambda x: F.struct(x["z"].cast("int").alias("z"), zero.alias("h"), zero.alias("charge"), zero.alias("mass"), zero.alias("radical"), zero.alias("stereo"), F.lit("").alias("label")))
    none = F.lit(None).cast("int")
    bonds = F.transform("bonds", lambda b: F.struct(b["i"].alias("a"), b["j"].alias("b"), b["t"].alias("type"), zero.alias("stereo"), none.alias("ra"), none.alias("rb")))
    return graph.select(F.col("gid").alias("compound"), atoms.alias("atoms"), bonds.alias("bonds"), F.array().cast(SGROUPS).alias("sgroups"), F.size("v").alias("n_heavy"), F.lit(0).alias("n_hyd"), F.size("bonds").alias("n_xbond"), F.lit(0).alias("n_hbond"))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """T as (id, lvl, bit)."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("lvl"), F.explode(F.split("text", " ")).alias("bit"))


def word_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as index rows whose bits are words: compound, sub_bits, sim_levels (one level)."""
    words = F.split("text", " ")
    return table(spark, d, "documents").select(F.col("doc_id").alias("compound"), words.alias("sub_bits"), F.array(words).alias("sim_levels"))


def word_postings(spark: SparkSession, d: str) -> DataFrame:
    return postings(word_rows(spark, d))


def changes(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a change log (event_id, compound, kind)."""
    kind = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type").isin("purchase", "click"), "UPDATE").when(F.col("event_type") == "error", "DELETE")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("compound"), kind.alias("kind")).filter("kind IS NOT NULL")


def molecules(spark: SparkSession, d: str) -> DataFrame:
    """(id, molfile): a list of structures spread over the part table."""
    names = F.array(*[F.lit(x) for x in MOLECULES])
    return table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("id"), names[(F.col("p_partkey") % len(MOLECULES)).cast("int")].alias("molfile"))

"""Index rows, searches, the versioned store, the feed and SQL functions on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from moiety import sql
from moiety.operators import multiset, search
from moiety.operators.prepare import document_frequency, postings, prepare, split
from moiety.sources.index import Conflict, IndexStore, balanced_merge, collapse, event_changes, snapshot_changes
from moiety.sources.molecules import read_sdf, read_smiles
from moiety.streaming.audit import feed
from tests.test_functions import ETHANOL

ROWS = [(1, "CCO"), (2, "CCN"), (3, "c1ccccc1O"), (4, "bad("), (5, None), (6, "CC(=O)O"), (7, "N[C@@H](C)C(=O)O"), (8, ETHANOL)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, molfile string")


@pytest.fixture(scope="module")
def molecules(table):
    return split(prepare(table))[0].cache()


def ids(df):
    return sorted(r["compound"] for r in df.collect())


def test_rows_and_errors(table, molecules):
    assert ids(molecules) == [1, 2, 3, 6, 7, 8]
    bad = {r["compound"]: r["message"] for r in split(prepare(table))[1].collect()}
    assert sorted(bad) == [4, 5] and all(bad.values())


def test_substructure(molecules):
    df = document_frequency(postings(molecules))
    got = {r["compound"]: r["score"] for r in search.substructure_search(molecules, "CO", docfreq=df).collect()}
    assert sorted(got) == [1, 3, 6, 7, 8]
    assert got[1] == got[8] == pytest.approx(0.4888889)
    assert ids(search.substructure_search(molecules, "CO", screen=False)) == sorted(got)
    assert [r["compound"] for r in search.substructure_search(molecules, "CO", topn=2).collect()] == [1, 8]
    assert search.substructure_search(molecules, "CO", topn=0).count() == 0
    assert ids(search.substructure_search(molecules, "OCC", search="EXACT")) == [1, 8]


def test_budget_goes_to_a_side_list(molecules):
    hits = search.substructure_hits(molecules, "CO", limit=1, screen=False)
    assert hits.filter("timed_out").count() > 0
    assert search.substructure_search(molecules, "CO", limit=1, screen=False).count() == 0


def test_candidates_are_filtered_before_python(molecules):
    plan = search.substructure_search(molecules, "CO")._jdf.queryExecution().toString()
    optimized = plan[plan.index("Optimized Logical Plan") :]
    assert optimized.index("MapInArrow") < optimized.index("array_contains")


def test_similarity(molecules):
    df = document_frequency(postings(molecules))
    got = {r["compound"]: round(r["score"], 6) for r in search.similarity_search(molecules, "CCO", 0.3, docfreq=df).collect()}
    assert got[1] == got[8] == 1.0 and got[2] == round(3 / 9, 6)
    bare = {r["compound"]: round(r["score"], 6) for r in search.similarity_search(molecules, "CCO", 0.3, screen=False).collect()}
    assert bare == got
    assert "Python" not in search.similarity_search(molecules, "CCO", 0.3)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        search.similarity_search(molecules, "CCO", 0.0)
    with pytest.warns(UserWarning):
        assert search.similarity_search(molecules, "CCO", radius=4).count() == 0
    assert search.similarity_search(molecules, None).count() == 0


def test_threshold_is_compared_in_32_bits(spark):
    c = spark.range(1).select(multiset.tanimoto(F.lit(17), F.lit(20), F.lit(17)).alias("s"))
    assert c.filter(F.col("s") >= F.lit(0.85).cast("float")).count() == 1


def test_overlap_counts_repeats(spark):
    df = spark.createDataFrame([([[1, 1, 1, 2], [5]],)], "v array<array<int>>")
    assert df.select(multiset.array_overlap(F.col("v"), [[1, 1, 2, 3], [5, 5]])).first()[0] == 4


def test_prefix_is_never_too_short():
    assert multiset.prefix({1: 1, 2: 1, 3: 1}, {}, 0.9) == [1, 2]
    assert multiset.prefix({1: 5, 2: 1}, {1: 9, 2: 1}, 0.5) == [2, 1]


def test_choose_bits_covers_twice():
    cover = {b: {0, 1} for b in range(5)}
    assert search.choose_bits(set(cover), cover, {0: 5, 1: 1, 2: 2, 3: 3, 4: 4}, 2) == [1, 2]


def test_store(spark, table, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}")
    store.add_index("mols", "", "t", table=table)
    with pytest.raises(ValueError, match="not been synced"):
        store.molecules("mols")
    with pytest.raises(ValueError):
        store.add_index("mols", "", "t", table=table)
    with pytest.raises(ValueError):
        store.add_index("no-such name", "", "t", table=table)
    with pytest.raises(ValueError):
        store.add_index("zero", "", "t", table=table, threads=0)
    assert store.sync_data("mols", table=table) == 1
    assert store.index_size("mols") == 6 and store.errors("mols").count() == 2 and store.pending("mols").count() == 0
    seg = store.segments("mols").collect()
    assert sum(r["molecules"] for r in seg) == 6 and all(r["size"] > 0 and r["deletes"] == 0 for r in seg)
    held = store.molecules("mols")
    after = table.filter("id <> 1").withColumn("molfile", F.when(F.col("id") == 2, "CCCN").otherwise(F.col("molfile")))
    store.capture("mols", table, after)
    assert {(r["compound"], r["delete"]) for r in store.pending("mols").collect()} == {(1, True), (2, True)}
    assert store.sync_data("mols", table=after) == 2
    assert ids(held) == [1, 2, 3, 6, 7, 8], "a reader keeps the version it opened"
    # a step by step index equals one made at once
    other = IndexStore(spark, f"file://{tmp_path}/full")
    other.add_index("mols", "", "t", table=after)
    other.sync_data("mols", table=after)
    pick = lambda s: sorted((r["compound"], r["sub_bits"], r["sim_levels"]) for r in s.molecules("mols").select("compound", "sub_bits", "sim_levels").collect())
    assert pick(store) == pick(other)
    assert store.cleanup("mols") == ["v=1"]
    assert ids(store.substructure_search("mols", "CCCN")) == [2]
    assert ids(store.similarity_search("mols", "CCCN")) == [2]
    store.remove_index("mols")
    assert store.catalog() == []


def test_a_small_sync_rewrites_no_base_file(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}")
    rows = spark.range(3000).select("id", F.element_at(F.array(F.lit("CCO"), F.lit("CCN"), F.lit("c1ccccc1")), (F.col("id") % 3 + 1).cast("int")).alias("molfile"))
    store.add_index("m", "", "t", table=rows)
    store.sync_data("m", table=rows)
    files = {p: p.stat().st_mtime_ns for p in tmp_path.glob("m/segments/*/*/*.parquet")}
    for k in range(10):  # ten small changes: one row replaced, one new, one deleted
        rows = rows.withColumn("molfile", F.when(F.col("id") == k, "CCCl").otherwise(F.col("molfile"))).filter(F.col("id") != 100 + k).unionByName(spark.createDataFrame([(5000 + k, "OCCO")], "id long, molfile string"))
        store.enqueue("m", spark.createDataFrame([(k, True), (5000 + k, False), (100 + k, True)], "compound long, delete boolean"))
        store.sync_data("m", table=rows)
    assert {p: p.stat().st_mtime_ns for p in tmp_path.glob("m/segments/*/*/*.parquet") if p in files} == files
    assert store.entry("m").version == 11 and store.index_size("m") == store.molecules("m").count() == 3000
    seg = sorted((r["molecules"], r["deletes"]) for r in store.segments("m").collect())
    assert len(seg) <= 4 and seg[-1] == (2980, 20) and sum(n for n, _ in seg) == 3000
    assert ids(store.substructure_search("m", "CCl")) == list(range(10)) and ids(store.substructure_search("m", "OCCO")) == [5000 + k for k in range(10)]
    assert store.postings("m").filter("compound BETWEEN 100 AND 109").count() == 0
    store.cleanup("m")
    assert store.molecules("m").count() == 3000


def test_two_writers_do_not_lose_each_other(spark, table, tmp_path):
    a, b = IndexStore(spark, f"file://{tmp_path}"), IndexStore(spark, f"file://{tmp_path}")
    a.add_index("one", "", "t", table=table)
    base, entries = b._read_catalog()
    a.add_index("two", "", "t", table=table)
    with pytest.raises(Conflict):
        b._write_catalog(entries, base)
    assert [e.index_name for e in b.catalog()] == ["one", "two"]
    # a writer that died after its claim: the old catalog stands, and a later writer goes on
    base, entries = b._read_catalog()
    claim = tmp_path / "catalog" / f"{base + 1:010d}.claim"
    claim.touch()
    with pytest.raises(Conflict):
        b._write_catalog(entries, base)
    os.utime(claim, (1, 1))
    b._write_catalog(entries[:1], base)
    assert [e.index_name for e in a.catalog()] == ["one"]


def test_changes(spark):
    log = spark.createDataFrame([(1, "INSERT"), (2, "INSERT"), (2, "UPDATE"), (3, "DELETE"), (4, "VIEW")], "compound long, kind string")
    assert sorted(map(tuple, collapse(event_changes(log)).collect())) == [(1, False), (2, True), (3, True)]
    old = spark.createDataFrame([(1, "C"), (2, None), (3, "N"), (4, None)], "id long, molfile string")
    new = spark.createDataFrame([(1, "C"), (2, "O"), (4, None), (5, "S")], "id long, molfile string")
    assert sorted(map(tuple, snapshot_changes(old, new).collect())) == [(2, True), (3, True), (5, False)]


def test_balanced_merge():
    assert balanced_merge([5, 1, 9], 4) == [[0], [1], [2]]
    assert sorted(balanced_merge([10, 8, 3, 1], 2)) == [[0], [1, 2, 3]]


def test_feed(spark, table, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/store")
    store.add_index("mols", "", "t", table=table.filter("id < 3"))
    store.sync_data("mols", table=table.filter("id < 3"))
    spark.createDataFrame([(3, "INSERT"), (1, "DELETE")], "compound long, kind string").write.parquet(str(tmp_path / "log"))
    events = spark.readStream.schema("compound long, kind string").parquet(str(tmp_path / "log"))
    q = feed(store, "mols", events, str(tmp_path / "ck"), table=lambda: table.filter("id IN (2, 3)"))
    q.processAllAvailable()
    q.stop()
    assert ids(store.molecules("mols")) == [2, 3]


def test_truncate_empties_the_index(spark, table, tmp_path):
    log = spark.createDataFrame([(None, "TRUNCATE"), (9, "INSERT")], "compound long, kind string")
    ids_ = spark.createDataFrame([(1,), (2,)], "compound long")
    assert sorted(map(tuple, collapse(event_changes(log, ids_)).collect())) == [(1, True), (2, True), (9, False)]
    assert sorted(map(tuple, event_changes(log.filter("kind = 'INSERT'"), ids_).collect())) == [(9, False)]
    with pytest.raises(Exception, match="TRUNCATE needs"):
        event_changes(log).collect()
    store = IndexStore(spark, f"file://{tmp_path}/store")
    store.add_index("mols", "", "t", table=table.filter("id < 3"))
    store.sync_data("mols", table=table.filter("id < 3"))
    log.withColumn("compound", F.when(F.col("kind") == "INSERT", 3)).write.parquet(str(tmp_path / "log"))
    events = spark.readStream.schema("compound long, kind string").parquet(str(tmp_path / "log"))
    q = feed(store, "mols", events, str(tmp_path / "ck"), table=lambda: table.filter("id = 3"))
    q.processAllAvailable()
    q.stop()
    assert ids(store.molecules("mols")) == [3]


def test_sql(spark, molecules):
    sql.register(spark, molecules)
    assert ids(spark.sql("SELECT * FROM substructure_search('CO')")) == [1, 3, 6, 7, 8]
    assert ids(spark.sql("SELECT * FROM substructure_search('OCC', 'EXACT')")) == [1, 8]
    got = spark.sql("SELECT q.q, r.compound FROM VALUES ('CCN'), ('CCO') q(q), LATERAL similarity_search(q.q, 0.9) r")
    assert sorted(map(tuple, got.collect())) == [("CCN", 2), ("CCO", 1), ("CCO", 8)]
    row = spark.sql("SELECT similarity('CCO', 'CCN', 1, 'AUTO') AS a, similarity(NULL, 'C', 1, 'AUTO') AS b, index_size() AS n").first()
    assert row["a"] == 0.5 and row["b"] is None and row["n"] == 6


def test_sql_arguments_equal_the_python_search(spark, molecules):
    sql.register(spark, molecules)
    key = lambda df: sorted((r["compound"], r["score"]) for r in df.collect())
    cases = [
        ("OC(=O)[C@H](C)N", {"stereo": "STRICT"}),
        ("OC(=O)[C@@H](C)N", {"stereo": "STRICT"}),
        ("CC(O)=O", {"tautomer": "INCHI"}),
        ("C1=CC=CC=C1", {"aromaticity": "PRESERVE"}),
        ("CN", {"charge": "DEFAULT_AS_UNCHARGED", "isotope": "DEFAULT_AS_STANDARD", "radical": "DEFAULT_AS_STANDARD"}),
        ("CO", {"search": "EXACT"}),
        ("CO", {"topn": 2}),
        ("CO", {"topn": 0}),
        ("CO", {"limit": 2}),
    ]
    for query, args in cases:
        named = "".join(f", {k} => {v if isinstance(v, int) else repr(v)}" for k, v in args.items())
        assert key(spark.sql(f"SELECT * FROM substructure_search('{query}'{named})")) == key(search.substructure_search(molecules, query, **args)), (query, args)
    assert key(spark.sql("SELECT * FROM similarity_search('CCO', 0.2, 2, 'AUTO', 'IGNORE', 3)")) == key(search.similarity_search(molecules, "CCO", 0.2, 2, topn=3))
    best = [r["score"] for r in spark.sql("SELECT * FROM substructure_search('CO', sort => TRUE)").collect()]
    assert best == sorted(best, reverse=True) and len(best) == 5
    assert spark.sql("SELECT * FROM substructure_search(NULL)").count() == 0
    got = spark.sql("SELECT q.q, r.compound FROM VALUES ('CN'), ('CO') q(q), LATERAL substructure_search(q.q, topn => 1) r")
    assert sorted(map(tuple, got.collect())) == [("CN", 2), ("CO", 1)]


def test_sql_over_a_stored_index(spark, table, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}")
    store.add_index("stored", "", "t", table=table)
    store.sync_data("stored", table=table)
    sql.register_index(store, "stored")
    assert spark.sql("SELECT index_size() AS n").first()["n"] == 6
    assert spark.sql("SELECT sum(molecules) AS n, sum(deletes) AS d FROM stored_segments").first() == (6, 0)
    assert ids(spark.sql("SELECT * FROM substructure_search('CN')")) == [2, 7]


def test_out_of_budget_rows_follow_the_hits(molecules):
    got = search.substructure_top(molecules, "CCO", 10, limit=3).collect()
    late = [r["timed_out"] for r in got]
    assert late == sorted(late) and any(late) and all(r["score"] == 0 for r in got if r["timed_out"])


def test_sd_items(spark, tmp_path):
    """Several lines, repeated keys, Windows line ends."""
    item = "> <A>\n1\n\n> <A>\n2\n\n> <B> (7)\n3\nthree\n\n"
    for end in ("\n", "\r\n"):
        path = tmp_path / f"x{len(end)}.sdf"
        path.write_bytes(((ETHANOL + item + "$$$$\n") * 2).replace("\n", end).encode())
        rows = read_sdf(spark, str(path), end).collect()
        assert [r["data"] for r in rows] == [{"A": "1", "B": "3\nthree"}] * 2 and all("\r" not in r["molfile"] for r in rows)


def test_batched(molecules):
    got = search.batched_substructure(molecules, {1: "CO", 2: "CN"}, k=1)
    assert sorted((r["query_id"], r["compound"]) for r in got.collect()) == [(1, 1), (2, 2)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.smi").write_text("CCO ethanol\n\nCCN\n")
    assert sorted((r["molfile"], r["title"]) for r in read_smiles(spark, str(tmp_path / "a.smi")).collect()) == [("CCN", ""), ("CCO ethanol", "ethanol")]
    (tmp_path / "a.sdf").write_text((ETHANOL + "> <K>\nv\n\n$$$$\n") * 2)
    rows = read_sdf(spark, str(tmp_path / "a.sdf"))
    assert [r["data"] for r in rows.collect()] == [{"K": "v"}] * 2
    good, bad = split(prepare(rows))
    assert good.count() == 2 and bad.count() == 0


def test_empty_table(spark, table):
    good, bad = split(prepare(table.limit(0)))
    assert good.count() == bad.count() == 0
    assert search.substructure_search(good, "CO").count() == 0


def test_an_index_holds_each_text_once(spark, tmp_path):
    """Rows and postings of 300 compounds of three texts are those of three rows, through deletes and merges too."""
    rows = spark.range(300).select("id", F.element_at(F.array(F.lit("CCO"), F.lit("CCN"), F.lit("CCCl")), (F.col("id") % 3 + 1).cast("int")).alias("molfile"))
    store = IndexStore(spark, f"file://{tmp_path}")
    store.add_index("m", "", "t", segments=1, table=rows)
    store.sync_data("m", table=rows)
    assert spark.read.parquet(f"{tmp_path}/m/segments/*/molecules").count() == 3
    posting = spark.read.parquet(f"{tmp_path}/m/segments/*/postings")
    assert posting.count() == posting.distinct().count() == store.postings("m").filter("compound < 3").count()
    assert store.molecules("m").count() == store.index_size("m") == 300 and store.docfreq("m").agg(F.max("df")).first()[0] == 300
    now = rows.filter("id % 3 <> 1").unionByName(spark.createDataFrame([(900, "CCCl"), (901, "OCCO")], "id long, molfile string"))
    store.capture("m", rows, now)
    store.sync_data("m", table=now)
    store.cleanup("m")
    assert sorted(r["text"] for r in store.view("m").rows.select(F.col("text_key").alias("text")).collect()) == sorted({r["t"] for r in now.select(F.sha2("molfile", 256).alias("t")).collect()})
    assert ids(store.substructure_search("m", "CCl")) == [*range(2, 300, 3), 900] and ids(store.substructure_search("m", "CN")) == []
    assert [r["compound"] for r in store.substructure_search("m", "CCl", topn=2).collect()] == [2, 5]
    assert store.docfreq("m").agg(F.max("df")).first()[0] == store.index_size("m") == store.ids("m").count() == 202


def test_a_sync_without_failures_joins_no_members_for_errors(spark, table, tmp_path):
    """Such a join ended at once, and its scan of the members went on while their files were removed."""
    store = IndexStore(spark, f"file://{tmp_path}")
    clean = table.filter("molfile = 'CCO'")
    store.add_index("m", "", "t", table=clean)
    store.sync_data("m", table=clean)
    assert clean.count() and store.index_size("m") == clean.count()
    assert not (tmp_path / "m" / "errors").exists() and store.errors("m").count() == 0
    store.add_index("bad", "", "t", table=spark.createDataFrame([(1, "not a molecule(")], "id long, molfile string"))
    store.sync_data("bad", table=spark.createDataFrame([(1, "not a molecule(")], "id long, molfile string"))
    assert store.index_size("bad") == store.molecules("bad").count() == 0 and store.errors("bad").count() == 1


def test_sql_numbers_all_rows_only_for_topn(spark, table, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}")
    twice = table.unionByName(table.withColumn("id", F.col("id") + 100))
    store.add_index("twice", "", "t", table=twice)
    store.sync_data("twice", table=twice)
    sql.register_index(store, "twice")
    all_ = spark.sql("SELECT q.q, r.compound FROM VALUES ('CN'), ('CO') q(q), LATERAL substructure_search(q.q) r")
    numbered = [x for x in all_._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [row_number" in x]
    assert all("compound#" in x.split("], [")[1] or "spread#" in x.split("], [")[1] for x in numbered), numbered
    assert sorted(map(tuple, all_.collect())) == [("CN", i) for i in (2, 7, 102, 107)] + [("CO", i) for i in (1, 3, 6, 7, 8, 101, 103, 106, 107, 108)]
    best = spark.sql("SELECT q.q, r.compound FROM VALUES ('CN'), ('CO') q(q), LATERAL substructure_search(q.q, topn => 2) r")
    assert sorted(map(tuple, best.collect())) == [("CN", 2), ("CN", 102), ("CO", 1), ("CO", 8)]
    assert spark.sql("SELECT index_size() AS n").first()["n"] == 12 and spark.sql("SELECT * FROM twice").count() == 12


def test_a_pair_is_compared_once(monkeypatch):
    import pandas as pd

    calls, plain = [], search.structures.pair_similarity
    monkeypatch.setattr(search.structures, "pair_similarity", lambda *key: calls.append(key) or plain(*key))
    got = search.pair_similarity_udf().func(pd.Series(["CCN", "bad("] * 50), pd.Series(["CCO"] * 100), pd.Series([1] * 100), pd.Series(["AUTO"] * 100))
    assert len(calls) == 2 and list(got[:1]) == [0.5] and got.isna().sum() == 50


def test_few_rows_are_python_objects_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"compound": list(range(10_000))})
    sizes = [b.num_rows for b in search.slices(iter([batch]))]
    assert sum(sizes) == 10_000 and max(sizes) <= search.AT_ONCE


def test_sorting_runs_the_matcher_once(molecules):
    """Ranges are sampled from a shuffle of the hits."""
    plan = search.substructure_search(molecules, "CO", sort=True)._jdf.queryExecution().executedPlan().toString()
    order = [plan.index(x) for x in ("rangepartitioning", "hashpartitioning", "MapInArrow")]
    assert order == sorted(order)
    got = [(-r["score"], r["compound"]) for r in search.substructure_search(molecules, "CO", sort=True).collect()]
    assert got == sorted(got) and len(got) == 5

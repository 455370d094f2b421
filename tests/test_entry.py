"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from moiety.plans import queries as core

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, D)
    want = duck.sql(core.ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_screening_loses_nothing(spark):
    rows = core.screening(spark, D).collect()
    assert rows and all(r["screened"] and r["all"] for r in rows)


def test_pair_and_similarity_cover_every_structure(spark):
    m = {r["id"]: r["molfile"] for r in core.X.molecules(spark, D).collect()}
    score = {r["compound"]: r["score"] for r in core.QUERIES["q_pair_all"](spark, D).collect()}
    assert set(score) == set(m) and {m[k] for k, v in score.items() if v is None} == {"not a molecule("}
    hits = {m[r["compound"]] for r in core.QUERIES["q_sim_molecules_all"](spark, D).collect()}
    assert hits == {"CC", "CCO", "CCN", "CC(=O)O", "CCCl", "[2H]OC", "[H]OC", "*CC", "N[C@@H](C)C(=O)O", "N[C@H](C)C(=O)O", "CC(C)=O", "CC(O)=C", "OCCO"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

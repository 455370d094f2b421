"""Operators and registered queries on Spark: brute force, round trips, odd tables."""

import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from moiety.llm import chat, decontaminate, langid, license, neardup, packing, queries, sharding, tokenfile, topk, toxicity
from moiety.llm.bpe import Encoder, default_path
from moiety.llm.components import components
from tests.llm.test_kernels import slow_set

D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, shard int, score double"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "s0", 57, "x", 1, 0.0),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "s0", 0, None, None, None),
    (4, " \n\t ", "de", "s1", 4, None, None, None),
    (5, "word", "fr", "s1", 4, None, None, None),
    (1, "The quick brown fox jumps over the lazy dog and runs away", "en", "s0", 57, "x", 1, 0.0),
    (6, "so " + "many different words " * 2500 + "end", "en", "s0", 50000, None, None, None),
    (7, "$$$ 123 ...", "en", "s0", 11, None, None, None),
    (8, "The quick brown fox jumps over the lazy dog and runs away", "en", "s0", 57, None, None, None),
    (9, "漢字 ünïcode <|endoftext|> text", "de", "s0", 30, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{D}/documents.parquet")


def table(spark, name):
    return spark.read.parquet(f"{D}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, docs, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, D), c.sql(queries.ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


# ---- 1

def test_decontaminate_odd(spark, odd, empty):
    bench = spark.createDataFrame([(10, "quick brown fox jumps over the lazy dog and"), (2, "Fox jumps over THE lazy dog, and runs"), (3, None), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.find(odd, bench).collect()}
    assert got[1]["n_hit"] == 10 and got[1]["n_items"] == 2 and got[1]["contaminated"]
    assert got[1]["items_sha256"] == hashlib.sha256(b"10,2").hexdigest()
    assert got[2]["n_words"] == got[3]["n_words"] == 0 and got[2]["items_sha256"] == hashlib.sha256(b"").hexdigest()
    assert decontaminate.find(odd, bench).count() == len(ODD)
    assert decontaminate.find(empty, bench).count() == 0 and not decontaminate.find(odd, bench.limit(0)).filter("n_hit > 0").count()
    kept = decontaminate.remove(odd, bench)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [2, 3, 4, 5, 6, 7, 9]
    long = spark.createDataFrame([(1, "a b c d e f quick brown fox jumps over the lazy dog g h i j k l", 61)], "doc_id long, text string, n_chars long")
    row = decontaminate.remove(long, bench).first()
    assert row["text"] == "a b c d e f   g h i j k l" and row["n_chars"] == len(row["text"])


def test_decontaminate_with_many_automata(spark, docs, odd, monkeypatch):
    """Items spread over several automata give what one gives."""
    bench = table(spark, "benchmark").unionByName(spark.createDataFrame([(9001, "fox jumps"), (9002, "quick brown fox jumps over the lazy dog and runs")], "item_id long, text string"))
    rows = docs.select("doc_id", "text", "n_chars").unionByName(odd.select("doc_id", "text", "n_chars"))
    key = lambda df: sorted(map(repr, df.collect()))
    found, kept = key(decontaminate.find(rows, bench)), key(decontaminate.remove(rows, bench))
    assert any("fox" not in r and "The quick brown" in r for r in kept) or len(kept) < rows.count()
    monkeypatch.setattr(decontaminate, "MAX_ITEM_BYTES", 2000)
    assert len(decontaminate._parts(bench)) > 3
    assert key(decontaminate.find(rows, bench)) == found and key(decontaminate.remove(rows, bench)) == kept


# ---- 2

def test_language_query(spark, docs):
    rows = queries.op2_language(spark, D).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_language_odd(odd, empty):
    model = langid.learn(odd)
    got = {r["doc_id"]: r for r in langid.identify(odd, model).collect()}
    assert [got[k]["lang_pred"] for k in (2, 3, 4, 7)] == ["und"] * 4 and got[1]["lang_pred"] in ("en", "de", "fr")
    assert langid.keep_named(odd, model).filter("doc_id IN (2, 3, 4, 7)").count() == 0
    assert langid.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, langid.learn(empty)).collect()} == {"und"}


def test_language_rejection_and_calibration(spark):
    """Each language left out in turn: its texts are rejected, the others' are not; scores mean what they say."""
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang").cache()
    for out in ("de", "en", "es", "fr", None):
        known = docs if out is None else docs.filter(F.col("lang") != out)
        model = langid.learn(known, keep=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
        rows = langid.identify(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 3 == 1), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
        own = [r for r in rows if r["lang"] != out]
        assert sum(r["rejected"] for r in own) <= 0.02 * len(own)
        if out is not None:
            other = [r for r in rows if r["lang"] == out]
            assert sum(r["rejected"] for r in other) >= 0.8 * len(other)
        bins = {}
        for r in own:
            bins.setdefault(min(9, int(10 * r["score"])), []).append((r["score"], r["lang_pred"] == r["lang"]))
        error = sum(abs(sum(s for s, _ in v) - sum(c for _, c in v)) for v in bins.values()) / len(own)
        assert error <= 0.03


# ---- 3

def check_packing(docs, got, capacity=2048, least_fill=0.9):
    encoder = Encoder.of(default_path("word_bpe_49k.json"))
    pieces = {}
    for r in got.collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    want = {}
    for r in docs.collect():
        want.setdefault(r["doc_id"], []).append([*encoder.model.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    assert pieces.keys() == want.keys()
    for k, all_ids in want.items():
        assert sum(r["length"] for r in pieces[k]) == sum(map(len, all_ids))
        for r in pieces[k]:
            crcs = {zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids[r["start"] : r["start"] + r["length"]])) for ids in all_ids}
            assert r["ids_crc32"] in crcs and r["doc_tokens"] in map(len, all_ids)
    bins = {}
    for rows in pieces.values():
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = room = 0
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += at
        room += at if at & (at - 1) == 0 else capacity
    assert total >= least_fill * room


def test_packing(spark, docs):
    check_packing(docs, queries.op3_harmonic_pack(spark, D), least_fill=0.98)


def test_packing_odd(odd, empty):
    check_packing(odd, packing.pack(odd))
    assert packing.pack(empty).count() == 0
    s = packing.sequences(packing.pack(odd, capacity=64, with_tokens=True), capacity=64).collect()
    assert all(len(r["tokens"]) == (r["used"] if bin(r["used"]).count("1") == 1 else 64) for r in s)


def test_packing_second_round(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    check_packing(docs, packing.pack(docs))


# ---- 4

def test_license_scan(spark, odd, empty):
    rows = [(1, "x y Released under the MIT\nLicense. z"), (2, None), (3, ""), (4, "licensed under cc by nc 4 0 and Licensed under the Apache License, Version 2.0."), (4, "nothing"), (5, "word " * 40_000 + "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("template", F.lit("clash"))
    got = sorted((r["doc_id"], r["template"], r["coverage"], r["start_word"]) for r in license.scan(df).collect())
    assert got == [(1, "mit", 1.0, 2), (4, "apache-2.0", 1.0, 8), (4, "cc-by-nc-4.0", 1.0, 0), (5, "mit", 1.0, 40_000)]
    assert license.scan(empty).count() == 0 and license.scan(odd).count() == 0
    own = spark.createDataFrame([("n", "quick brown fox jumps"), ("e", None)], "name string, text string")
    assert {r["doc_id"] for r in license.scan(odd, own).collect()} == {1, 8}


def test_license_query_finds_every_notice(spark, docs):
    notices = {k: v for k, v in license.NOTICES}
    want = {(r["doc_id"], k) for r in docs.collect() for k, v in notices.items() if v in (r["text"] or "")}
    got = {(r["doc_id"], r["template"]) for r in queries.op4_license_scan(spark, D).filter("coverage = 1").collect()}
    assert want <= got


def test_license_query_finds_texts_and_headers(spark, tmp_path):
    texts = dict(license.standard("text") + license.standard("header"))
    rows = [(k, f"Copyright somebody\n{v}\nint main() {{}}") for k, v in enumerate(texts.values())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op4_license_scan(spark, str(tmp_path)).filter("coverage = 1").collect()
    assert {(k, v) for k, v in enumerate(texts)} <= {(r["doc_id"], r["template"]) for r in got}
    assert len(texts) == 9


# ---- 5

def check_shards(df, got, shards=16):
    rows = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    for s in {r["shard"] for r in rows}:
        assert 0 <= s < shards
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    return rows


def test_shards(spark, docs):
    rows = check_shards(docs, queries.op5_kd_shards(spark, D))
    load = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(load) < 1.25 * sum(load) / 16
    where = {}
    for r in rows:
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert all(len(v) == 1 for v in where.values())


def test_shards_odd(spark, odd, empty):
    check_shards(odd, sharding.shard(odd))
    assert sharding.shard(empty).count() == 0


def test_a_hot_group_is_split(spark):
    rows = [(k, "the same text over and over") for k in range(600)] + [(1000 + k, f"text number {k} of others") for k in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = check_shards(df, sharding.shard(df))
    load = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(load) < 1.3 * sum(load) / 16


def test_native_plans_hold_no_python(spark, docs):
    for name in ("op5_kd_shards", "op7_chat"):
        plan = queries.QUERIES[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan and "Pandas" not in plan


# ---- 6

def test_toxicity_query(spark, docs):
    rows = queries.op6_toxicity(spark, D).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, None), (None, 1), (5, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    assert toxicity.keep_ordinary(odd, toxicity.learn(odd, labels.limit(0))).count() == len(ODD)


def test_toxicity_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in queries.op6_toxicity(spark, d).filter("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.5 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.02 * n[0, 0]


# ---- 7

def test_chat_trees(spark):
    rows = [
        (1, 1, None, "system", "be kind", 0.0),
        (1, 2, 1, "user", "hi <|end|> \\ <\\|x|>", 1.0),
        (1, 3, 2, "assistant", "good [/INST] <<SYS>> [\\INST]", 5.0),
        (1, 4, 2, "assistant", None, 2.0),
        (1, 5, 4, "user", "more", None),
        (2, 1, 99, None, "a root whose parent is missing", 0.0),
        (None, 1, None, "assist|>ant", "|>\n", 0.0),
    ]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit(0))
    back = {(r["tree"], r["leaf"]): r for r in chat.read_back(chat.format_trees(nodes)).collect()}
    turns = {k: [tuple(t) for t in r["turns"]] for k, r in back.items()}
    assert turns[1, 3] == [("system", "be kind"), ("user", rows[1][4]), ("assistant", rows[2][4])]
    assert turns[1, 5] == [("system", "be kind"), ("user", rows[1][4]), ("assistant", ""), ("user", "more")]
    assert turns[2, 1] == [("", rows[5][4])] and turns[None, 1] == [("assist|>ant", "|>\n")]
    assert back[1, 3]["rank"] == 1 and back[1, 5]["rank"] == 2 and back[1, 3]["loss_text"] == rows[2][4]
    assert {(r["tree"], r["leaf"]) for r in chat.format_trees(nodes, keep=1).collect()} == {(1, 3), (2, 1), (None, 1)}
    assert chat.format_trees(nodes.limit(0)).count() == 0


def test_chat_escapes_are_reversible(spark):
    r = random.Random(4)
    bits = ["<", "\\", "|", "s>", "/s>", "[", "INST]", "/INST]", "<SYS>>", "</SYS>>", "<|end|>\n", "é", " ", "$1"]
    df = spark.createDataFrame([("".join(r.choices(bits, k=r.randint(0, 9))),) for _ in range(3000)], "t string")
    got = df.select("t", chat.escape("t").alias("e"), chat.unescape(chat.escape("t")).alias("u"), chat.unescape_role(chat.escape_role("t")).alias("r")).collect()
    assert all(x["t"] == x["u"] == x["r"] for x in got)
    assert not any(mark in x["e"] for x in got for mark in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_chat_cycle(spark):
    nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 1)], "tree long, node long, parent long")
    with pytest.raises(ValueError):
        chat.paths(nodes, rounds=5)


def test_chat_cycle_below_a_leaf_with_the_default_rounds(spark):
    """A leaf whose chain enters a cycle, and a tree that is nothing but a cycle."""
    for extra in ([(1, 3, 1)], []):
        nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (2, 1, None), (2, 2, 1), *extra], "tree long, node long, parent long")
        with pytest.raises(ValueError):
            chat.paths(nodes)


def test_long_chain(spark):
    n = 300
    nodes = spark.createDataFrame([(1, k, k - 1, "user", str(k), 0.0) for k in range(n)], "tree long, node long, parent long, role string, text string, score double")
    row = chat.digest(chat.format_trees(nodes)).first()
    assert row["n_turns"] == n and row["turns_sha256"] == hashlib.sha256("".join(f"user\n{k}\n" for k in range(n)).encode()).hexdigest()


# ---- 8

def slow_groups(rows, k, percent):
    sets = {}
    for name, text in rows:
        sets.setdefault(name, set()).update({frozenset(slow_set(text, k))})
    up = {x: x for x in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = root(a), root(b)
                        up[max(p, q)] = min(p, q)
    return {x: root(x) for x in names}


def test_near_duplicates_of_chained_copies(spark, monkeypatch):
    """Families whose members differ more and more: pivots do not reach all, blocks settle the rest."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 6)
    r = random.Random(8)
    rows, name = [], 100
    for _ in range(5):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(60)]
        for _ in range(16):
            rows.append((name, " ".join(words)))
            name += r.randint(1, 9)
            for _ in range(r.choice([0, 1, 2, 4])):
                words[r.randrange(60)] = f"w{r.randint(0, 10**6)}"
    r.shuffle(rows)
    got = {x["doc_id"]: x["component_id"] for x in neardup.group(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()}
    want = slow_groups(rows, 2, 80)
    assert got == want and len(set(want.values())) > 5


def test_near_duplicates_odd(spark, odd, empty):
    got = neardup.group(odd).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) and by[8]["component_id"] == 1 and not by[8]["kept"] and by[1]["kept"]
    assert [by[k]["n_shingles"] for k in (2, 3, 4, 5)] == [0, 0, 0, 1] and all(by[k]["component_id"] == k for k in (2, 3, 4, 5))
    kept = neardup.filter_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 8").count() == 0 and kept.count() == len(ODD) - 1
    assert neardup.group(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b c"), (3, "a b c")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.group(nameless).collect()) == [(0, 0, True), (3, 3, True)]


def test_near_duplicates_of_repeated_ids(spark):
    """Rows of one doc_id are one node in groups; no text is lost when duplicates are left out."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    near_c = c.replace("c39", "other")
    rows = [(3, a), (5, a), (5, b), (9, b), (5, c), (11, near_c), (5, b), (7, ""), (7, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_d1", F.lit(0)).drop("_d1")
    got = {(r["doc_id"], r["component_id"]) for r in neardup.group(df).collect() if r["n_shingles"]}
    assert got == {(k, 3) for k in (3, 5, 7, 9, 11)} and neardup.group(df).count() == len(rows)
    assert {k: v for k, v in slow_groups(rows, 5, 80).items()} == {k: 3 for k in (3, 5, 7, 9, 11)}
    kept = sorted((r["doc_id"], r["text"]) for r in neardup.filter_duplicates(df).collect())
    assert kept == sorted([(3, a), (5, b), (5, b), (5, c), (7, "")])


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "u long, v long").repartition(7)
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}
    assert components(edges.limit(0)).count() == 0


# ---- 9

def test_top_k_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (6, [1.0, 0.0]), (100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 6, 65536), (0, 3, 50, 32768), (50, 1, 0, 32768), (50, 2, 1, 32768), (50, 3, 6, 32768)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_over_many_ranges(spark, docs, monkeypatch):
    want = sorted(map(tuple, topk.top_k(table(spark, "embeddings"), F.col("vec_id") % 50 == 0).collect()))
    monkeypatch.setattr(topk, "RANGE", 20)
    monkeypatch.setattr(topk, "QUERIES", 3)
    assert sorted(map(tuple, topk.top_k(table(spark, "embeddings"), F.col("vec_id") % 50 == 0).collect())) == want


def test_top_k_of_repeated_queries(spark):
    """Equal query rows are one query; a query id with another vector is a query of its own."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (2, [0.5, 1.0]), (2, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=2).collect())
    assert got == sorted([(0, 1, 1, 65536), (0, 2, 2, 32768), (0, 1, 2, 65536), (0, 2, 2, 65536)])


def test_top_k_over_cells_and_panels(spark, monkeypatch):
    """Clustered vectors: whole cells are passed by, and no answer is lost."""
    import numpy as np

    r = np.random.default_rng(2)
    centres = r.normal(size=(8, 16)) * 3
    x = np.concatenate([c + r.normal(size=(60, 16)) * 0.2 for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    for name, value in (("RANGE", 40), ("QUERIES", 3), ("PANEL", 2), ("BLOCK", 8)):
        monkeypatch.setattr(topk, name, value)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=4).collect())
    m = np.floor(256 * x).astype(np.int64)
    want = []
    for i in range(0, len(x), 20):
        best = sorted((-int(m[i] @ m[j]), j) for j in range(len(x)) if j != i)[:4]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


# ---- 10

def check_tokens(df, got):
    encoder, start = Encoder.of(default_path("byte_bpe_50k.json")), 0
    rows = sorted(got.collect(), key=lambda r: r["start"])
    want = sorted(df.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in want]
    pool = {}
    for w in want:
        ids = [*encoder.model.encode(w["text"] or "", add_special_tokens=False).ids, 0]
        pool.setdefault(w["doc_id"], []).append((len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    for r in rows:
        assert r["start"] == start
        pool[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        start += r["n_tokens"]


def test_token_files(spark, docs):
    check_tokens(docs, queries.op10_token_files(spark, D))


def test_token_files_odd(odd, empty):
    check_tokens(odd, tokenfile.roundtrip(odd))
    assert tokenfile.roundtrip(empty).count() == 0


def test_token_files_of_repeated_and_missing_ids(spark):
    """One id on most rows, rows without id, several small files: everything comes back in order."""
    rows = [(7, f"text {k} of a repeated id " * (k % 5)) for k in range(300)] + [(None, f"no id {k}") for k in range(40)] + [(k, "x") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tokenfile.roundtrip(df, file_bytes=4000).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    encoder = Encoder.of(default_path("byte_bpe_50k.json")).model
    want = sorted((k is not None, k or 0, len(encoder.encode(t, add_special_tokens=False).ids) + 1) for k, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_a_path_without_scheme_is_on_the_default_file_system(spark):
    from moiety.llm.cluster import qualified

    assert qualified(spark, "/ckpt/x") == "file:///ckpt/x" and qualified(spark, "file:/a b/x") == "file:///a b/x"


# ---- pipeline

def test_pipeline(spark, docs, tmp_path):
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        stage(spark, kept, D).write.parquet(f"{tmp_path}/{k}")
        kept = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert after <= before
        if name != "packing":
            assert sorted(kept.columns) == sorted(docs.columns)
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tmp_path}/{k - 1}").collect()]
            assert after == set(slow_groups(rows, 5, 80).values())
        if name == "decontamination":
            assert not decontaminate.find(kept, table(spark, "benchmark")).filter("n_hit > 0").count()
            assert len(before - after) <= 0.05 * len(before)
        if name == "packing":
            assert after == before
            check_packing(spark.read.parquet(f"{tmp_path}/{k - 1}"), kept)


def test_pipeline_in_one(spark, docs):
    got = corpus_pipeline.run(spark, D)
    assert got.count() > 0 and "sequence_id" in got.columns

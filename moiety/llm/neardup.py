"""Near-duplicate groups: SuperMinHash, banding, verification on full sets, union-find.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a digest of the set, and
   a SuperMinHash signature. Registers are filled in rounds: in round j every element draws a
   fraction r and a place by one more step of its own random permutation, and the register keeps
   the least j + r. Once all registers of a text are filled, later rounds cannot change them, so
   it stops (most texts need two or three rounds).
2. Texts of equal sets are one class, stood for by its least doc_id.
3. Bands of the signatures make buckets of classes. A class is first compared with the one pivot
   (the least of a bucket) that it meets in most buckets; found links are joined.
4. Buckets whose members are then in different components are settled exactly, each by itself
   (of buckets with equal members one stays): small ones share tasks (without members that meet no
   set of another component near enough in size), a large one's members go in
   blocks of bounded size to tasks, and a task compares every two of different components. Pairs
   of blocks of one component are left out, as no link there can change a component.
5. Links of 3 and 4 are joined by union-find.

At the bands used (32 of 4) a pair of similarity 0.8 shares no bucket with probability 5e-8.

Defined results: texts without words (null, empty, blank) have an empty set and link with
nothing; a text of fewer words than a shingle has one shingle, its whole sequence; in ``group``
rows of one doc_id are one node, whatever their texts; ``filter_duplicates`` goes by texts, so of
a doc_id's rows only those whose text another row stands for are left out; a row without doc_id
keeps component null and is kept; doc_ids lie below 2^62; an empty table gives an empty result.
Other columns stay as they are in ``filter_duplicates`` and are not read else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moiety.llm import textkernel as tk
from moiety.llm.cluster import cut, small_batches
from moiety.llm.components import UnionFind, components

REGISTERS, ROWS = 128, 4
BLOCK_DOCS = 256
_U = np.uint64
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it; how many come before each text."""
    starts, ends, before = tk.spans(data, offsets, tk.NONSPACE)
    h = tk.hash_spans(data, starts, ends)
    n = np.diff(before)
    size = np.minimum(n, words)
    count = np.where(n > 0, n - size + 1, 0)
    first = np.concatenate(([0], np.cumsum(count)))
    total = int(first[-1])
    at = np.arange(total) + np.repeat(before[:-1] - first[:-1], count)
    g = np.zeros(total, np.uint64)
    for k in range(words):
        ok = np.repeat(size > k, count)
        if ok.all():
            g = tk.mix(g * _U(0x9E3779B97F4A7C15) + h[at + k] + _U(k + 1))
        else:
            g[ok] = tk.mix(g[ok] * _U(0x9E3779B97F4A7C15) + h[at[ok] + k] + _U(k + 1))
    row = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((g, row)) if total else np.zeros(0, np.int64)
    g, row = g[order], row[order]
    new = np.ones(total, bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(n) + 1))


def super_minhash(g: np.ndarray, before: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures (texts x m, uint64: round in the top byte, then 56 bits of the fraction)."""
    n = len(before) - 1
    count = np.diff(before)
    out = np.full((n, m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(n), count)
    perm = None
    for j in range(m):
        if not len(g):
            break
        r = tk.mix(g + _U((j + 1) * 0xD1B54A32D192ED03 & (2**64 - 1)))
        k = j + (((r & _U(0xFFFFFF)) * _U(m - j)) >> _U(24)).astype(np.int64)
        if j == 0:
            place, first = k, k
        else:
            if perm is None:  # the permutation after round 0: places 0 and ``first`` are exchanged
                perm = np.broadcast_to(np.arange(m, dtype=np.uint8), (len(g), m)).copy()
                perm[np.arange(len(g)), first] = 0
            at = np.arange(len(g))
            place = perm[at, k].astype(np.int64)
            perm[at, k] = perm[at, j]
        value = (_U(j) << _U(56)) | (tk.mix(r) >> _U(8))
        np.minimum.at(flat, row * m + place, value)
        open_ = (out.max(axis=1) >> _U(56)) > _U(j)
        live = open_[row]
        if not live.all():
            g, row = g[live], row[live]
            first = first[live] if perm is None else first
            perm = perm[live] if perm is not None else None
    return out


def _digests(g: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(before)
    full = np.flatnonzero(n)
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        d = np.zeros(len(n), np.uint64)
        if len(full):
            d[full] = np.add.reduceat(tk.mix(g ^ _U(salt)), before[full])
        out.append(tk.mix(d + n.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, words: int, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (d1, d2), one key per band."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(1))
            for i, j in tk.chunks(offsets, tk.BLOCK):
                g, before = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                s = super_minhash(g, before, registers)
                key = np.zeros((len(s), registers // rows), np.uint64)
                for k in range(rows):
                    key = tk.mix(key + s[:, k::rows] + _U(k))
                key = tk.mix(key + np.arange(registers // rows, dtype=np.uint64)).view(np.int64)
                d1, d2 = _digests(g, before)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * (registers // rows)), pa.array(key.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].cast(pa.int64()), pa.array(np.diff(before)), pa.array(d1), pa.array(d2), bands], schema=_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _similar(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def _check_pairs(words: int, percent: int):
    """(u, v, text_u, text_v) to the pairs that are linked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for col in (2, 3):
                data, offsets = tk.buffers(batch.column(col))
                got.append(shingle_sets(data, offsets, words))
            (ga, ba), (gb, bb) = got
            keep = []
            for r in range(batch.num_rows):
                a, b = ga[ba[r] : ba[r + 1]], gb[bb[r] : bb[r + 1]]
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)) or not len(a):
                    continue
                if _similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent):
                    keep.append(r)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return scan


def links_in_block(names: list[int], group: list[int], g: np.ndarray, before: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different groups, enough of them to join all that are tied."""
    n = len(names)
    size = np.diff(before)
    sets = UnionFind()
    rep: dict[int, int] = {}
    for i, c in enumerate(group):
        sets.union(i, rep.setdefault(c, i))
    doc = np.repeat(np.arange(n), size)
    order = np.argsort(g, kind="stable")
    gs, ds = g[order], doc[order]
    start = np.flatnonzero(np.concatenate(([True], gs[1:] != gs[:-1]))) if len(gs) else np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(gs)))
    group_of = np.empty(len(g), np.int64)
    group_of[order] = np.repeat(np.arange(len(start)), length)
    out = []
    for i in range(n):
        if not size[i]:
            continue
        own = group_of[before[i] : before[i + 1]]
        ln = length[own]
        at = np.arange(int(ln.sum())) + np.repeat(start[own] - np.concatenate(([0], np.cumsum(ln)[:-1])), ln)
        shared = np.bincount(ds[at], minlength=n)
        for j in np.flatnonzero(_similar(shared, size[i], size, percent) & (shared > 0)).tolist():
            if j < i and sets.union(i, j):
                out.append((names[i], names[j]))
    return out


def _check_blocks(words: int, percent: int):
    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        data, offsets = tk.buffers(table.column("text"))
        g, before = shingle_sets(data, offsets, words)
        found = links_in_block(table.column("doc_id").to_pylist(), table.column("component").to_pylist(), g, before, percent)
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    return task


def _classes(docs: DataFrame, words: int, percent: int, registers: int, rows: int, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, n_shingles, d1, d2), the classes of equal sets (d1, d2, rep, node, component), and repeated ids.

    A class's node is its least doc_id; where several classes have the same one, all but the first
    have a node beyond all doc_ids. ``by_id``: classes that share a doc_id are linked too.
    """
    small_batches(docs.sparkSession)
    sig = cut(signatures(docs, words, registers, rows))
    real = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"))
    twice = classes.groupBy("rep").agg(F.min(F.struct("d1", "d2")).alias("head"), F.count("*").alias("n")).filter("n > 1").select("rep", "head")
    beyond = F.lit(2**63 - 1) - F.xxhash64("d1", "d2").bitwiseAND(F.lit(2**61 - 1))
    classes = classes.join(twice, "rep", "left")
    classes = cut(classes.select("d1", "d2", "rep", F.col("size").alias("n"), F.when(F.col("head").isNull() | (F.struct("d1", "d2") == F.col("head")), F.col("rep")).otherwise(beyond).alias("node")))
    reps = real.join(classes, ["d1", "d2"]).filter("doc_id = rep").select("d1", "d2", "node", "bands").dropDuplicates(["d1", "d2"])
    band = reps.select("node", F.posexplode("bands").alias("band", "key"))
    pivots = band.groupBy("band", "key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").drop("n")
    bucket = cut(band.join(pivots, ["band", "key"]).select("node", "key", "pivot"))

    repeated = _repeated(sig)
    texts = _texts(docs, classes, repeated, words)
    pairs = bucket.filter("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("node").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("x")).select(F.col("node").alias("u"), (-F.col("x.p")).alias("v"))
    a, b = texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), texts.select(F.col("node").alias("v"), F.col("text").alias("text_v"))
    links = cut(pairs.join(a, "u").join(b, "v").select("u", "v", "text_u", "text_v").mapInArrow(_check_pairs(words, percent), "u long, v long"))
    if by_id and not repeated.isEmpty():
        own = real.join(classes, ["d1", "d2"]).groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).filter("u <> w").select("doc_id", "u")
        links = links.unionByName(real.join(classes, ["d1", "d2"]).join(own, "doc_id").select("u", F.col("node").alias("v")).filter("u <> v").distinct())
    comp = cut(components(links))

    member = bucket.join(comp, "node", "left").select("node", "key", F.coalesce("component", "node").alias("component"))
    mixed = member.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum(F.xxhash64("node").bitwiseAND(F.lit(2**40 - 1))).alias("s"), F.expr("bit_xor(xxhash64(node, 1L))").alias("x"), F.min("node").alias("head")).filter("lo < hi")
    # buckets of equal members (near copies meet in many) are settled once
    mixed = mixed.groupBy("n", "s", "x", "head").agg(F.min("key").alias("key")).select("key", "head", F.col("n").alias("members"))
    rest = member.join(mixed, "key").join(classes.select("node", "n"), "node").select("node", "component", "key", "head", "members", "n")
    # in a small bucket, only those meet that another component's set of a size near enough may be linked with
    near = Window.partitionBy("key").orderBy("size").rangeBetween(-_reach(percent), _reach(percent))
    few = rest.filter(F.col("members") <= BLOCK_DOCS // 2).withColumn("size", F.floor(F.ln("n") * 1e6).cast("long")).withColumn("lo", F.min("component").over(near)).withColumn("hi", F.max("component").over(near))
    rest = cut(few.filter("lo < hi").select(rest.columns).unionByName(rest.filter(F.col("members") > BLOCK_DOCS // 2)))
    if not rest.isEmpty():
        comp = components(links.unionByName(_settle(rest, texts, words, percent)))
    comp = cut(comp)
    return sig, classes.join(comp, "node", "left").select("d1", "d2", "rep", "node", F.coalesce("component", "node").alias("component")), repeated


def _reach(percent: int) -> int:
    """How far apart the logarithms of two linked sets' sizes can be, in millionths; a little more, for rounding."""
    return int(math.log(100 / percent) * 1e6) + 3


def _repeated(sig: DataFrame) -> DataFrame:
    """doc_ids on more than one row: as a rule none."""
    return cut(sig.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))


def _digest_rows(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with the digest of each row's set, as _d1 and _d2."""
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column(at))
            for i, j in tk.chunks(offsets, tk.BLOCK):
                d1, d2 = _digests(*shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(d1), pa.array(d2)], names=[*batch.schema.names, "_d1", "_d2"])

    from pyspark.sql.types import LongType, StructField, StructType

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField("_d1", LongType()), StructField("_d2", LongType())]))


def _texts(docs: DataFrame, classes: DataFrame, repeated: DataFrame, words: int) -> DataFrame:
    """(node, text): one text of each class, that of its least doc_id; there may be texts of no node."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if repeated.isEmpty():  # then a node is its class's doc_id, and no join is due
        return texts.withColumnRenamed("doc_id", "node")
    named = classes.select(F.col("rep").alias("doc_id"), "node", F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
    single = texts.join(repeated, "doc_id", "left_anti").join(named, "doc_id").select("node", "text")
    own = _digest_rows(texts.join(repeated, "doc_id", "left_semi"), words)
    return single.unionByName(own.join(named, ["doc_id", "_d1", "_d2"]).select("node", "text").dropDuplicates(["node"]))


def group(docs: DataFrame, words: int = 5, percent: int = 80, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sig, classes, _ = _classes(docs, words, percent, registers, rows, by_id=True)
    out = sig.join(classes.select("d1", "d2", F.col("component").alias("found")), ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _settle(rest: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Exact links between components within each of the buckets of ``rest`` (node, component, key, head, members)."""
    few = F.col("members") <= BLOCK_DOCS // 2
    shared = rest.filter(few).agg(F.count("*")).first()[0]
    tasks = max(1, -(-shared // BLOCK_DOCS))
    # small buckets: some of them to a task, whole; those of one least member together, so that texts travel seldom
    alone = rest.filter(few).select(F.pmod(F.xxhash64("head"), F.lit(tasks)).alias("task"), "node", "component").distinct()
    # large ones: blocks of one component, and blocks of small components; pairs of blocks are tasks
    m = rest.filter(~few).select("key", "node", "component")
    sizes = m.groupBy("key", "component").agg(F.count("*").alias("n"))
    small = sizes.filter(F.col("n") < BLOCK_DOCS // 2).groupBy("key").agg(F.sum("n").alias("small"))
    pure = F.col("n") >= BLOCK_DOCS // 2
    n_blocks = F.when(pure, F.ceil(F.col("n") / BLOCK_DOCS)).otherwise(F.ceil(F.col("small") / BLOCK_DOCS))
    m = m.join(sizes.join(small, "key", "left"), ["key", "component"])
    block = F.when(pure, F.xxhash64("key", "component", F.pmod(F.xxhash64("node"), n_blocks))).otherwise(F.xxhash64("key", F.lit("small"), F.pmod(F.xxhash64("component"), n_blocks)))
    m = cut(m.select("node", "component", "key", block.alias("block"), F.when(pure, F.col("component")).alias("own")))
    blocks = m.groupBy("key", "block").agg(F.first("own").alias("own"))
    x, y = blocks.select("key", F.col("block").alias("i"), F.col("own").alias("oi")), blocks.select("key", F.col("block").alias("j"), F.col("own").alias("oj"))
    both = x.join(y, "key").filter("i <= j AND NOT (oi IS NOT NULL AND oj IS NOT NULL AND oi = oj)")
    # a block alone is compared within itself; where it meets others it is not compared again on its own
    met = both.filter("i < j").select(F.explode(F.array("i", "j")).alias("b")).distinct()
    lone = both.filter("i = j").join(met, F.col("i") == F.col("b"), "left_anti")
    pairs = both.filter("i < j").unionByName(lone).select("i", "j", F.xxhash64("i", "j").alias("task"))
    side = pairs.select("task", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    large = side.join(m.select("block", "node", "component"), "block").select("task", "node", "component")
    rows = alone.unionByName(large).join(texts, "node").select("task", F.col("node").alias("doc_id"), "component", "text")
    return cut(rows.groupBy("task").applyInArrow(_check_blocks(words, percent), "u long, v long"))


def filter_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-equal texts: the one of least doc_id. All columns stay."""
    sig, classes, repeated = _classes(docs, words, percent, REGISTERS, ROWS, by_id=False)
    rows = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(classes, ["d1", "d2"])
    gone = rows.filter("node <> component OR doc_id <> rep").select(F.col("doc_id").alias("_gone"), F.col("d1").alias("_e1"), F.col("d2").alias("_e2")).distinct()
    own = F.col("doc_id").cast("long")
    if repeated.isEmpty():
        return docs.join(gone.select("_gone"), own == F.col("_gone"), "left_anti")
    several = repeated.select(F.col("doc_id").alias("_several"))
    single = docs.join(gone.select("_gone").unionByName(several.select(F.col("_several").alias("_gone"))).distinct(), own == F.col("_gone"), "left_anti")
    rest = _digest_rows(docs.join(several, own == F.col("_several"), "left_semi"), words)
    rest = rest.join(gone, (own == F.col("_gone")) & (F.col("_d1") == F.col("_e1")) & (F.col("_d2") == F.col("_e2")), "left_anti").drop("_d1", "_d2")
    return single.unionByName(rest)

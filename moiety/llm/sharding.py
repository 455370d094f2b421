"""K-d tree sharding by bytes, with DataFrame operations only.

Rows of equal text form a group, which stays in one shard; a group larger than a shard's target
is salted into parts of about a sixteenth of it. The groups' metadata (least doc_id, bytes a row,
source, language) are the dimensions, each scaled to 0..2^30 over the table. From the root on,
every node takes the dimension in which it is widest and is split at the weighted median (bytes):
at the place where the left side has its share of the node's shards. Medians come from histograms
of a 50-bit key (dimension, then a hash that breaks ties), refined level by level for all nodes at
once; the driver sees a fixed number of bins per node. Splitting ends at one shard a leaf, so
leaves hold the target bytes.

Law: ``bytes``. Slots count the rows of a shard from 0: rows are put in hash buckets of bounded
size, buckets are ordered by number, and rows within one by doc_id.

Defined results: a null text has size 1 and the checksum of the empty text, and is one group with
empty texts; null metadata are the least value; repeated rows get slots of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moiety.llm.cluster import column_or_null, cut

SCALE, TIE_BITS, BIN_BITS, ROUNDS = 30, 20, 10, 5
BUCKET_ROWS = 50_000


def _hashed(c: Column) -> Column:
    """A place for a category: its first bytes' order does not matter, only that equal ones are together."""
    return F.coalesce(F.pmod(F.xxhash64(c), F.lit(1 << 16)), F.lit(0))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, group key, and metadata of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit("second"), text).alias("g2"),
        _hashed(column_or_null(docs, "source", "string").cast("string")).alias("m_source"),
        _hashed(column_or_null(docs, "lang", "string").cast("string")).alias("m_lang"),
    )


def _tree(groups: DataFrame, shards: int) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Splits (node, dimension, key, left, right), and the shard of each leaf node.

    ``groups`` has the scaled dimensions d0.. and tie (below 2^TIE_BITS), and w.
    """
    dims = [c for c in groups.columns if c.startswith("d")]
    splits: list[tuple[int, int, int, int, int]] = []
    nodes, leaves, count = {0: shards}, {}, 1
    frame = groups.withColumn("node", F.lit(0))
    while nodes:
        for n in [n for n, s in nodes.items() if s == 1]:
            leaves[n] = len(leaves)
            del nodes[n]
        if not nodes:
            break
        inside = frame.filter(F.col("node").isin(list(nodes)))
        ends = inside.groupBy("node").agg(F.sum("w").alias("w"), *[F.max(d).alias(f"hi_{d}") for d in dims], *[F.min(d).alias(f"lo_{d}") for d in dims])
        widest, goal, prefix, below = {}, {}, {}, {}
        for r in ends.collect():  # one row a node
            d = max(range(len(dims)), key=lambda k: (r[f"hi_{dims[k]}"] - r[f"lo_{dims[k]}"], -k))
            s = nodes[r["node"]]
            widest[r["node"]], goal[r["node"]], prefix[r["node"]], below[r["node"]] = d, r["w"] * (s // 2) / s, 0, 0
        key = F.lit(None).cast("long")
        for n, d in widest.items():
            key = F.when(F.col("node") == n, F.col(dims[d]) * (1 << TIE_BITS) + F.col("tie")).otherwise(key)
        keyed = inside.select("node", key.alias("key"), "w")
        settled: dict[int, int] = {}
        for k in range(ROUNDS):
            shift = (ROUNDS - 1 - k) * BIN_BITS
            want = [n for n in prefix if n not in settled]
            if not want:
                break
            cond = F.lit(False)
            for n in want:
                cond = cond | ((F.col("node") == n) & (F.shiftright("key", shift + BIN_BITS) == F.lit(prefix[n])))
            bins = keyed.filter(cond).groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()
            for n in want:  # at most 2^BIN_BITS bins a node
                own = sorted((r["bin"], r["w"], r["n"]) for r in bins if r["node"] == n)
                acc = below[n]
                for b, w, rows in own:
                    if acc + w >= goal[n]:
                        break
                    acc += w
                below[n], prefix[n] = acc, b
                if rows == 1 or k == ROUNDS - 1:  # one group: it goes to the side that is nearer to the goal
                    after = goal[n] - acc > acc + w - goal[n]
                    settled[n] = (b + after) << shift
        nxt, level = F.col("node"), list(nodes)
        for n, cutpoint in settled.items():
            left, right, s = count, count + 1, nodes[n]
            count += 2
            splits.append((n, widest[n], cutpoint, left, right))
            value = F.col(dims[widest[n]]) * (1 << TIE_BITS) + F.col("tie")
            nxt = F.when(F.col("node") == n, F.when(value < cutpoint, left).otherwise(right)).otherwise(nxt)
            nodes[left], nodes[right] = s // 2, s - s // 2
        for n in level:
            if n not in settled:  # no group lies here: its shards stay empty
                leaves[n] = len(leaves)
            del nodes[n]
        frame = frame.withColumn("node", nxt)
    return splits, leaves


def _leaf(splits: list[tuple[int, int, int, int, int]], leaves: dict[int, int], dims: list[str]) -> Column:
    """The shard of a row, as nested conditions: one comparison a level."""
    at = {s[0]: s for s in splits}

    def walk(n: int) -> Column:
        if n not in at:
            return F.lit(leaves[n])
        _, d, cutpoint, left, right = at[n]
        return F.when(F.col(dims[d]) * (1 << TIE_BITS) + F.col("tie") < F.lit(cutpoint), walk(left)).otherwise(walk(right))

    return walk(0)


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is bytes)."""
    rows = cut(described(docs))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    target = max(1, total // shards)
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("doc_id").alias("m_id"), F.min("m_source").alias("m_source"), F.min("m_lang").alias("m_lang"))
    parts = F.when(F.col("w") > target, F.least(F.ceil(F.col("w") * 16 / target), F.col("n"))).otherwise(F.lit(1)).cast("int")
    groups = groups.withColumn("parts", parts)
    dims = ["m_id", "m_size", "m_source", "m_lang"]
    groups = groups.withColumn("m_size", F.floor(F.log2(F.col("w") / F.col("n") + 1) * 65536).cast("long"))
    # a large group's parts have equal shares of its bytes here; its rows choose a part by hash
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("w", (F.col("w") / F.col("parts")).cast("long"))
    groups = cut(groups)
    ends = groups.agg(*[F.min(d).alias(f"lo_{d}") for d in dims], *[F.max(d).alias(f"hi_{d}") for d in dims]).first()

    def scaled(d: str) -> Column:
        lo, hi = ends[f"lo_{d}"], ends[f"hi_{d}"]
        if lo is None or hi is None or hi == lo:
            return F.lit(0).cast("long")
        return F.coalesce(F.floor((F.col(d) - F.lit(lo)).cast("double") / float(hi - lo) * ((1 << SCALE) - 1)).cast("long"), F.lit(0))

    tie = F.pmod(F.xxhash64("g1", "g2", "salt"), F.lit(1 << TIE_BITS)).alias("tie")
    groups = cut(groups.select("g1", "g2", "salt", "parts", *[scaled(d).alias(f"d{i}") for i, d in enumerate(dims)], tie, "w"))
    names = [f"d{i}" for i in range(len(dims))]
    splits, leaves = _tree(groups.select(*names, "tie", "w"), shards)
    placed = groups.select("g1", "g2", "salt", "parts", _leaf(splits, leaves, names).cast("int").alias("shard"))
    few = placed.filter("parts = 1").select("g1", "g2", "shard")
    many = placed.filter("parts > 1")
    # the few groups larger than a shard: fewer than there are shards, so one small array a row of them
    big = many.groupBy("g1", "g2").agg(F.array_sort(F.collect_list(F.struct("salt", "shard"))).alias("at"))
    own = F.element_at("at", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.size("at")) + 1).cast("int"))["shard"]
    out = rows.join(few, ["g1", "g2"], "left").join(F.broadcast(big), ["g1", "g2"], "left").select("doc_id", "size", "text_crc32", F.coalesce("shard", own).alias("shard"))
    buckets = max(1, -(-n // (shards * BUCKET_ROWS)))
    out = cut(out.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int")))
    before = out.groupBy("shard", "bucket").count()
    w = Window.partitionBy("shard").orderBy("bucket")
    before = before.select("shard", "bucket", (F.sum("count").over(w) - F.col("count")).alias("base"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    out = out.withColumn("n", F.row_number().over(within)).join(before, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are quantised to integers. Candidates lie in cells of about ``RANGE`` vectors that are close
together (by the signs of fixed random projections), and each cell is cut into blocks of ``BLOCK``
vectors. Terms are the components, each with a positive and a negative side: a block keeps the
maximum and minimum of each term, and a query's bound for a block is the sum of the larger of the
two products per term. The same bound holds for a whole cell.

1. Every query is answered within the cell it lies in. That gives a floor under its k-th score.
2. Bounds of whole cells are compared with the floors, in panels of ``PANEL`` cells; a query goes
   on to those cells only whose bound reaches its floor.
3. In a cell, each query takes its blocks in the order of their bounds, in rounds of doubling
   size, scores them through the block's forward index (its vectors), and stops once the next
   bound is below the k-th score so far (an equal bound is scored, as ties go to the smaller id).

The k best of each cell are merged per query.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
shorter vectors count as if filled with zeros; a query with fewer candidates gets all of them;
rows that repeat a vec_id are separate candidates, but no row answers a query of its own id;
query rows that repeat both id and vector are one query, those that repeat the id with another
vector are queries of their own, each with k answers; an empty table gives an empty result.
Scores must fit a signed 64-bit integer. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moiety.llm.cluster import cut, small_batches

RANGE, BLOCK, QUERIES, PANEL = 16384, 32, 8192, 256
_SAFE = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each usable vector, as longs."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("e")).filter("vec_id IS NOT NULL AND e IS NOT NULL AND size(e) > 0")
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return good.filter(~bad).select("vec_id", F.transform("e", lambda v: F.floor(v * scale).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros."""
    x = column.combine_chunks()
    x = x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x
    n = len(x)
    if not n:
        return np.zeros((0, width))
    size = np.diff(x.offsets.to_numpy())
    flat = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == width).all():
        return flat.reshape(n, width)
    out = np.zeros((n, width))
    own = np.repeat(np.arange(n), size)
    out[own, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _width(*columns: pa.ChunkedArray) -> int:
    return max((pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns), default=0)


def _under(x: np.ndarray) -> np.ndarray:
    """Doubles that are not above these integers."""
    y = np.asarray(x).astype(np.float64)
    return np.where(np.abs(y) < _SAFE, y, np.nextafter(y, -np.inf))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products: exact in doubles where all sums stay under 2^53, else in Python integers."""
    if a.size == 0 or b.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < _SAFE:
        return a @ b.T
    return (a.astype(np.int64).astype(object)) @ (b.astype(np.int64).astype(object).T)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return _product(np.maximum(q, 0), high) + _product(np.minimum(q, 0), low)


def search_range(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of one cell for each query.

    Candidates that score below a query's ``floor`` may be left out.
    """
    at, ids, scores = search_cell(qid, q, cid, c, k, block, floor)
    return [(int(qid[i]), int(x), int(y)) for i, x, y in zip(at, ids, scores)]


def search_cell(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``search_range``, as arrays: the query's place, the candidate, the score."""
    n, nq = len(cid), len(qid)
    found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    if not n or not nq:
        return found
    order = _close_together(c)
    c, cid = c[order], cid[order]
    first = np.arange(0, n, block)
    bound = _bounds(q, np.maximum.reduceat(c, first, axis=0), np.minimum.reduceat(c, first, axis=0))
    visit = np.argsort(-bound, axis=1, kind="stable")
    kth = np.full(nq, -np.inf) if floor is None else np.asarray(floor, np.float64).copy()
    done, step, nb = 0, 4, len(first)
    live = np.arange(nq)
    while done < nb and len(live):
        take = visit[live, done : done + step]
        who = np.repeat(live, take.shape[1])
        which = take.reshape(-1)
        good = bound[who, which] >= kth[who]
        who, which = who[good], which[good]
        order = np.argsort(which, kind="stable")
        who, which = who[order], which[order]
        start = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1]))) if len(which) else np.zeros(0, np.int64)
        hits = [found]
        for a, b in zip(start.tolist(), [*start[1:].tolist(), len(which)]):
            lo = int(first[which[a]])
            own, own_ids = who[a:b], cid[lo : lo + block]
            x = _product(q[own], c[lo : lo + block])
            r, j = np.nonzero((x >= kth[own][:, None]) & (own_ids[None, :] != qid[own][:, None]))
            hits.append((own[r], own_ids[j], x[r, j]))
        at, ids, scores = (np.concatenate(x) for x in zip(*hits))
        best = np.lexsort((ids, -scores, at))
        at, ids, scores = at[best], ids[best], scores[best]
        begin = np.searchsorted(at, np.arange(nq))
        keep = np.arange(len(at)) - begin[at] < k
        found = at, ids, scores = at[keep], ids[keep], scores[keep]
        full = np.bincount(at, minlength=nq) >= k
        last = np.searchsorted(at, np.arange(nq), "right") - 1
        kth[full] = np.maximum(kth[full], _under(scores[last[full]]))
        done += step
        step *= 2
        if done < nb:
            live = live[bound[live, visit[live, done]] >= kth[live]]
    return found


def _close_together(c: np.ndarray) -> np.ndarray:
    """An order in which near vectors follow each other: recursive halving along the widest term."""
    out = np.arange(len(c))
    todo = [(0, len(c))]
    while todo:
        a, b = todo.pop()
        if b - a <= BLOCK:
            continue
        own = c[out[a:b]]
        d = int(np.argmax(own.var(axis=0)))
        half = (b - a) // 2 // BLOCK * BLOCK or (b - a) // 2
        out[a:b] = out[a:b][np.argpartition(own[:, d], half)]
        todo += [(a, a + half), (a + half, b)]
    return out


_FOUND = "kind int, query_id long, variant long, vec_id long, score long, part int, sub int, n long, high array<long>, low array<long>"


def _rows(schema: pa.Schema, **columns) -> pa.Table:
    """A table of this schema; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _floor(queries: pa.Table) -> np.ndarray:
    """Floors as doubles that are not above them; minus infinity where there is none."""
    x = queries.column("floor")
    return np.where(x.is_null().to_numpy(), -np.inf, _under(pc.fill_null(x, 0).to_numpy()))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """The k best candidates of each query row: query_id, rank, vec_id, score."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = vectors.sparkSession
    small_batches(spark)
    v = quantised(vectors, scale).withColumn("is_query", is_query)
    # which cell a vector lies in is free: signs of fixed projections keep near ones together, the id spreads the rest
    rng = np.random.default_rng(3)
    signs = [F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in rng.normal(size=64)]), lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b) > 0 for _ in range(4)]
    near = sum((s.cast("int") * (1 << i) for i, s in enumerate(signs)), F.lit(0))
    v = cut(v.withColumn("near", near))
    n = v.count()
    ranges = max(1, -(-n // RANGE))
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    c = v.withColumn("part", F.floor((F.col("near") * (1 << 20) + spread) * ranges / (16 << 20)).cast("int"))
    sizes = c.groupBy("part").count()
    c = c.join(sizes, "part").withColumn("sub", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.ceil(F.col("count") / RANGE)).cast("int"))
    c = cut(c.select("part", "sub", "vec_id", "v", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.xxhash64("v").alias("variant")))
    schema = to_arrow_schema(_parse_datatype_string(_FOUND))

    def home(key: tuple, table: pa.Table) -> pa.Table:
        """Answers within the cell (kind 0) and the cell's size and bounds (kind 1)."""
        part, sub = (x.as_py() for x in key)
        table = table.combine_chunks()
        width = _width(table.column("v"))
        ids, m = table.column("vec_id").to_numpy(), _matrix(table.column("v"), width)
        ask = np.flatnonzero(table.column("is_query").to_numpy(zero_copy_only=False))
        variant = table.column("variant").to_numpy()
        ask = ask[np.unique(np.stack((ids[ask], variant[ask])), axis=1, return_index=True)[1]] if len(ask) else ask
        at, got, scores = search_cell(ids[ask], m[ask], ids, m, k)
        answers = _rows(schema, kind=np.zeros(len(at), np.int32), query_id=ids[ask][at], variant=variant[ask][at], vec_id=got, score=scores.astype(np.int64))
        cell = _rows(schema, kind=[1], part=[part], sub=[sub], n=[len(ids)], high=[m.max(axis=0).astype(np.int64)], low=[m.min(axis=0).astype(np.int64)])
        return pa.concat_tables([answers, cell])

    near_found = cut(c.groupBy("part", "sub").applyInArrow(home, _FOUND))
    found = near_found.filter("kind = 0").select("query_id", "variant", "vec_id", "score")
    cells = near_found.filter("kind = 1").select("part", "sub", "high", "low")
    panels, chunks = max(1, -(-ranges // PANEL)), max(1, -(-n // (50 * QUERIES)))
    floors = found.groupBy("query_id", "variant").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    ask = c.filter("is_query").dropDuplicates(["vec_id", "variant"]).join(floors.withColumnRenamed("query_id", "vec_id"), ["vec_id", "variant"], "left")
    side = ask.select(F.explode(F.sequence(F.lit(0), F.lit(panels - 1))).alias("panel"), F.pmod(F.xxhash64("vec_id", "variant"), F.lit(chunks)).cast("int").alias("chunk"), "part", "sub", "vec_id", "variant", "v", "floor", F.lit(None).cast("array<long>").alias("high"), F.lit(None).cast("array<long>").alias("low"))
    panel = F.pmod(F.xxhash64("part", "sub"), F.lit(panels)).cast("int")
    tiles = cells.select(panel.alias("panel"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "part", "sub", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("long").alias("variant"), F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast("long").alias("floor"), "high", "low")
    ddl = "part int, sub int, vec_id long, variant long, v array<long>, floor long"
    out_schema = to_arrow_schema(_parse_datatype_string(ddl))

    def reach(table: pa.Table) -> pa.Table:
        """Queries of a chunk with each other cell of a panel whose bound reaches the floor."""
        q, t = (table.filter(f(table.column("high"))).combine_chunks() for f in (pc.is_null, pc.is_valid))
        width = _width(q.column("v"), t.column("high"))
        if not q.num_rows or not t.num_rows:
            return out_schema.empty_table()
        bound = _bounds(_matrix(q.column("v"), width), _matrix(t.column("high"), width), _matrix(t.column("low"), width))
        floor = _floor(q)
        mine = [q.column(x).to_numpy()[:, None] == t.column(x).to_numpy()[None, :] for x in ("part", "sub")]
        i, j = np.nonzero((bound >= floor[:, None]) & ~(mine[0] & mine[1]))
        got, cell = q.take(pa.array(i)), t.take(pa.array(j))
        return pa.table([cell.column("part"), cell.column("sub"), *(got.column(x) for x in ("vec_id", "variant", "v", "floor"))], schema=out_schema)

    going = cut(side.unionByName(tiles).groupBy("panel", "chunk").applyInArrow(reach, ddl))
    visits = going.groupBy("part", "sub").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
    right = going.join(visits, ["part", "sub"]).select("part", "sub", F.pmod(F.xxhash64(F.lit(2), "vec_id", "variant"), F.col("groups")).cast("int").alias("chunk"), "vec_id", "variant", "v", "floor", F.lit(True).alias("asks"))
    left = c.join(visits, ["part", "sub"]).select("part", "sub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("chunk"), "vec_id", "variant", "v", F.lit(None).cast("long").alias("floor"), F.lit(False).alias("asks"))
    answer_ddl = "query_id long, variant long, vec_id long, score long"
    answer = to_arrow_schema(_parse_datatype_string(answer_ddl))

    def visit(table: pa.Table) -> pa.Table:
        width = _width(table.column("v"))
        asks = table.column("asks").to_numpy()
        q, own = table.filter(pa.array(asks)).combine_chunks(), table.filter(pa.array(~asks)).combine_chunks()
        ids, variant = q.column("vec_id").to_numpy(), q.column("variant").to_numpy()
        at, got, scores = search_cell(ids, _matrix(q.column("v"), width), own.column("vec_id").to_numpy(), _matrix(own.column("v"), width), k, BLOCK, _floor(q))
        return _rows(answer, query_id=ids[at], variant=variant[at], vec_id=got, score=scores.astype(np.int64))

    far = right.unionByName(left).groupBy("part", "sub", "chunk").applyInArrow(visit, answer_ddl)
    w = Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id")
    return found.unionByName(far).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

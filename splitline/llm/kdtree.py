"""Exact top-k inner-product search with one KD-tree per shard.

1. A bounded sample of ``sample`` vectors gives the top of the tree: median splits
   of the widest dimension down to at most ``leaves`` leaves. Every row goes to its
   leaf, and a leaf of more than ``shard_rows`` rows is dealt to several shards by
   the row's number, so equal vectors are split too.
2. Each shard's tree is built once and stored: median splits of the widest
   dimension, a tight bounding box and the smallest id per node.
3. A query walks a tree best first: the box gives an upper bound of its inner
   product with anything inside, and a node is opened only while that bound can
   still beat the k-th best so far. It is answered in one shard of its own leaf
   first; with that k-th score it then goes only to the leaves whose box can beat
   it, in batches of ``batch`` queries a shard.

Ties go to the smaller id, and equal bounds are opened while they can hold a
smaller id, so results are exact. Arithmetic is integer (float64 is used only
where every sum is below 2**53). Defined cases: rows with a null id, a null
vector or null components take no part; every other row is a candidate, also
those that share an id, and a query leaves out only its own row (rows that share
a query's id are queries of their own, and candidates of each other); queries
meet only vectors of their own length (the empty vector scores 0 with empty
vectors); fewer than k candidates give all of them; extra columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialize

LEAF = 64
_RESULT = "query_row long, query_id long, vec_id long, vec_row long, score long"


def quantize(embedding: Column) -> Column:
    """floor(256 * x) of every component, or null where a component is null or not finite."""
    x = lambda v: v.cast("double")
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) != float("inf")))
    return F.when(finite, F.transform(embedding, lambda v: F.floor(x(v) * 256.0).cast("long")))


def _split(x: np.ndarray, size: int, most: int | None = None):
    """(order, nodes): rows so ordered that every node is a stretch of them; nodes as (start, end, axis, cut, left, right), -1 in leaves.

    The widest dimension of the largest open node is cut at its median until nodes hold ``size`` rows or ``most`` leaves exist.
    """
    order, nodes, todo, leaves = np.arange(len(x)), [[0, len(x), -1, 0, -1, -1]], [(-len(x), 0)], 1
    while todo and (most is None or leaves < most):
        _, at = heapq.heappop(todo)
        start, end = nodes[at][:2]
        part = x[order[start:end]]
        if end - start <= size or not part.shape[1]:
            continue
        spread = part.max(0) - part.min(0)
        axis = int(spread.argmax())
        if most is not None and not spread[axis]:
            continue  # equal vectors: nothing to route by
        middle = (end - start) // 2
        own = np.argpartition(part[:, axis], middle)
        order[start:end] = order[start:end][own]
        cut = int(x[order[start + middle], axis])
        if most is not None:  # rows are routed by value: all rows of the cut's value go right, or left if none is below it
            values = x[order[start:end], axis]
            cut = cut if (values < cut).any() else int(values[values > cut].min())
            own = np.argsort(values >= cut, kind="stable")
            order[start:end] = order[start:end][own]
            middle = int((values < cut).sum())
        nodes[at][2:] = axis, cut, len(nodes), len(nodes) + 1
        for a, b in ((start, start + middle), (start + middle, end)):
            heapq.heappush(todo, (a - b, len(nodes)))
            nodes.append([a, b, -1, 0, -1, -1])
        leaves += 1
    return order, np.array(nodes, dtype=np.int64).reshape(-1, 6)


class Top:
    """The sampled top of the tree over vectors of one length: routes vectors to leaves 0, 1, ..."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes = _split(sample, 1, leaves)[1]
        end = np.flatnonzero(self.nodes[:, 4] < 0)
        self.leaf = np.full(len(self.nodes), -1)
        self.leaf[end] = np.arange(len(end))

    def route(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        while True:
            axis, cut, left, right = self.nodes[at, 2:].T
            inner = np.flatnonzero(left >= 0)
            if not len(inner):
                return self.leaf[at]
            at[inner] = np.where(x[inner, axis[inner]] < cut[inner], left[inner], right[inner])


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.int64) for v in vectors], dtype=np.int64).reshape(len(vectors), -1)


class KDTree:
    """A shard's tree: rows in node order, and per node its stretch, children, box and smallest id."""

    PARTS = ("ids", "rows", "x", "nodes", "low", "high", "first")

    def __init__(self, **parts: np.ndarray):
        self.__dict__.update(parts)

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> KDTree:
        order, nodes = _split(x, LEAF)
        x, ids, rows = x[order], ids[order], rows[order]
        low, high = (np.stack([f(x[a:b], axis=0) for a, b in nodes[:, :2]]) for f in (np.min, np.max))
        return cls(ids=ids, rows=rows, x=x, nodes=nodes, low=low, high=high, first=np.array([ids[a:b].min() for a, b in nodes[:, :2]]))

    def dump(self) -> bytes:
        out = io.BytesIO()
        small = next(t for t in (np.int16, np.int32, np.int64) if not self.x.size or np.iinfo(t).min <= self.x.min() and self.x.max() <= np.iinfo(t).max)
        np.savez(out, **{k: getattr(self, k).astype(small) if k in ("x", "low", "high") else getattr(self, k) for k in self.PARTS})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes) -> KDTree:
        with np.load(io.BytesIO(blob)) as z:
            return cls(**{k: z[k] for k in cls.PARTS})

    def answer(self, queries: list[tuple], k: int) -> list[tuple]:
        """Rows of the result for queries (row, id, vector, kth or None)."""
        qs = _matrix([q[2] for q in queries])
        exact = float(np.abs(self.x.astype(np.int64)).max(initial=0)) * float(np.abs(qs).max(initial=0)) * max(1, qs.shape[1]) < 2.0**53
        kind = np.float64 if exact else np.int64
        x, low, high, qs = (a.astype(kind) for a in (self.x, self.low, self.high, qs))
        bounds = np.maximum(qs, 0) @ high.T + np.minimum(qs, 0) @ low.T
        return [(row, qid, -i, -r, s) for (row, qid, _, kth), q, b in zip(queries, qs, bounds) for s, i, r in self._search(x, row, q, b, k, kth)]

    def _search(self, x, query_row: int, q: np.ndarray, bounds: np.ndarray, k: int, kth: tuple | None) -> list[tuple[int, int, int]]:
        """(score, -id, -row) of the rows that belong to the k best, given that k rows at ``kth`` or better are known elsewhere."""
        best: list[tuple[int, int, int]] = []
        limit = kth
        heap = [(-int(bounds[0]), 0)]
        while heap:
            negative, node = heapq.heappop(heap)
            if limit is not None and (-negative < limit[0] or -negative == limit[0] and -int(self.first[node]) < limit[1]):
                if -negative < limit[0]:
                    break
                continue
            start, end, _, _, left, right = self.nodes[node].tolist()
            if left >= 0:
                heapq.heappush(heap, (-int(bounds[left]), left))
                heapq.heappush(heap, (-int(bounds[right]), right))
                continue
            scores = x[start:end] @ q
            keep = np.arange(start, end) if limit is None else start + np.flatnonzero(scores >= limit[0])
            for i, r, s in zip(self.ids[keep].tolist(), self.rows[keep].tolist(), scores[keep - start].tolist()):
                item = (int(s), -i, -r)
                if r == query_row or (limit is not None and item < limit):
                    continue
                heapq.heappush(best, item)
                if len(best) > k:
                    heapq.heappop(best)
                if len(best) == k and (limit is None or best[0] > limit):
                    limit = best[0]
        return best


def _routed(rows: DataFrame, tops: dict[int, Top]) -> DataFrame:
    """(row, id, v, dim, leaf) of (row, id, v)."""
    shared = rows.sparkSession.sparkContext.broadcast(tops)  # at most ``leaves`` nodes per length of the sample

    def run(batches):
        for b in batches:
            vectors = b.column(2).to_pylist()
            dims = np.array([len(v) for v in vectors], dtype=np.int64)
            leaf = np.zeros(len(vectors), dtype=np.int64)
            for dim in set(dims.tolist()) & set(shared.value):
                own = np.flatnonzero(dims == dim)
                leaf[own] = shared.value[dim].route(_matrix([vectors[i] for i in own]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(dims), pa.array(leaf)], names=["row", "id", "v", "dim", "leaf"])

    return rows.mapInArrow(run, "row long, id long, v array<long>, dim long, leaf long")


def _boxes(trees: DataFrame) -> dict[tuple[int, int], tuple]:
    """(low, high, smallest id, shards) of each (dim, leaf): a bounded number of them, each as wide as a vector."""
    sides = trees.select("dim", "leaf", "first", F.posexplode(F.arrays_zip("low", "high")).alias("p", "b"))
    per = sides.groupBy("dim", "leaf", "p").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    per = per.groupBy("dim", "leaf").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("box"))
    count = trees.groupBy("dim", "leaf").agg(F.min("first").alias("first"), F.count("*").alias("shards"))
    rows = count.join(per, ["dim", "leaf"], "left").collect()
    return {(r.dim, r.leaf): (np.array([b.low for b in r.box or ()]), np.array([b.high for b in r.box or ()]), r.first, r.shards) for r in rows}


def reach(queries: DataFrame, boxes: dict[tuple[int, int], tuple]) -> DataFrame:
    """(row, id, v, kth, dim, leaf, sub): each query with the shards that can hold one of its k best, less the shard that answered it."""
    shared = queries.sparkSession.sparkContext.broadcast(boxes)

    def run(batches):
        by_dim: dict[int, list] = {}
        for (dim, leaf), box in sorted(shared.value.items()):
            by_dim.setdefault(dim, []).append((leaf, *box))
        for b in batches:
            out = []
            rows = b.to_pylist()
            for dim in sorted({r["dim"] for r in rows} & set(by_dim)):
                own = [r for r in rows if r["dim"] == dim]
                leaf, low, high, first, shards = (np.array(x) for x in zip(*by_dim[dim]))
                low, high, qs = low.reshape(len(leaf), -1), high.reshape(len(leaf), -1), _matrix([r["v"] for r in own])
                exact = float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * float(np.abs(qs).max(initial=0)) * max(1, dim) < 2.0**53
                kind = np.float64 if exact else object  # beyond 2**53 Python's integers decide
                low, high, qs = (a.astype(kind) for a in (low, high, qs))
                bounds = np.maximum(qs, 0) @ high.T + np.minimum(qs, 0) @ low.T
                for r, bound in zip(own, bounds):
                    k = r["kth"]
                    able = np.ones(len(leaf), bool) if k is None else np.array((bound > k["score"]) | ((bound == k["score"]) & (first <= k["vec_id"])), dtype=bool)
                    out += [(r["row"], r["id"], r["v"], k, dim, int(leaf[i]), s) for i in np.flatnonzero(able) for s in range(int(shards[i])) if (int(leaf[i]), s) != (r["leaf"], r["sub"])]
            if out:
                cols = list(zip(*out))
                types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.struct([("score", pa.int64()), ("vec_id", pa.int64()), ("vec_row", pa.int64())]), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["row", "id", "v", "kth", "dim", "leaf", "sub"])

    return queries.mapInArrow(run, "row long, id long, v array<long>, kth struct<score:long,vec_id:long,vec_row:long>, dim long, leaf long, sub long")


def _searched(trees: DataFrame, asked: DataFrame, k: int, batch: int) -> DataFrame:
    """Answers of the queries (row, id, v, kth, dim, leaf, sub), a shard's queries in batches of about ``batch``. Only a row a shard is sent to all tasks:
    files of queries are small, as their vectors repeat, but not in memory, so their joins don't go by size."""
    key = ["dim", "leaf", "sub"]
    batches = asked.groupBy(*key).agg(F.count("*").alias("n")).select(*key, F.ceil(F.col("n") / batch).alias("batches"))
    dealt = asked.join(F.broadcast(batches), key).withColumn("batch", F.pmod(F.xxhash64("row"), F.col("batches")))
    packed = dealt.groupBy(*key, "batch").agg(F.collect_list(F.struct("row", "id", "v", "kth")).alias("qs"))

    def run(frames):
        for b in frames:
            out = []
            for blob, qs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                asked = [(q["row"], q["id"], q["v"], q["kth"] and (q["kth"]["score"], -q["kth"]["vec_id"], -q["kth"]["vec_row"])) for q in qs]
                out += KDTree.load(blob).answer(asked, k)
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in _RESULT.split(", ")])

    return packed.join(trees.hint("merge"), key).select("tree", "qs").mapInArrow(run, _RESULT)


def _low(rows: DataFrame, n: int, sample: int) -> DataFrame:
    """Of ``n`` rows little more than ``sample``, those of smallest hash: a limit alone would send so many of every partition to the driver."""
    most = sample + 10 * math.isqrt(sample) + 10
    return rows if n <= most else rows.where(F.xxhash64("row") <= -(2**63) + 2**64 * most // n)


def top_k(vectors: DataFrame, wanted: Column, k: int = 5, shard_rows: int = 8192, leaves: int = 512, sample: int = 20_000, batch: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors``: (id long, v array<long>); the rows for which ``wanted`` holds are the queries."""
    usable = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", F.isnull))
    rows = materialize(usable.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")
    some: dict[int, list] = {}
    n = rows.count()
    for r in _low(rows, n, sample).orderBy(F.xxhash64("row")).select("v").limit(sample).collect():  # the documented bound
        some.setdefault(len(r.v), []).append(r.v)
    tops = {dim: Top(_matrix(v), max(1, min(leaves, -(-n // shard_rows)))) for dim, v in some.items()}
    placed = _routed(rows, tops)
    sizes = placed.groupBy("dim", "leaf").agg(F.count("*").alias("n")).select("dim", "leaf", F.ceil(F.col("n") / shard_rows).alias("shards"))
    placed = materialize(placed.join(F.broadcast(sizes), ["dim", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("shards"))).drop("shards"), "placed")  # a row per leaf is sent

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = KDTree.build(part["id"].to_numpy(), part["row"].to_numpy(), _matrix(part["v"]))
        first = part.iloc[0]
        return pd.DataFrame({"dim": [first["dim"]], "leaf": [first["leaf"]], "sub": [first["sub"]], "first": [int(tree.first[0])], "low": [tree.low[0].tolist()], "high": [tree.high[0].tolist()], "tree": [tree.dump()]})

    trees = materialize(placed.groupBy("dim", "leaf", "sub").applyInPandas(grow, "dim long, leaf long, sub long, first long, low array<long>, high array<long>, tree binary"), "trees")
    asked = placed.where(wanted).select("row", "id", "v", "dim", "leaf", "sub")
    none = F.lit(None).cast("struct<score:long,vec_id:long,vec_row:long>").alias("kth")
    home = materialize(_searched(trees, asked.select("row", "id", "v", none, "dim", "leaf", "sub"), k, batch), "home")
    best = F.struct("score", F.negative("vec_id").alias("i"), F.negative("vec_row").alias("r"))
    worst = home.groupBy("query_row").agg(F.count("*").alias("found"), F.min(best).alias("w")).where(F.col("found") == k)
    kth = worst.select("query_row", F.struct(F.col("w.score").alias("score"), F.negative("w.i").alias("vec_id"), F.negative("w.r").alias("vec_row")).alias("kth"))
    known = asked.join(kth.hint("merge"), asked["row"] == kth["query_row"], "left").select("row", "id", "v", "kth", "dim", "leaf", "sub")
    away = _searched(trees, materialize(reach(known, _boxes(trees)), "reach"), k, batch)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")  # at most k rows per query and shard
    found = home.unionByName(away).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""

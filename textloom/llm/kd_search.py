"""Exact k highest inner products over KD-trees, one per shard.

Index. Components become floor(256 x). Vectors are dealt to shards of about SHARD by a hash of their id;
each shard's tree splits at the median of the widest dimension and keeps, for every node, the tight box
around its vectors. Trees are written to the shared folder as they will be read: leaf-ordered vectors,
boxes and children.

Search. A box bounds the product with a query q by the sum of max(q lo, q hi). A query walks a tree best
box first and stops at the first box below its kth score. Each query starts in its own shard; the kth
score found there goes with it to all other shards, where only boxes and vectors that reach it count.
Queries travel in blocks. Scores and bounds are whole numbers, so nothing is approximate; a box or vector
equal to the kth score is still looked at, as ties go to the smaller id.

Wide vectors, with a component beyond LARGEST, have trees and query blocks of their own, stored as longs;
where products or their sums might not fit a long, they are of Python's integers. A score that doesn't fit
a long is an error, as it is in the SQL.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor
do rows without an id, nor vectors with a component that isn't a long once it is whole (its score with
anything but 0 would be none either); vectors of different lengths have no product; ties go to the smaller
id; an empty table gives an empty result; other columns, whatever their names, are not read; vectors of any
length are handled, a leaf at a time.

Rows that share an id: ``index(repeated="every")``, as the query has it, makes each a candidate of its own
for every row but itself, and each whose id is asked for a query of its own. The default, "least", keeps
the bytewise least vector of an id.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm import _common as C

K = 5
SCALE = 256
#: Vectors in a shard, in a leaf, and queries in a block.
SHARD, LEAF, BLOCK = 4_096, 128, 512
#: Largest whole component of a vector stored as 32 bits; others are wide.
LARGEST = 1 << 27

_INDEX = "shard int, dim int, width int, ids binary, rows binary, vectors binary, low binary, high binary, nodes binary"
_HITS = "row bigint, query_id bigint, vec_id bigint, score bigint"


def whole(vector: list | None) -> np.ndarray | None:
    """floor(256 x) of each component, or None for a vector that takes no part."""
    if not vector or any(x is None for x in vector):
        return None
    x = np.floor(SCALE * np.array(vector, np.float64))
    return x.astype(np.int64) if np.isfinite(x).all() and -(2.0**63) <= x.min() and x.max() < 2.0**63 else None


def _packed(x: np.ndarray) -> bytes:
    """4 bytes a component, or 8 of a wide vector."""
    return x.astype("<i8" if _most(x) > LARGEST else "<i4").tobytes()


def _most(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _fits(score: int) -> int:
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError(f"a score does not fit a long: {score}")
    return score


class Tree:
    """Arrays of a KD-tree: ids, rows and vectors in leaf order; per node its box, and (first, end, left,
    right). A row is a vector's own number; ids may repeat."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, nodes: np.ndarray, rows: np.ndarray):
        self.ids, self.vectors, self.low, self.high, self.nodes, self.rows = ids, vectors, low, high, nodes, rows

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None) -> Tree:
        order, low, high, nodes = np.arange(len(ids)), [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            first, end, parent, side = todo.pop()
            inside = vectors[order[first:end]]
            lo, hi = inside.min(0), inside.max(0)
            here = len(nodes)
            nodes.append([first, end, -1, -1])
            low.append(lo)
            high.append(hi)
            if parent >= 0:
                nodes[parent][side] = here
            widest = int((hi.astype(np.float64) - lo).argmax())  # wide ranges overflow longs
            if end - first > leaf and hi[widest] > lo[widest]:
                mid = (end - first) // 2
                by = np.argpartition(inside[:, widest], mid)
                order[first:end] = order[first:end][by]
                todo += [(first, first + mid, here, 2), (first + mid, end, here, 3)]
        return cls(ids[order], vectors[order], np.array(low), np.array(high), np.array(nodes, np.int64), (ids if rows is None else rows)[order])

    def search(self, query_rows: np.ndarray, queries: np.ndarray, kth: list[int | None], k: int = K) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """For each query, its up to k best (-score, id) of at least ``kth``, its own row left out."""
        # Products of floats are exact below 2^53, of longs below 2^63.
        most = _most(self.vectors) * _most(queries) * queries.shape[1]
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
        vectors, qs = self.vectors.astype(kind), queries.astype(kind)
        bounds = np.maximum(qs, 0) @ self.high.astype(kind).T + np.minimum(qs, 0) @ self.low.astype(kind).T
        nodes = self.nodes.tolist()
        for i, own in enumerate(query_rows.tolist()):
            best: list[tuple[int, int, int]] = []
            least, bound, heap = -math.inf if kth[i] is None else int(kth[i]), bounds[i].tolist(), [(-bounds[i, 0], 0)]
            while heap:
                b, node = heapq.heappop(heap)
                if -b < least:
                    break
                first, end, left, right = nodes[node]
                if left >= 0:
                    for child in (left, right):
                        if bound[child] >= least:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                scores = vectors[first:end] @ qs[i]
                for j in np.flatnonzero(scores >= least):
                    best.append((-int(scores[j]), int(self.ids[first + j]), int(self.rows[first + j])))
                best = sorted(x for x in best if x[2] != own)[:k]
                if len(best) == k:
                    least = max(least, -best[-1][0])
            yield own, [x[:2] for x in best]


def _tree(row: dict) -> Tree:
    box = lambda name: np.frombuffer(row[name], f"<i{row['width']}").reshape(-1, row["dim"]).astype(np.int64)
    return Tree(np.frombuffer(row["ids"], "<i8"), box("vectors"), box("low"), box("high"), np.frombuffer(row["nodes"], "<i8").reshape(-1, 4), np.frombuffer(row["rows"], "<i8"))


def index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_size: int = SHARD, repeated: str = "least") -> DataFrame:
    """The trees, written: one row per shard, vector length and width. ``repeated``: of rows with one id,
    the "least" vector counts, or "every" row."""

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(i, len(v), _packed(v)) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (v := whole(x)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["id", "dim", "v"])

    def build(table: pa.Table) -> pa.Table:
        dim, width = (table[c][0].as_py() for c in ("dim", "width"))
        vectors = np.frombuffer(b"".join(table["v"].to_pylist()), f"<i{width}").reshape(-1, dim).astype(np.int64)
        tree = Tree.build(table["id"].to_numpy(), vectors, rows=table["row"].to_numpy())
        small = lambda x: [np.ascontiguousarray(x).astype(f"<i{width}").tobytes()]
        columns = {"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "width": pa.array([width], pa.int32())}
        columns |= {"ids": [tree.ids.astype("<i8").tobytes()], "rows": [tree.rows.astype("<i8").tobytes()], "vectors": small(tree.vectors), "low": small(tree.low), "high": small(tree.high), "nodes": [tree.nodes.astype("<i8").tobytes()]}
        return pa.table(columns)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    found = rows.mapInArrow(quantised, "id bigint, dim int, v binary")
    if repeated == "every":  # numbers that are written once stay the same when a task runs again
        clean = found.select("*", F.monotonically_increasing_id().alias("row"))
    else:
        clean = found.groupBy("id").agg(F.min(F.struct("v", "dim")).alias("x")).select("id", "x.*", F.col("id").alias("row"))
    clean = C.written(clean, "vectors")
    shards = max(1, -(-clean.count() // shard_size))
    dealt = clean.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).withColumn("width", (F.octet_length("v") / F.col("dim")).cast("int"))
    return C.written(dealt.groupBy("shard", "dim", "width").applyInArrow(build, _INDEX), "index")


def top_k(trees: DataFrame, every: int, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the vectors whose id is divisible by ``every``."""

    def own_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = _tree(row)
                at = np.flatnonzero(tree.ids % every == 0)
                out = []
                for i, (own, best) in zip(at, tree.search(tree.rows[at], tree.vectors[at], [None] * len(at), k), strict=True):
                    scores = [_fits(-s) for s, _ in best]
                    kth = scores[-1] if len(best) == k else None
                    out.append((own, int(tree.ids[i]), row["dim"], row["width"], tree.vectors[i].astype(f"<i{row['width']}").tobytes(), row["shard"], kth, [x for _, x in best], scores))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                names = ["row", "query_id", "dim", "width", "v", "shard", "kth", "vec_ids", "scores"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):  # one tree and one block at a time
                row = batch.slice(at, 1).to_pylist()[0]
                queries = row["queries"]
                vectors = np.frombuffer(b"".join(q["v"] for q in queries), f"<i{row['query_width']}").reshape(-1, row["dim"]).astype(np.int64)
                away = np.array([(q["shard"], row["query_width"]) != (row["shard"], row["width"]) for q in queries], bool)
                ids = {q["row"]: q["query_id"] for q in queries}
                found = _tree(row).search(np.array([q["row"] for q in queries])[away], vectors[away], [q["kth"] for q, a in zip(queries, away, strict=True) if a], k)
                hits = [(own, ids[own], i, _fits(-s)) for own, best in found for s, i in best]
                yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in range(4)], names=["row", "query_id", "vec_id", "score"])

    first = C.written(trees.mapInArrow(own_shard, "row bigint, query_id bigint, dim int, width int, v binary, shard int, kth bigint, vec_ids array<bigint>, scores array<bigint>"), "queries")
    near = first.select("row", "query_id", F.inline(F.arrays_zip(F.col("vec_ids").alias("vec_id"), F.col("scores").alias("score"))))
    blocks = max(1, -(-first.count() // BLOCK))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    packed = first.withColumn("block", block).groupBy("dim", F.col("width").alias("query_width"), "block").agg(F.collect_list(F.struct("row", "query_id", "v", "shard", "kth")).alias("queries"))
    # Every block meets every tree of its vectors' length; it is the smaller of the two, so it travels.
    places = trees.select("dim", "shard", "width")
    sent = packed.join(places, "dim").repartition(F.col("dim"), F.col("shard"), F.col("block"))
    far = trees.join(sent, ["dim", "shard", "width"]).mapInArrow(others, _HITS)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return near.union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(index(C.table(spark, sf_dir, "embeddings"), repeated="every"), every=50)


QUERIES = {"op10_kd_search": op10_kd_search}
ORACLES = {
    "op10_kd_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
}

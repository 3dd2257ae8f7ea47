"""Exact top-k search by inner product with a KD-tree per shard.

Rows are dealt into shards; each task builds a tree over its shard by median splits and keeps
the tight bounding box of every node. A query walks a tree best first: the largest product any
point of a box can have bounds the node, and nodes below the query's k-th score so far are left
out. A first pass reads one leaf per shard and query; the k-th of those scores over all shards
is handed to the second, full pass as its start.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read

K = 10
SCALE = 1024
LEAF = 64
#: Rows of a shard, queries of a block: what a task holds and what is broadcast at a time.
SHARD_ROWS = 200_000
BLOCK_QUERIES = 5_000


class Tree:
    """Points of one shard in leaf order, with a tight box per node; children of node i are 2i+1, 2i+2."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.lo, self.hi, self.span = {}, {}, {}
        order = np.arange(len(ids))

        def split(node: int, a: int, b: int) -> None:
            own = points[order[a:b]]
            self.lo[node], self.hi[node] = own.min(0), own.max(0)
            self.span[node] = (a, b)
            wide = self.hi[node] - self.lo[node]
            axis = int(wide.argmax())
            if b - a <= leaf or wide[axis] == 0:
                return
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
            split(2 * node + 1, a, a + mid)
            split(2 * node + 2, a + mid, b)

        split(0, 0, len(ids))
        self.ids, self.points = ids[order], points[order]

    def bound(self, node: int, query: np.ndarray) -> float:
        return float(np.maximum(query * self.lo[node], query * self.hi[node]).sum())

    def leaf_of(self, query: np.ndarray) -> int:
        node = 0
        while 2 * node + 1 in self.span:
            node = max((2 * node + 1, 2 * node + 2), key=lambda n: self.bound(n, query))
        return node

    def scores(self, node: int, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.span[node]
        ids, scores = self.ids[a:b], self.points[a:b] @ query
        other = ids != own
        return ids[other], scores[other]

    def best(self, query: np.ndarray, own: int, k: int, least: float) -> list[tuple[float, int]]:
        """The k best (score, -id) of the shard that reach ``least``, scores tied by smaller id."""
        found: list[tuple[float, int]] = []
        open_ = [(-self.bound(0, query), 0)]
        while open_:
            bound, node = heapq.heappop(open_)
            if -bound < least or (len(found) == k and -bound < found[0][0]):
                break
            if 2 * node + 1 in self.span:
                for child in (2 * node + 1, 2 * node + 2):
                    heapq.heappush(open_, (-self.bound(child, query), child))
                continue
            ids, scores = self.scores(node, query, own)
            enough = scores >= max(least, found[0][0] if len(found) == k else least)
            for score, i in zip(scores[enough].tolist(), ids[enough].tolist(), strict=True):
                if len(found) < k:
                    heapq.heappush(found, (score, -i))
                elif (score, -i) > found[0]:
                    heapq.heapreplace(found, (score, -i))
        return found


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, point) with the scaled integer components of the rows that take part."""
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * F.lit(SCALE)))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(F.col("vec_id").isNotNull() & fine & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("point")).distinct()


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of any length, padded with zeros, which add nothing to a product."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def search(points: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS,
           block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best points of each query, its own id left out.

    Both frames are (vec_id, point). A row is known by its id and vector: equal rows count once,
    rows that share an id but not the vector are separate, and none of them is a partner of a query
    with that id. Shorter vectors count as padded with zeros. Queries go in blocks of ``block``,
    each broadcast by itself (``block`` x width x 8 bytes), over all shards; a shard's answer is at
    most k rows a query. Scores are exact while they are below 2**53.
    """
    spark = points.sparkSession
    n = points.count()
    shards = max(1, -(-n // shard_rows), min(spark.sparkContext.defaultParallelism, n // 1000))
    width = points.agg(F.max(F.size("point"))).first()[0] or 1
    dealt = cut_lineage(points.repartition(int(shards), F.xxhash64("vec_id", "point")))
    asked = cut_lineage(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "point"), F.lit(-(-queries.count() // block) or 1))))
    blocks = [r[0] for r in asked.select("block").distinct().collect()]
    out = None
    for b in blocks:
        rows = asked.filter(F.col("block") == b).select("vec_id", "point").collect()
        wide = max(width, *(len(r[1]) for r in rows))
        table = np.zeros((len(rows), wide))
        for i, r in enumerate(rows):
            table[i, :len(r[1])] = r[1]
        sent = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), table))

        def walk(batches: Iterator[pa.RecordBatch], sent=sent, wide=wide, least=None) -> Iterator[pa.RecordBatch]:
            parts = [(x.column("vec_id").to_numpy(), _matrix(x.column("point"), wide)) for x in batches if x.num_rows]
            if not parts:
                return
            tree = Tree(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            ids, table = sent.value
            kth = None if least is None else least.value
            found = []
            for i, (own, query) in enumerate(zip(ids.tolist(), table, strict=True)):
                if kth is None:
                    _, scores = tree.scores(tree.leaf_of(query), query, own)
                    found += [(i, None, s) for s in np.sort(scores)[-k:].tolist()]
                else:
                    found += [(i, -m, s) for s, m in tree.best(query, own, k, kth[i])]
            for at in range(0, len(found), 50_000):
                q, v, s = zip(*found[at:at + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())],
                    names=["q", "vec_id", "score"])

        top = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
        shape = "q long, vec_id long, score double"
        first = dealt.mapInArrow(walk, shape).withColumn("rank", F.row_number().over(top))
        kth = np.full(len(rows), -np.inf)
        for q, s in first.filter(F.col("rank") == k).select("q", "score").collect():
            kth[q] = s
        least = spark.sparkContext.broadcast(kth)

        def walk_all(batches: Iterator[pa.RecordBatch], walk=walk, least=least) -> Iterator[pa.RecordBatch]:
            return walk(batches, least=least)

        best = dealt.mapInArrow(walk_all, shape).withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= k)
        names = F.array(*[F.lit(int(r[0])).cast("long") for r in rows]) if len(rows) <= 64 else None
        if names is None:
            index = spark.createDataFrame([(i, int(r[0])) for i, r in enumerate(rows)], "q long, query_id long")
            best = best.join(index, "q")
        else:
            best = best.withColumn("query_id", F.element_at(names, (F.col("q") + 1).cast("int")))
        best = best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
                           F.col("score").cast("long").alias("score"))
        out = best if out is None else out.unionByName(best)
        if len(blocks) > 1:
            out = cut_lineage(out)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op8_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cut_lineage(usable(read(spark, sf_dir, "embeddings")))
    return search(points, points.filter(F.col("vec_id") % 100 == 0))


SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.p, c.p), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

QUERIES = {"op8_kdtree": op8_kdtree}
ORACLES = {"op8_kdtree": SQL}

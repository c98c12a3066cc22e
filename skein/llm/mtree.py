"""Exact top-k inner-product search with M-trees (Ciaccia, Patella and Zezula, 1997), searched best first.

Vectors of integers are dealt by a hash of their id into shards of about SHARD_ROWS rows. Each shard is
one M-tree of pages: a routing object, a covering radius and the distance to the parent's routing
object for every child. Inner products become a metric by one more coordinate: with M the largest
norm in a shard, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so
the nearest x' have the highest scores. A search takes pages from a heap by the least distance they can
hold, leaves out entries whose stored parent distance already rules them out by the triangle
inequality, without computing theirs, and ends when no page can reach the k-th best. Scores are exact
integers; bounds have slack for rounding and only ever let more through.

Queries go in blocks of at most BLOCK_BYTES, each broadcast to the shards; each shard returns k rows a
query at most, which are ranked by query. Copies of a vector are one entry, with its k + 1 smallest ids:
no other copy can be among the k best, whatever the query's own id. A vector that a third of the rows
hold is thus spread over all shards, and small in each.

Defined cases: rows with a null id take no part; vectors that are null, or hold a null, NaN or infinite
component, take no part; vectors of other lengths are never compared; rows that repeat an id and
vector count once, and a query's own id is never its candidate; ties go to the smaller id; integer
scores must fit in 63 bits; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import read_table, ship, written

K = 5
SCALE = 256
SHARD_ROWS = 16_384
PAGE = 512
FANOUT = 64
BLOCK_BYTES = 16 << 20
SLACK = 1e-6


@dataclass
class Page:
    """A node. kids: numbers of an inner node's pages; ids: each entry's smallest ids in a leaf."""

    vectors: np.ndarray
    radii: np.ndarray
    from_parent: np.ndarray
    kids: list[int] | None
    ids: list[np.ndarray] | None


class Tree:
    """An M-tree over integer vectors of one length, bulk-loaded."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, keep: int, page: int = PAGE, fanout: int = FANOUT):
        self.page, self.fanout = page, fanout
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids)
        vectors, ids = vectors[order], ids[order]
        new = np.r_[True, (vectors[1:] != vectors[:-1]).any(axis=1)]
        starts = np.flatnonzero(new)
        # sorted by vector, then id: a vector's smallest ids come first
        self.ids = [np.unique(x)[:keep] for x in np.split(ids, starts[1:])]
        distinct = vectors[starts]
        top = float(np.abs(distinct).max(initial=0))
        self.exact = top * top * max(1, vectors.shape[1]) < 2**52
        self.vectors = distinct.astype(np.float64) if self.exact else distinct
        norms = (distinct.astype(np.float64) ** 2).sum(axis=1)
        self.most = float(norms.max(initial=0))
        self.extra = np.sqrt(self.most - norms)
        self.top = top
        self.random = np.random.default_rng(7)
        self.pages: list[Page] = []  # the root is number 0
        self._load(np.arange(len(distinct)), None)

    def _far(self, rows: np.ndarray, one: int) -> np.ndarray:
        """Distances of rows to one, in the metric space."""
        apart = self.vectors[rows].astype(np.float64) - self.vectors[one].astype(np.float64)
        return np.sqrt((apart**2).sum(axis=1) + (self.extra[rows] - self.extra[one]) ** 2)

    def _load(self, rows: np.ndarray, parent: int | None) -> int:
        number = len(self.pages)
        self.pages.append(Page(self.vectors[:0], np.zeros(0), np.zeros(0), None, None))
        home = (lambda x: self._far(x, parent)) if parent is not None else (lambda x: np.zeros(len(x)))
        if len(rows) <= self.page:
            self.pages[number] = Page(self.vectors[rows], np.zeros(len(rows)), home(rows), None, [self.ids[r] for r in rows])
            return number
        routing = self.random.choice(rows, min(self.fanout, max(2, 2 * len(rows) // self.page)), replace=False)
        apart = np.stack([self._far(rows, r) for r in routing])
        nearest = apart.argmin(axis=0)
        groups = [(r, np.flatnonzero(nearest == k), apart[k]) for k, r in enumerate(routing)]
        groups = [(r, g, d) for r, g, d in groups if len(g)]
        if len(groups) == 1:  # not to be told apart: halves
            r, g, d = groups[0]
            groups = [(r, g[: len(g) // 2], d), (r, g[len(g) // 2 :], d)]
        own = np.array([r for r, _, _ in groups])
        kids = [self._load(rows[g], r) for r, g, _ in groups]
        self.pages[number] = Page(self.vectors[own], np.array([d[g].max() for _, g, d in groups]), home(own), kids, None)
        return number

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query's id, id, score) of the k best for each row of queries, the smaller id first among equal scores.

        Every query goes best first through its own heap; queries whose next page is the same one look at it together."""
        if not len(self.vectors) or not len(queries):
            return []
        fits = self.exact and float(np.abs(queries).max(initial=0)) * max(self.top, 1) * max(1, queries.shape[1]) < 2**52
        q = queries.astype(np.float64) if fits else queries
        base = (queries.astype(np.float64) ** 2).sum(axis=1) + self.most
        slack = SLACK * (1 + np.sqrt(base))
        best: list[list[tuple[int, int]]] = [[] for _ in queries]  # heaps of (score, -id): the worst first
        least = np.full(len(queries), -np.inf)  # the k-th best's score
        reach = np.full(len(queries), np.inf)  # and distance
        heaps = [[(0.0, 0, 0.0)] for _ in queries]  # (least distance, page, distance to the page's routing object)
        while True:
            waiting: dict[int, list[tuple[int, float]]] = {}
            for i, heap in enumerate(heaps):
                if heap:
                    bound, page, to_parent = heapq.heappop(heap)
                    if bound > reach[i] + slack[i]:
                        heap.clear()  # nor can any other page of its heap hold a better one
                    else:
                        waiting.setdefault(page, []).append((i, to_parent))
            if not waiting:
                break
            for number, visitors in waiting.items():
                page = self.pages[number]
                rows = np.array([i for i, _ in visitors])
                limit = reach[rows] + slack[rows]
                # an entry that the stored distances rule out for all of them isn't computed
                near = np.abs(page.from_parent[:, None] - np.array([d for _, d in visitors])) - page.radii[:, None] <= limit if number else np.ones((len(page.vectors), len(rows)), bool)
                some = np.flatnonzero(near.any(axis=1))
                if not len(some):
                    continue
                vectors = page.vectors if len(some) == len(page.vectors) else page.vectors[some]
                dots = (vectors if fits else vectors.astype(np.int64)) @ q[rows].T
                if page.kids is not None:
                    apart = np.sqrt(np.maximum(base[rows] - 2.0 * dots, 0))
                    bounds = np.maximum(apart - page.radii[some][:, None], 0)
                    for e, j in zip(*np.nonzero((bounds <= limit) & near[some]), strict=True):
                        heapq.heappush(heaps[rows[j]], (float(bounds[e, j]), page.kids[some[e]], float(apart[e, j])))
                    continue
                bar = least[rows]
                if len(some) > k + 1:  # entries below the k + 1 best of the page can't be among the k best
                    bar = np.maximum(bar, np.partition(dots, len(some) - k - 1, axis=0)[len(some) - k - 1])
                for e, j in zip(*np.nonzero(dots >= bar), strict=True):
                    heap, own, score = best[rows[j]], own_ids[rows[j]], int(dots[e, j])
                    for one in page.ids[some[e]].tolist():
                        if one == own:
                            continue
                        if len(heap) < k:
                            heapq.heappush(heap, (score, -one))
                        elif (score, -one) > heap[0]:
                            heapq.heapreplace(heap, (score, -one))
                        else:
                            break
                for i in rows.tolist():
                    if len(best[i]) == k:
                        least[i] = best[i][0][0]
                        reach[i] = max(base[i] - 2.0 * least[i], 0) ** 0.5
        return [(int(own), -i, s) for own, heap in zip(own_ids, best, strict=True) for s, i in sorted(heap, reverse=True)]


def integer_vectors(table: DataFrame, vector: str = "embedding", id_column: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(id, v) with v = floor(scale * x) of rows that take part."""
    odd: Column = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = table.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).filter(~odd)
    return whole.select(F.col(id_column).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors, and all their components."""
    lengths = np.diff(column.offsets.to_numpy())
    return lengths, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _by_length(ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray):
    """(length, ids, matrix) for each length that occurs."""
    at = np.r_[0, np.cumsum(lengths)]
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield int(n), ids[rows], flat[(at[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)


def build_index(vectors: DataFrame, keep: int = K + 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, length, tree): written M-trees over rows (id, v), good for the keep - 1 best."""
    ship(vectors.sparkSession)
    shards = max(1, -(-vectors.count() // shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard")

    def build(batches):
        held: dict[int, list] = {}

        def trees(shard):
            parts = held.pop(shard)
            ids, lengths, flat = (np.concatenate([p[k] for p in parts]) for k in range(3))
            for n, own, matrix in _by_length(ids, lengths, flat):
                tree = pickle.dumps(Tree(matrix, own, keep), protocol=5)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int32()), pa.array([tree], pa.binary())], names=["shard", "length", "tree"])

        for batch in batches:
            ids, shard = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for s in np.unique(shard):
                for before in [x for x in held if x != s]:  # sorted by shard: an earlier one is whole
                    yield from trees(before)
                mine = batch.filter(pa.array(shard == s))
                held.setdefault(int(s), []).append((ids[shard == s], *_matrix(mine.column(1))))
        for s in list(held):
            yield from trees(s)

    return written(dealt.select("id", "v", "shard").mapInArrow(build, "shard int, length int, tree binary"), "mtree")


def search(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all indexed rows for each query (id, v), its own id left out."""
    spark = index.sparkSession
    ship(spark)
    queries = written(queries.distinct().withColumn("length", F.size("v")), "queries")
    amount = queries.agg(F.sum(8 * F.col("length") + 16)).first()[0] or 0
    blocks = max(1, -(-amount // BLOCK_BYTES))
    found = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").toArrow().combine_chunks()
        table = {}
        if rows.num_rows:
            column = rows.column("v").combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            table = {n: (own, m) for n, own, m in _by_length(rows.column("id").to_numpy(), *_matrix(column))}
        sent = spark.sparkContext.broadcast(table)  # BLOCK_BYTES or so

        def run(batches, sent=sent):
            for batch in batches:
                for n, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if n not in sent.value:
                        continue
                    tree, (own, vectors) = pickle.loads(data.as_py()), sent.value[n]
                    out = tree.search(vectors, own, k)
                    for start in range(0, len(out), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[start : start + 100_000], strict=True)], names=["query_id", "vec_id", "score"])

        best = written(index.select("length", "tree").mapInArrow(run, "query_id long, vec_id long, score long"), "found")
        found = best if found is None else found.union(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(integer_vectors(read_table(spark, sf_dir, "embeddings")), "vectors")
    return search(build_index(vectors), vectors.filter(F.col("id") % 50 == 0))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
QUERIES = {"op6_mtree_topk": op6_mtree_topk}
ORACLES = {"op6_mtree_topk": SQL}

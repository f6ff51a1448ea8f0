"""Exact top-k inner products by best-first search in a paged M-tree.

Vectors become integers. The tree is metric (Euclidean) and has three levels:

* routing objects: at most ``OBJECTS`` vectors of the data, a sample by hash, so
  a bounded number whatever the input. Every vector belongs to its closest one.
* nodes: runs of at most ``NODE`` vectors of one routing object, in order of their
  distance from it; a node row holds its vectors, ids, its range of distances
  and its largest norm.
* pages: runs of at most ``PAGE`` vectors of a node around a routing object of
  their own (the run's middle vector), with covering radius, parent distance
  (from page object to node object) and largest norm.

Nodes are cut from sorted range partitions, so a dense region or a hot group of
near copies fills many nodes in many tasks. Of equal vectors the k + 1 smallest
ids are kept: no others can be among the first k.

For a query q and vectors x within r of p, <q, x> <= <q, p> + |q| r, and, from
d(q, x) >= |d(q, parent) - d(p, parent)| - r,
2 <q, x> <= |q|^2 + max |x|^2 - d(q, x)^2. The second needs no distance of its own.
Search, for a block of queries: nodes and pages wait in one queue, the highest
bound of a query that is still open first. A page whose stored bound is below
every query's k-th score is passed over without computing a distance; then its
object's distances bound it again; then the scores of the open queries are computed.
Queries start with the k-th best score among the routing objects, which are rows.

Bounds are widened by 1e-9 of their size, and only a bound below the k-th score
prunes, so ties reach the final order by (score, smaller id).

Queries go in blocks of ``QUERIES`` to every group of nodes, by a join on the
group; each (block, group) returns at most k rows a query, from which a window
takes the first k.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bourse.llm import textcols as T
from bourse.llm.codes import finite, floored
from bourse.llm.lines import saved

LIMIT = 1 << 26          # components beyond it are held at it, so that a score fits a long
OBJECTS = 4096           # routing objects of the root: at most this many vectors go to every task
NODE, PAGE = 2048, 64    # vectors
QUERIES = 1024           # of one block
GROUP = 512              # nodes of a group at most
QUEUE = 32               # nodes that a task holds at a time: 64 MB at 256 components
SLACK = 1e-9


def padded(flat: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Rows of different lengths as one matrix; missing components are 0."""
    if len(counts) and (counts == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(counts), width), flat.dtype)
    at = np.arange(width)[None, :] < counts[:, None]
    out[at] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products [rows of a, rows of b]."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)     # every partial sum is exact
    return a @ b.T


def distances(dot: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(a2[:, None] + b2[None, :] - 2.0 * dot, 0.0))


def norms2(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(1)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    counts = np.diff(np.asarray(col.offsets))
    return padded(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts, width)


def _assigner(objects: np.ndarray):
    """Each vector with its closest routing object and the distance."""
    o2 = norms2(objects)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for at in range(0, big.num_rows, 2048):
                batch = big.slice(at, 2048)
                x = _matrix(batch, "v", objects.shape[1])
                d = distances(products(x, objects), norms2(x), o2)
                best = d.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*T.keep_columns(batch, ["vec_id", "v"]), pa.array(best.astype(np.int32)),
                     pa.array(d[np.arange(len(x)), best])], names=["vec_id", "v", "object", "far"])
    return run


NODE_DDL = ("object int, ids array<long>, flat array<int>, near double, far double, top double, pages array<int>, "
            "radius array<double>, parent array<double>, tops array<double>")


def _node_row(ids: np.ndarray, x: np.ndarray, far: np.ndarray, obj: int, objects: np.ndarray) -> list:
    """One node: its vectors reordered by page, with the pages' bounds."""
    n2 = norms2(x)
    lead, order, radius, parent, tops = [], [], [], [], []
    left = np.arange(len(x))
    while len(left):
        mid = left[len(left) // 2] if len(left) > PAGE else left[0]
        d = distances(products(x[mid:mid + 1], x[left]), n2[mid:mid + 1], n2[left])[0]
        pick = np.argsort(d, kind="stable")[:PAGE]
        run = left[pick]
        lead.append(len(order))                       # the page object comes first of its page
        order.extend(run.tolist())
        radius.append(float(d[pick].max()))
        parent.append(float(far[run[0]]))
        tops.append(float(n2[run].max()))
        left = np.delete(left, pick)
    return [obj, ids[order], x[order].reshape(-1).astype(np.int32), float(far.min()), float(far.max()), float(n2.max()),
            np.array(lead, np.int32), radius, parent, tops]


def _node_batches(objects: np.ndarray):
    """Rows sorted by (object, far) to nodes of at most NODE vectors."""
    def batch_of(rows: list) -> pa.RecordBatch:
        schema = [("object", pa.int32()), ("ids", pa.list_(pa.int64())), ("flat", pa.list_(pa.int32())), ("near", pa.float64()),
                  ("far", pa.float64()), ("top", pa.float64()), ("pages", pa.list_(pa.int32())),
                  ("radius", pa.list_(pa.float64())), ("parent", pa.list_(pa.float64())), ("tops", pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)],
                                          names=[n for n, _ in schema])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count, obj = 0, None

        def flush() -> pa.RecordBatch:
            ids, x, far = (np.concatenate(c) for c in zip(*held, strict=True))
            return batch_of([_node_row(ids, x, far, obj, objects)])

        for batch in it:
            o, far, ids = (c.to_numpy() for c in T.keep_columns(batch, ["object", "far", "vec_id"]))
            x = _matrix(batch, "v", objects.shape[1])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(o)) + 1, [len(o)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                while a < b:
                    if count and (o[a] != obj or count == NODE):
                        yield flush()
                        held, count = [], 0
                    obj = int(o[a])
                    step = min(b - a, NODE - count)
                    held.append((ids[a:a + step], x[a:a + step], far[a:a + step]))
                    count, a = count + step, a + step
        if count:
            yield flush()
    return run


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray) -> None:
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = floor                              # a k-th score known beforehand
        self.least = floor.copy()

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores [rows, candidates]; a candidate with the query's own id is passed over."""
        low = np.iinfo(np.int64).min
        skip = (ids[None, :] == own[rows][:, None]) | (scores < self.least[rows][:, None])
        use = ~skip.all(1)
        rows, scores, skip = rows[use], scores[use], skip[use]
        if not len(rows):
            return
        s = np.concatenate([self.score[rows], np.where(skip, low, scores)], 1)
        i = np.concatenate([self.id[rows], np.where(skip, np.iinfo(np.int64).max, ids[None, :])], 1)
        order = np.lexsort((i, ~s), axis=1)[:, :self.k]   # ~s falls as s grows, without overflow
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.take_along_axis(i, order, 1)
        self.least[rows] = np.maximum(self.floor[rows], self.score[rows, -1])


def _above(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
    return bound + SLACK * np.abs(bound) + 1e-6 >= least


class Block:
    """A block of queries and what the root knows of them."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, objects: np.ndarray, object_ids: np.ndarray, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.q2 = norms2(q)
        self.len = np.sqrt(self.q2)
        dot = products(q, objects)
        self.to_object = distances(dot, self.q2, norms2(objects))
        # the k-th best of the routing objects, each of which is a row, the query's own left out
        other = np.where(object_ids[None, :] == ids[:, None], np.iinfo(np.int64).min, dot)
        floor = np.full(len(ids), np.iinfo(np.int64).min)
        if other.shape[1] >= k:
            floor = np.partition(other, other.shape[1] - k, axis=1)[:, other.shape[1] - k]
        self.best = Best(len(ids), k, floor)

    def bound(self, closest: np.ndarray, top: np.ndarray | float) -> np.ndarray:
        """Largest inner product of a query with vectors no closer than ``closest`` and no longer than ``top``."""
        return np.minimum((self.q2[:, None] + top - np.maximum(closest, 0.0) ** 2) / 2, self.len[:, None] * np.sqrt(top))

    def search(self, nodes: list[dict]) -> None:
        """Best-first over the nodes and their pages."""
        queue: list[tuple] = []
        for i, node in enumerate(nodes):
            d = self.to_object[:, node["object"]]
            closest = np.maximum(node["near"] - d, d - node["far"])       # the node is a ring around its object
            node["bound"] = self.bound(closest[:, None], node["top"])[:, 0]
            heapq.heappush(queue, (-float(node["bound"].max()), i, -1))
        while queue:
            _, i, page = heapq.heappop(queue)
            node = nodes[i]
            if page < 0:
                if not _above(node["bound"], self.best.least).any():
                    continue
                d = self.to_object[:, node["object"]]
                gap = np.abs(d[:, None] - node["parent"][None, :]) - node["radius"][None, :]
                node["stored"] = np.minimum(self.bound(gap, node["tops"][None, :]), node["bound"][:, None])
                node["x"] = node["flat"].reshape(len(node["ids"]), -1).astype(np.int64)
                for j in range(len(node["pages"])):
                    heapq.heappush(queue, (-float(node["stored"][:, j].max()), i, j))
                continue
            rows = np.flatnonzero(_above(node["stored"][:, page], self.best.least))
            if not len(rows):
                continue
            a = node["pages"][page]
            b = node["pages"][page + 1] if page + 1 < len(node["pages"]) else len(node["ids"])
            x = node["x"][a:b]
            dot = products(self.q[rows], x[:1])[:, 0]
            r = node["radius"][page]
            d = np.sqrt(np.maximum(self.q2[rows] + norms2(x[:1])[0] - 2.0 * dot, 0.0))
            bound = np.minimum(dot + self.len[rows] * r,
                               (self.q2[rows] + node["tops"][page] - np.maximum(d - r, 0.0) ** 2) / 2)
            rows = rows[_above(bound, self.best.least[rows])]
            if len(rows):
                self.best.add(rows, products(self.q[rows], x), node["ids"][a:b], self.ids)

    def rows(self) -> pa.RecordBatch:
        found = self.best.score > np.iinfo(np.int64).min
        q = np.repeat(self.ids, found.sum(1))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.best.id[found]), pa.array(self.best.score[found])],
                                          names=["query_id", "vec_id", "score"])


def _searcher(objects: np.ndarray, object_ids: np.ndarray, k: int):
    """Joined rows of a query block and a node; a block's nodes come one after the other."""
    width = objects.shape[1]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name, held = None, None, []
        for batch in it:
            cols = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            for i in range(batch.num_rows):
                now = (cols["group"][i].as_py(), cols["block"][i].as_py())
                if now != name:
                    if block is not None:
                        block.search(held)
                        yield block.rows()
                    ids = cols["q_ids"][i].values.to_numpy()
                    block = Block(ids, cols["q_flat"][i].values.to_numpy().reshape(len(ids), width).astype(np.int64),
                                  objects, object_ids, k)
                    name, held = now, []
                node = {c: cols[c][i].values.to_numpy() for c in ("ids", "flat", "pages", "radius", "parent", "tops")}
                held.append(node | {c: cols[c][i].as_py() for c in ("object", "near", "far", "top")})
                if len(held) == QUEUE:
                    block.search(held)
                    held = []
        if block is not None:
            block.search(held)
            yield block.rows()
    return run


def _query_batches(width: int):
    """Query rows to blocks: (q_ids, q_flat)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in it:
            for at in range(0, big.num_rows, QUERIES):
                batch = big.slice(at, QUERIES)
                ids = T.keep_columns(batch, ["vec_id"])[0].to_numpy()
                x = _matrix(batch, "v", width).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids], pa.list_(pa.int64())), pa.array([x.reshape(-1)], pa.list_(pa.int32()))],
                    names=["q_ids", "q_flat"])
    return run


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v) of the rows that take part, each row once."""
    return vectors.where(finite("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), floored("embedding", scale, LIMIT).alias("v"))


def top_products(vectors: DataFrame, queries: Column, *, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of each query row with the other rows.

    ``vectors`` has vec_id and embedding; ``queries`` tells its query rows. Rows with
    a null vec_id or vector, or a null or non-finite component, take no part.
    Vectors of different lengths are compared with zeros for the missing
    components, an empty one scores 0. Equal rows (vec_id and components) count
    once. A vec_id with several vectors is a candidate with each of them, and as a
    query it is its smallest one; rows of the query's own vec_id are no candidates.
    Ties go to the smaller vec_id. An empty table, or one without queries, gives
    no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, scale)
    # of equal vectors only the first k + 1 ids can be an answer (one may be the query's own)
    same = Window.partitionBy("v").orderBy("vec_id")
    points = saved(rows.distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth"),
                   "tree-points")
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"] or not size["width"]:
        return _flat_answer(points, asked, k)
    width = size["width"]
    picked = points.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(OBJECTS).collect()
    objects = padded(np.array([c for r in picked for c in r["v"]], np.int64), np.array([len(r["v"]) for r in picked]), width)
    object_ids = np.array([r["vec_id"] for r in picked], np.int64)
    # distinct vectors as routing objects, few enough that nodes are well filled
    few = min(len(objects), max(1, size["n"] // (NODE // 2)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = points.mapInArrow(_assigner(objects[:few]), "vec_id long, v array<int>, object int, far double")
    nodes = saved(placed.repartitionByRange(parts, "object", "far", "v", "vec_id")
                  .sortWithinPartitions("object", "far", "v", "vec_id")
                  .mapInArrow(_node_batches(objects[:few]), NODE_DDL)
                  .withColumn("node", F.monotonically_increasing_id()), "tree-nodes")
    count = nodes.count()
    # as many groups as keep the cores busy, and enough to hold a group in a task's join buffer
    groups = max(math.ceil(count / GROUP), min(count, 2 * spark.sparkContext.defaultParallelism))
    numbered = nodes.withColumn("group", F.pmod(F.xxhash64("node"), F.lit(groups)).cast("int")).drop("node")
    blocks = saved(asked.repartition(max(1, min(parts, math.ceil(size["n"] / 100 / QUERIES))), "vec_id")
                   .mapInArrow(_query_batches(width), "q_ids array<long>, q_flat array<int>")
                   .withColumn("block", F.monotonically_increasing_id()), "tree-queries")
    to_all = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # a merge join keeps the nodes of a block together; a fixed number of tasks, since the rows are few but heavy
    met = to_all.repartition(groups, "group").hint("merge").join(numbered.repartition(groups, "group"), "group")
    found = met.mapInArrow(_searcher(objects, object_ids, k), "query_id long, vec_id long, score long")
    first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _flat_answer(points: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Answer where every vector is empty: all scores are 0, so the smallest ids win."""
    first = points.select(F.col("vec_id")).distinct().orderBy("vec_id").limit(k + 1)        # k + 1 rows
    pairs = asked.select(F.col("vec_id").alias("query_id")).join(F.broadcast(first), F.col("query_id") != F.col("vec_id"))
    w = Window.partitionBy("query_id").orderBy("vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.lit(0).cast("long").alias("score"))

"""Approximate nearest neighbours by inner product: a forest of random-projection trees searched through one priority queue."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import Scratch

#: Vectors that trees are fitted on, at least and for each leaf (the smallest by hash, all if there are fewer).
SAMPLE, SAMPLE_LEAF = 20_000, 16
TREES = 4
#: A tree's leaves have this share of all vectors, or fewer, of LEAF_LEAST to LEAF_WANTED vectors; a tree has 2 ** DEPTH_MOST leaves at most.
LEAF_SHARE, LEAF_LEAST, LEAF_WANTED, DEPTH_MOST = 1 / 64, 32, 4096, 12
#: A leaf's vectors and the queries that open it are compared in blocks of about so many.
LEAF_MOST, QUERIES_MOST = 4096, 16384
#: Vectors whose true neighbours are found by an exact scan, and the share of those that the opened leaves have to hold.
CALIBRATION, RECALL = 200, 0.96


class Forest:
    """Balanced trees of hyperplanes: node k of a tree has children 2k + 1 and 2k + 2."""

    def __init__(self, planes: np.ndarray, cuts: np.ndarray, depth: int):
        """planes: trees x nodes x dimensions; cuts: trees x nodes."""
        self.planes, self.cuts, self.depth = planes, cuts, depth

    @classmethod
    def fit(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
        """Each node's plane is normal to the line between two of its vectors, cut at the median."""
        rng = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        planes, cuts = np.zeros((trees, max(1, nodes), sample.shape[1])), np.zeros((trees, max(1, nodes)))
        for t in range(trees):
            rows = {0: np.arange(len(sample))}
            for k in range(nodes):
                own = rows.pop(k)
                if len(own) > 1:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    normal = a - b
                else:
                    normal = rng.standard_normal(sample.shape[1])
                norm = np.linalg.norm(normal)
                planes[t, k] = normal / norm if norm else normal
                side = sample[own] @ planes[t, k]
                cuts[t, k] = np.median(side) if len(own) else 0.0
                rows[2 * k + 1], rows[2 * k + 2] = own[side < cuts[t, k]], own[side >= cuts[t, k]]
        return cls(planes, cuts, depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.cuts)), np.int64)
        for t in range(len(self.cuts)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.planes[t][node]) >= self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def costs(self, q: np.ndarray) -> np.ndarray:
        """Violated margin of the way to each leaf, trees x leaves: ``probe`` opens leaves in this order."""
        margins = self.planes @ q - self.cuts
        out = np.zeros((len(self.cuts), 1))
        for d in range(self.depth):
            m = margins[:, (1 << d) - 1 : (2 << d) - 1]
            out = np.stack((out + np.where(m >= 0, m * m, 0), out + np.where(m < 0, m * m, 0)), axis=2).reshape(len(self.cuts), -1)
        return out

    def probe(self, q: np.ndarray, probes: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the leaves whose way there violates the least margin, over all trees at once."""
        margins = self.planes @ q - self.cuts
        first = (1 << self.depth) - 1
        queue, out = [(0.0, t, 0) for t in range(len(self.cuts))], []
        while queue and len(out) < probes:
            cost, t, node = heapq.heappop(queue)
            while node < first:
                m = margins[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (cost + m * m, t, far))
                node = near
            out.append((t, node - first))
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lifted(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    """Vectors with one more coordinate that makes all lengths equal, so that near means large inner product."""
    last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, most - (x**2).sum(axis=1)))
    return np.concatenate((x, last[:, None]), axis=1)


def _exact(queries: np.ndarray, dim: int, k: int):
    """Rows (embedding) -> the task's k vectors of largest inner product for each query: (query, score, vector)."""

    def run(batches):
        score, near = np.full((len(queries), 0), 0.0), np.zeros((len(queries), 0, dim))
        for batch in batches:
            x = _matrix(batch.column("embedding"), dim)
            for c in range(0, len(x), 4096):
                own = x[c : c + 4096]
                s = queries @ own.T
                at = np.argpartition(-s, k - 1, axis=1)[:, :k] if s.shape[1] > k else np.tile(np.arange(s.shape[1]), (len(queries), 1))
                score, near = np.concatenate((score, np.take_along_axis(s, at, 1)), axis=1), np.concatenate((near, own[at]), axis=1)
                at = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, near = np.take_along_axis(score, at, 1), np.take_along_axis(near, at[:, :, None], 1)
        n = score.size
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(near.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(queries), dtype=np.int32), score.shape[1])), pa.array(score.reshape(-1)), flat], ["query", "score", "vector"])

    return run


def calibrated(index: DataFrame, forest: Forest, dim: int, most: float, k: int, recall: float) -> tuple[int, np.ndarray]:
    """(leaves to open, share of queries that open each leaf: trees x leaves).

    ``CALIBRATION`` vectors of the index (the smallest by hash) are queries whose true neighbours one exact scan
    of all vectors finds; the leaves to open are the fewest that hold ``recall`` of these neighbours.
    """
    held = index.orderBy(F.xxhash64(F.lit(7), "embedding"), "ids").limit(CALIBRATION).select("embedding").toPandas()["embedding"]
    queries = np.stack(held.to_list()).astype(np.float64)
    rows = index.select("embedding").mapInArrow(_exact(queries, dim, k + 1), "query int, score double, vector array<double>")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vector"))
    rows = rows.withColumn("n", best).where(F.col("n").between(2, k + 1)).toPandas()  # the first is the query itself
    lifted, costs, needed = _lifted(queries, most, True), [], [1]
    for q, own in rows.groupby("query"):
        cost = forest.costs(lifted[q])
        leaves = forest.leaves(_lifted(np.stack(own["vector"].to_list()), most, False))
        costs.append(cost)
        reached = cost[np.arange(leaves.shape[1]), leaves].min(axis=1)
        needed += np.searchsorted(np.sort(cost, axis=None), reached, "right").tolist()
    probes = int(np.sort(needed)[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)])
    opened = np.zeros(forest.planes.shape[:1] + (1 << forest.depth,))
    for cost in costs:
        opened.flat[np.argsort(cost, axis=None, kind="stable")[:probes]] += 1 / len(costs)
    return probes, opened


def _leaf_of(forest: Forest, dim: int, most: float):
    """Rows (embedding) -> (leaf, n): vectors of each leaf, leaves being numbered through all trees."""

    def run(batches):
        n = np.zeros(len(forest.cuts) << forest.depth, np.int64)
        for batch in batches:
            leaves = forest.leaves(_lifted(_matrix(batch.column("embedding"), dim), most, False))
            n += np.bincount((leaves + (np.arange(leaves.shape[1]) << forest.depth)).ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["leaf", "n"])

    return run


def _routed(forest: Forest, dim: int, most: float, probes: int, cuts: np.ndarray, shares: np.ndarray, every: int):
    """Rows (role, ids, embedding) -> rows by place: leaf, cut of its vectors and share of its queries, by the leaf's own numbers.

    A vector goes to its cut of its leaf in each tree, once for each share; a query to its share of the leaves that it opens, once for each cut.
    """

    def run(batches):
        for batch in batches:
            roles = batch.column("role").to_numpy()
            for role in (0, 1):
                part = batch.filter(pa.array(roles == role))
                if not len(part):
                    continue
                x = _matrix(part.column("embedding"), dim)
                lifted = _lifted(x, most, role == 1)
                first = part.column("ids").flatten().to_numpy()[part.column("ids").offsets.to_numpy()[:-1] - part.column("ids").offsets[0].as_py()]
                if role == 0:
                    leaf = forest.leaves(lifted)
                    row, leaf = np.repeat(np.arange(len(x)), leaf.shape[1]), (leaf + (np.arange(leaf.shape[1]) << forest.depth)).ravel()
                    own, step, times = first[row] % cuts[leaf], cuts[leaf], shares[leaf]
                else:
                    found = [(k, (t << forest.depth) + f) for k, q in enumerate(lifted) for t, f in forest.probe(q, probes)]
                    row, leaf = (np.array(c, np.int64) for c in zip(*found, strict=True))
                    own, step, times = first[row] // every % shares[leaf] * cuts[leaf], np.ones(len(row), np.int64), cuts[leaf]
                for k in range(int(times.max())):
                    at = np.flatnonzero(times > k)
                    for c in range(0, len(at), 4096):
                        some = at[c : c + 4096]
                        place, rows = (leaf[some] << 32) + own[some] + k * step[some], part.take(pa.array(row[some]))
                        yield pa.RecordBatch.from_arrays([pa.array(place), rows.column("role"), rows.column("ids"), rows.column("embedding")], ["place", "role", "ids", "embedding"])

    return run


def _reranked(dim: int, k: int):
    """Rows sorted by place, role (0 vectors, 1 queries) -> the k + 1 best vectors of the place for each query, by exact inner product.

    Only the vectors of a place are held; its queries are answered as they come.
    """

    def answered(ids, queries, x, y):
        rows: list[list] = [[], [], []]
        scores = y @ x.T
        for q, s in zip(queries, scores, strict=True):
            near = np.argpartition(-s, k)[: k + 1] if len(s) > k + 1 else np.arange(len(s))
            edge = s[near].min()
            near = np.flatnonzero(s >= edge) if len(s) > k + 1 else near
            best = sorted((-s[n], i) for n in near for i in ids[n])[: k + 1]
            rows[0] += [q] * len(best)
            rows[1] += [i for _, i in best]
            rows[2] += [-v for v, _ in best]
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.float64())], ["query_id", "vec_id", "score"])

    def run(batches):
        place, ids, vectors = None, [], []
        for batch in batches:
            places, roles = batch.column("place").to_numpy(), batch.column("role").to_numpy()
            mark = np.flatnonzero((np.diff(places) != 0) | (np.diff(roles) != 0)) + 1
            for a, b in zip([0, *mark.tolist()], [*mark.tolist(), len(places)], strict=True):
                if b == a:
                    continue
                if places[a] != place:
                    place, ids, vectors = places[a], [], []
                part = batch.slice(a, b - a)
                x = _matrix(part.column("embedding"), dim)
                if roles[a] == 0:
                    ids += part.column("ids").to_pylist()
                    vectors.append(x)
                elif vectors:
                    vectors = [np.concatenate(vectors)] if len(vectors) > 1 else vectors
                    queries = [i[0] for i in part.column("ids").to_pylist()]
                    for c in range(0, len(queries), 256):
                        yield answered(ids, queries[c : c + 256], vectors[0], x[c : c + 256])

    return run


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = 20, trees: int = TREES, recall: float = RECALL, exact: bool = False) -> DataFrame:
    """For each vector whose id is divisible by ``every``: its k nearest others found: query_id, rank, vec_id, score.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Equal vectors are
    indexed once, with the k + 1 smallest of their ids: no answer needs more, so this loses nothing.
    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
    part, nor do null ids; a vec_id that repeats with one vector counts once. Fewer candidates give fewer rows.
    How many leaves a query opens is measured on the table itself (``calibrated``), so that recall holds at any
    size; how much this examines depends on how clustered the vectors are. ``exact`` compares all instead.
    """
    work = Scratch(spark, "nearest")
    fit = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(fit)
    sizes = good.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(embedding, 0d, (a, x) -> a + double(x) * double(x))")).alias("most"))
    usual = sizes.orderBy(F.desc("n"), "dim").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, most = usual[0]["dim"], float(usual[0]["most"])
    good = good.where(F.size("embedding") == dim).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    # Smallest ids of equal vectors in two steps, so that a vector with very many rows is no single task's work.
    first = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("embedding", *by).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    same = first(first(good.dropDuplicates(["vec_id", "embedding"]), "salt"))
    index = work.save(same.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "index")
    n = index.count()
    wanted = max(LEAF_LEAST, min(LEAF_WANTED, n * LEAF_SHARE))
    depth = 0 if exact else max(0, min(DEPTH_MOST, round(math.log2(max(1, n / wanted))), int(math.log2(max(1, n / 4)))))
    sample = max(SAMPLE, SAMPLE_LEAF << depth)
    drawn = index.orderBy(F.xxhash64("embedding"), "ids").limit(sample).select("embedding").toPandas()["embedding"]
    forest = Forest.fit(_lifted(np.stack(drawn.to_list()).astype(np.float64), most, False), 1 if exact else trees, depth)
    probes, opened = (1, np.ones((1, 1))) if exact else calibrated(index, forest, dim, most, k, recall)
    sizes = np.zeros(len(forest.cuts) << depth, np.int64)
    for r in index.select("embedding").mapInArrow(_leaf_of(forest, dim, most), "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        sizes[r["leaf"]] = r["n"]
    cuts = np.maximum(1, -(-sizes // LEAF_MOST))
    queries = good.where(F.col("vec_id") % every == 0).select(F.lit(1).alias("role"), F.array("vec_id").alias("ids"), "embedding")
    # Shares are numbered by what opens a leaf among the calibration's queries, or by what does on average.
    likely = np.maximum(opened.ravel(), probes / len(sizes))
    shares = np.maximum(1, np.ceil(queries.count() * likely / QUERIES_MOST)).astype(np.int64)
    rows = queries.union(index.select(F.lit(0).alias("role"), "ids", "embedding"))
    element = good.schema["embedding"].dataType.simpleString()
    routed = rows.mapInArrow(_routed(forest, dim, most, probes, cuts, shares, every), f"place long, role int, ids array<long>, embedding {element}")
    found = routed.repartition("place").sortWithinPartitions("place", "role").mapInArrow(_reranked(dim, k), "query_id long, vec_id long, score double")
    found = found.where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

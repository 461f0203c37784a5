"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample and index every vector: a leaf gets the vectors that fall on its
side of each split. A query searches all trees through one priority queue of nodes, by the squared margins of
the splits on whose far side they lie, until the leaves it has opened hold enough vectors; what these leaves
hold is ranked by the exact distance. How many are enough is measured on the sample.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skinnyla.llm.common import batches, cut, release, table

#: With more vectors than the sample, those that are enough grow as this power of their number.
GROWTH = 0.9
#: Vectors of a cell, and queries that are compared with one copy of it.
CELL, QUERIES = 4096, 65536


class Tree:
    """A perfect binary tree; node i has the children 2i+1 and 2i+2, leaves are numbered from 0.

    A node's plane is, of several directions between two of its vectors, the one along which they spread most.
    """

    def __init__(self, sample: np.ndarray, depth: int, rng: np.random.Generator, directions: int = 16):
        self.depth, inner = depth, (1 << depth) - 1
        self.planes = rng.standard_normal((inner, sample.shape[1]))
        self.planes /= np.linalg.norm(self.planes, axis=1, keepdims=True)
        self.cuts = np.zeros(inner)
        held = {0: np.arange(len(sample))}
        for node in range(inner):
            own = held.pop(node)
            x = sample[own]
            if len(own) > 1:
                pair = rng.integers(0, len(own), (2, directions))
                along = x[pair[0]] - x[pair[1]]
                size = np.linalg.norm(along, axis=1)
                along = along[size > 0] / size[size > 0, None]
                if len(along):
                    self.planes[node] = along[(x @ along.T).var(axis=0).argmax()]
            side = x @ self.planes[node]
            self.cuts[node] = np.median(side) if len(own) else 0.0
            right = side > self.cuts[node]
            held[2 * node + 1], held[2 * node + 2] = own[~right], own[right]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.planes[at]) > self.cuts[at])
        return at - ((1 << self.depth) - 1)

    def costs(self, x: np.ndarray) -> np.ndarray:
        """The squared margins on the way to each leaf of the splits on whose far side it lies, a row for each of x."""
        margins, out = x @ self.planes.T - self.cuts, np.zeros((len(x), 1))
        for level in range(self.depth):
            m = margins[:, (1 << level) - 1 : (2 << level) - 1]
            right = m > 0
            out = np.stack([out + np.where(right, m * m, 0.0), out + np.where(right, 0.0, m * m)], axis=2).reshape(len(x), -1)
        return out


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.trees = [Tree(sample, depth, rng) for _ in range(trees)]

    def search(self, q: np.ndarray, sizes: np.ndarray, enough: float) -> list[tuple[int, int]]:
        """(tree, leaf) pairs in the order of the shared queue until the leaves hold enough vectors of the data."""
        inner = len(self.trees[0].cuts)
        margins = [(t.planes @ q - t.cuts).tolist() for t in self.trees]
        counts = sizes.tolist()
        queue = [(0.0, t, 0) for t in range(len(self.trees))]
        found, held = [], 0
        while queue and held < enough:
            far, t, node = heapq.heappop(queue)
            own = margins[t]
            while node < inner:
                m = own[node]
                near, other = (2 * node + 2, 2 * node + 1) if m > 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (far + m * m, t, other))
                node = near
            if n := counts[t][node - inner]:
                found.append((t, node - inner))
                held += n
        return found

    def calibrate(self, sample: np.ndarray, k: int, recall: float, queries: int, seed: int) -> int:
        """How many vectors of the sample the opened leaves hold when the share of true neighbours in them is the recall.

        The queue opens leaves in the order of their costs, and whole.
        """
        at = np.stack([t.leaves(sample) for t in self.trees])
        sizes = np.stack([np.bincount(x, minlength=len(self.trees[0].cuts) + 1) for x in at])
        asked = np.random.default_rng(seed).permutation(len(sample))[:queries]
        need, square = [], (sample * sample).sum(axis=1)
        for part in np.array_split(asked, max(1, len(asked) // 50)):
            costs = np.concatenate([t.costs(sample[part]) for t in self.trees], axis=1)
            for i, own in zip(part, costs, strict=True):
                far = square - 2 * (sample @ sample[i])
                far[i] = np.inf
                near = np.argpartition(far, min(k, len(far)) - 1)[:k]
                order = np.argsort(own, kind="stable")
                held = np.cumsum(sizes.ravel()[order])
                before = np.empty(len(order), np.int64)
                before[order] = held - sizes.ravel()[order]
                need.append(before.reshape(sizes.shape)[np.arange(len(at))[:, None], at[:, near[far[near] < np.inf]]].min(axis=0) + 1)
        need = np.sort(np.concatenate(need)) if need else np.zeros(0)
        return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) if len(need) else 1


def usable(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not all zero, of dims components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok & (F.size(vector) == dims if dims else F.lit(True)), F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest distinct ids, each with its smallest score; ties to the smaller id."""
    order = np.lexsort((ids, scores))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[order], scores[order]


class Ranking:
    """The nearest of what has been compared with each query."""

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def compare(self, x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, q: np.ndarray, query_ids: np.ndarray, opened: pa.Array) -> None:
        """Ranks for each query the vectors that lie in its opened leaves.

        A product of matrices gives distances that are right to rounding; all that may be among the nearest
        by them are measured again, exactly.
        """
        known, at = np.unique(leaf, return_inverse=True)
        square = (x * x).sum(axis=1)
        slack = 1e-9 * (square.max() + (q * q).sum(axis=1))
        rough = (q * q).sum(axis=1)[:, None] + square[None] - 2 * (q @ x.T)
        for i, query in enumerate(query_ids.tolist()):
            own = np.flatnonzero(np.isin(known, opened[i].values.to_numpy())[at])
            far = rough[i, own]
            have = self.best.get(query, (np.zeros(0, np.int64), np.zeros(0)))
            limit = have[1][-1] ** 2 if len(have[0]) == self.k else np.inf
            some = own[far <= limit + slack[i]]
            if len(some) > 2 * self.k:
                far = rough[i, some]
                few = some[far <= np.partition(far, self.k - 1)[self.k - 1] + slack[i]]
                some = few if len(np.unique(ids[few])) >= self.k else some  # rows that repeat an id
            if len(some):
                gap = x[some] - q[i]
                score = np.sqrt((gap * gap).sum(axis=1))
                self.best[query] = best_of(np.concatenate([have[0], ids[some]]), np.concatenate([have[1], score]), self.k)

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(np.array(list(self.best), np.int64), [len(x) for x, _ in self.best.values()])
        ids = [x for x, _ in self.best.values()] or [np.zeros(0, np.int64)]
        scores = [x for _, x in self.best.values()] or [np.zeros(0)]
        self.best = {}
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], names=["rep", "vec_id", "score"])


def without_crowds(v: DataFrame, k: int) -> DataFrame:
    """(vec_id, v) without those of equal vectors that come after the k smallest ids. Only crowds are shuffled whole."""
    crowds = cut(v.groupBy("h").count().where(F.col("count") > k).select("h"))
    place = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    few = v.join(crowds, "h", "left_semi").select("vec_id", "v", place.alias("place")).where(F.col("place") <= k)
    return v.join(crowds, "h", "left_anti").select("vec_id", "v").unionByName(few.select("vec_id", "v"))


def search(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = 4, leaf: int = 16, recall: float = 0.94, sample: int = 20_000, calibrate: int = 400, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found for each query row: query_id, rank, vec_id, score (Euclidean distance).

    sample: most vectors that the trees are fitted on (those with the smallest hash of their id); every
    vector is indexed. Leaves have about leaf vectors, more where the sample gives out. recall: the share of true
    neighbours in the sample that the leaves opened for so many of its vectors (calibrate) are to hold; more data
    than the sample needs as many more as the power GROWTH says. Subtrees with at most CELL vectors, or cells of
    larger ones, are compared in one go; queries bring the leaves they opened. Of equal
    vectors only the k + 1 smallest ids can be neighbours of anything, so only these are held, and equal
    queries are searched once. Vectors that are null, zero, hold null or non-finite components or have
    another number of components than most of the sample take no part. Rows that repeat an id count once,
    with the smallest distance. Ties go to the smaller id. Empty tables give empty results.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    kind = "array<float>" if vectors.select(F.col(vector_col)).dtypes[0][1] == "array<float>" else "array<double>"
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    v = v.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    total = v.count()
    if not total:
        return spark.createDataFrame([], schema)
    drawn = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    lengths = np.asarray(pc.list_value_length(drawn))
    dims = int(max(np.unique(lengths), key=lambda n: ((lengths == n).sum(), n)))
    v = v.where(F.size("v") == dims).withColumn("h", F.xxhash64("v"))
    held = without_crowds(v, k + 1)
    asked = v.where("q").groupBy("h", "v").agg(F.min("vec_id").alias("rep"))
    fit = np.unique(matrix(drawn.filter(pa.array(lengths == dims)), dims), axis=0)
    depth = max(0, min(int(np.log2(max(1, total / leaf))), int(np.log2(max(1, len(fit) / 8)))))
    forest = Forest(fit, trees, depth, seed)
    shared = spark.sparkContext.broadcast(forest)  # trees x 2^depth planes of the bounded sample

    def count(rows):
        sizes = np.zeros((trees, 1 << depth), np.int64)
        for b in batches(rows):
            x = matrix(b.column(0), dims)
            for t, tree in enumerate(shared.value.trees):
                sizes[t] += np.bincount(tree.leaves(x), minlength=1 << depth)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sizes.size)), pa.array(sizes.ravel())], names=["at", "n"])

    sizes = np.zeros(trees << depth, np.int64)  # bounded by the sample, as the trees are
    for r in held.select("v").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        sizes[r["at"]] = r["n"]
    sizes = sizes.reshape(trees, -1)
    n = int(sizes[0].sum())
    enough = forest.calibrate(fit, k, recall, calibrate, seed) * max(1.0, n / max(1, len(fit))) ** GROWTH
    up = min(depth, max(0, int(np.log2(max(1, CELL / max(1, n / (1 << depth)))))))  # levels of a subtree
    in_subtree = sizes.reshape(trees, -1, 1 << up).sum(axis=2)
    n_cells = np.maximum(1, -(-in_subtree // CELL))
    first_cell = (np.cumsum(n_cells) - n_cells.ravel()).reshape(n_cells.shape)
    copies = max(1, -(-asked.count() // QUERIES))
    plan = spark.sparkContext.broadcast((sizes, n_cells, first_cell))

    def hashed(ids: np.ndarray) -> np.ndarray:
        return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

    def batch(key: np.ndarray, ids: pa.Array, at: np.ndarray | None, opened: list | None, v: pa.Array) -> pa.RecordBatch:
        leaves = pa.nulls(len(key), pa.list_(pa.int32())) if opened is None else pa.array(opened, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), opened is not None)), ids, pa.nulls(len(key), pa.int32()) if at is None else pa.array(at.astype(np.int32)), leaves, v], names=["key", "q", "id", "leaf", "leaves", "v"])

    def index(rows):
        _, n_cells, first_cell = plan.value
        for b in batches(rows):
            x, ids = matrix(b.column(1), dims), b.column(0).to_numpy()
            for t, tree in enumerate(shared.value.trees):
                at = tree.leaves(x)
                cell = first_cell[t, at >> up] + hashed(ids) % n_cells[t, at >> up]
                for c in range(copies):
                    yield batch(cell * copies + c, b.column(0), at, None, b.column(1))

    def probe(rows):
        sizes, n_cells, first_cell = plan.value
        for b in batches(rows):
            x, ids = matrix(b.column(1), dims), b.column(0).to_numpy()
            copy, key, row, opened = hashed(ids) % copies, [], [], []
            for i, q in enumerate(x):
                own: dict[tuple[int, int], list[int]] = {}
                for t, at in shared.value.search(q, sizes, enough):
                    own.setdefault((t, at >> up), []).append(at)
                for (t, part), leaves in own.items():
                    cells = range(first_cell[t, part], first_cell[t, part] + n_cells[t, part])
                    key += [c * copies + copy[i] for c in cells]
                    row += [i] * len(cells)
                    opened += [leaves] * len(cells)
            row = pa.array(row, pa.int32())
            yield batch(np.array(key, np.int64), b.column(0).take(row), None, opened, b.column(1).take(row))

    def nearest(rows):
        ranking, key, parts = Ranking(k + 1), None, []
        for b in batches(rows):
            keys, q, ids = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            x, leaf = matrix(b.column(5), dims), b.column(3).fill_null(-1).to_numpy()
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)] if len(keys) else []
            start = 0
            for end in map(int, ends):
                if keys[start] != key:
                    key, parts = keys[start], []
                split = start + int((~q[start:end]).sum())  # a cell's vectors come before its queries
                if split > start:
                    parts.append((x[start:split], ids[start:split], leaf[start:split]))
                if split < end and parts:
                    parts = [tuple(np.concatenate(c) for c in zip(*parts, strict=True))]
                    for s in range(split, end, 256):
                        e = min(end, s + 256)
                        ranking.compare(*parts[0], x[s:e], ids[s:e], b.column(4).slice(s, e - s))
                start = end
            if len(ranking.best) > 50_000:
                yield ranking.rows()
        yield ranking.rows()
        release()

    columns = f"key long, q boolean, id long, leaf int, leaves array<int>, v {kind}"
    both = held.mapInArrow(index, columns).unionByName(asked.select(F.col("rep").alias("vec_id"), "v").mapInArrow(probe, columns))
    found = both.repartition("key").sortWithinPartitions("key", "q").mapInArrow(nearest, "rep long, vec_id long, score double")
    best = found.groupBy("rep", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy("score", "vec_id"))).where(F.col("place") <= k + 1)
    every = v.where("q").select(F.col("vec_id").alias("query_id"), "h", "v").join(asked, ["h", "v"]).select("query_id", "rep").distinct()
    own = every.join(best.select("rep", "vec_id", "score"), "rep").where("query_id <> vec_id")
    own = own.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

import numpy as np
from pyspark.sql import functions as F

from skinnyla.llm import neighbours


def brute(rows, queries, k=10):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for i in queries:
        d = np.sqrt(((x - x[ids == i][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def grouped(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_query_finds_the_neighbours(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0])
    got = grouped(neighbours.query(spark, sf))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q in want:
        assert len(got[q]) == 10 and got[q] == sorted(got[q], key=lambda x: (x[1], x[0]))


def test_forest_prunes_and_still_finds(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16)) * 5
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = grouped(neighbours.search(df, F.col("vec_id") % 100 == 0))
    assert recall(got, brute(rows, range(0, 4000, 100))) >= 0.9


def share_opened(x, trees=4, leaf=16, recall=0.93, queries=60):
    """The share of distinct vectors in the leaves opened for a query, and the recall, without Spark."""
    depth = int(np.log2(len(x) / leaf))
    forest = neighbours.Forest(x, trees, depth, 11)
    at = np.stack([t.leaves(x) for t in forest.trees])
    sizes = np.stack([np.bincount(a, minlength=1 << depth) for a in at])
    enough, opened, hit = forest.calibrate(x, 10, recall, 200, 11), [], []
    for i in range(queries):
        have = np.zeros(len(x), bool)
        for t, n in forest.search(x[i], sizes, enough):
            have |= at[t] == n
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        opened.append(have.mean())
        hit.append(have[np.argsort(far)[:10]].mean())
    return np.mean(opened), np.mean(hit)


def test_the_forest_decides_what_is_ranked(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24)) * 4
    opened, hit = share_opened(centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 24)))
    assert opened < 0.15 and hit >= 0.85
    for sf, most in (("sf0.01", 0.8), ("sf0.1", 0.7)):
        x = np.array([r.embedding for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("embedding").collect()], float)
        opened, hit = share_opened(np.unique(x, axis=0))
        assert opened < most and hit >= 0.85, (sf, opened, hit)


def test_queue_opens_leaves_by_their_cost():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 6))
    forest = neighbours.Forest(x, 3, 4, 1)
    for q in rng.normal(size=(10, 6)):
        costs = []
        for t, tree in enumerate(forest.trees):
            for leaf in range(16):
                node, cost = leaf + 15, 0.0
                while node:
                    up = (node - 1) // 2
                    m = tree.planes[up] @ q - tree.cuts[up]
                    cost += m * m if (m > 0) != (node == 2 * up + 2) else 0.0
                    node = up
                costs.append((cost, t, leaf))
            assert np.allclose(tree.costs(q[None])[0], [c for c, _, _ in costs[-16:]])
        order = forest.search(q, np.ones((3, 16), int), np.inf)
        want = {(t, leaf): c for c, t, leaf in costs}
        assert len(order) == 48 and np.all(np.diff([want[x] for x in order]) >= -1e-12)


def test_cells_and_copies(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(1500, 5)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    monkeypatch.setattr(neighbours, "CELL", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    got = grouped(neighbours.search(df, F.col("vec_id") % 10 == 0, recall=0.999))
    assert recall(got, brute(rows, range(0, 1500, 10))) >= 0.98


def test_equal_vectors_and_odd_rows(spark):
    one, nan = [1.0, 2.0, 3.0], float("nan")
    rows = [(i, one, "x") for i in range(900)] + [(1000 + i, [float(i), 1.0, 0.5], "x") for i in range(100)]
    rows += [(2000, None, "n"), (2100, [0.0, 0.0, 0.0], "z"), (2200, [nan, 1.0, 1.0], "n"), (2300, [1.0, None, 1.0], "n"), (2400, [1.0, 2.0], "d"), (2500, [float("inf"), 1.0, 1.0], "i"), (None, one, "id"), (7, one, "again"), (2600, [], "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").withColumn("score", F.lit(1))
    got = grouped(neighbours.search(df, F.col("vec_id") % 100 == 0, leaf=16))
    assert set(got) == {*range(0, 900, 100), 1000}
    assert got[0] == [(i, 0.0) for i in range(1, 11)] and got[300] == [(i, 0.0) for i in range(10)]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0
    few = grouped(neighbours.search(df.where("vec_id in (5, 6, 1000)"), F.lit(True)))
    assert {q: [i for i, _ in x] for q, x in few.items()} == {5: [6, 1000], 6: [5, 1000], 1000: [5, 6]}

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skinnyla.llm import near_duplicates as nd
from skinnyla.llm.components import connected_components

WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def grams(text, n=5):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows):
    """{index: (class id, links)} by comparing all pairs that share an n-gram."""
    sets = [grams(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    parent, links = list(range(len(rows))), [set() for _ in rows]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = [{j for g in s for j in where[g]} for s in sets]
    for i, (_, t) in enumerate(rows):
        for j in near[i] if sets[i] else [j for j, (_, u) in enumerate(rows) if not sets[j] and (u or "") == (t or "")]:
            if i != j and (not sets[i] or len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])):
                links[i].add(j)
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {i: (least[root(i)], len(links[i])) for i in range(len(rows))}


def test_shingles_equal_plain_ones():
    rng = random.Random(1)
    texts = [None, "", "a", "A b", "one two three four", "x, y. z-w v"] + [" ".join(rng.choice(["aa", "B", "ç", "dd", "1"]) + rng.choice(["", ",", " -"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    sh, upto = nd.shingles(pa.array(texts), 5)
    for t, s, e in zip(texts, upto[:-1], upto[1:], strict=True):
        assert len(set(sh[s:e].tolist())) == len(grams(t))
    a, ua = nd.shingles(pa.array(["x one two three four five", "One  TWO three four; five"]), 5)
    assert a[1] == a[2] and ua.tolist() == [0, 2, 3]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want = {rows[i][0]: x for i, x in brute(rows).items()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.query(spark, sf).collect()}
    assert got == want and sum(n > 0 for _, n in got.values()) > 50


def test_large_family_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(100)]
    monkeypatch.setattr(nd, "BLOCK", (32, 64))
    monkeypatch.setattr(nd, "BUCKET", 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.join(docs).collect()}
    assert got == {rows[i][0]: x for i, x in brute(rows).items()}


def test_odd_rows(odd, none):
    got = [tuple(r) for r in nd.join(odd).collect()]
    assert len(got) == 9
    by = {}
    for d, c, n in got:
        by.setdefault(d, []).append((c, n))
    assert by[1] == by[2] == [(1, 1)] and by[4] == [(4, 2)] * 2 and by[5] == [(4, 2)]
    assert by[3] == [(3, 0)] and by[7] == [(7, 0)] and by[None][0][0] < -(1 << 62)
    assert nd.join(none).count() == 0
    kept = nd.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 6, 7]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 300), (300, 250)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), **dict.fromkeys((200, 250, 300), 200)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_prefixes_are_shortened_until_the_recall():
    miss = lambda s, lengths: np.prod([1 - s**d for d in lengths])
    for s, recall in ((0.8, 0.9999), (0.8, 0.9), (0.86, 0.9999), (0.5, 0.99)):
        out = nd.prefix_lengths(s, recall)
        assert miss(s, out) <= 1 - recall and max(out) - min(out) <= 1
        k = max(i for i, d in enumerate(out) if d == min(out))
        assert max(out) == nd.DEEPEST or miss(s, [*out[:k], out[k] + 1, *out[k + 1 :]]) > 1 - recall
    assert nd.prefix_lengths(1.0, 0.9) == [nd.DEEPEST] * nd.TREES


def test_attainable_similarities():
    for n in range(1, 40):
        every = [Fraction(i, n + m - i) for m in range(1, 60) for i in range(1, min(n, m) + 1) if (i, m) != (n, n)]
        assert nd.attainable(n, nd.THRESHOLD) == min((s for s in every if s >= nd.THRESHOLD), default=None)


def test_forest_connects_what_the_matrix_connects():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = np.arange(rng.integers(1, 12)), 100 + np.arange(rng.integers(1, 12))
        links = rng.random((len(a), len(b))) < 0.15
        label = {int(x): int(x) for x in [*a, *b]}

        def merged(pairs):
            out = dict(label)
            for x, y in pairs:
                keep, gone = sorted((out[int(x)], out[int(y)]))
                out = {k: keep if v == gone else v for k, v in out.items()}
            return out

        assert merged(zip(*nd.forest(a, b, links), strict=True)) == merged((a[i], b[j]) for i, j in zip(*np.nonzero(links), strict=True))


def test_filter_keeps_all_members(spark):
    docs = spark.range(5000).select(F.col("id").alias("node"), F.lit("x").alias("text"))
    kept = {r.node for r in nd.likely_among(docs, docs.where("node % 10 = 3").select("node")).collect()}
    assert set(range(3, 5000, 10)) <= kept and len(kept) < 600
    assert nd.likely_among(docs, docs.limit(0).select("node")).count() == 0


def test_short_texts(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        w = [f"s{i}x{j}" for j in range(rng.randint(1, 30))]
        rows.append((3 * i, " ".join(w)))
        rows += [(3 * i + 1, " ".join(w[: max(1, len(w) - 1)])), (3 * i + 2, " ".join([*w, "more"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.class_id, r.n_links) for r in nd.join(docs).collect()} == {rows[i][0]: x for i, x in brute(rows).items()}

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skinnyla.llm import mixing

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x20\x09-\x0d]+")


def wanted_targets(sizes):
    """Repeated resharing, as the contract says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (left - sum(2 * sizes[s] for s in capped)) / max(1e-12, sum(weight[s] for s in free))
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else weight[s] * level for s in order}
        capped |= over


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    got = mixing.query(spark, SF).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        assert r.size == len(WORD.findall(rows[r.doc_id].text or "")) and 0 <= r.taken <= 2 * r.size
        sizes[rows[r.doc_id].source] = sizes.get(rows[r.doc_id].source, 0) + r.size
    want, have = wanted_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s = rows[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        have[s] += r.taken
    assert all(abs(have[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.query(spark, SF).collect()))


def test_odd_sources(spark):
    rows = [(i, "w " * (i % 50), [None, "", "a", "b"][min(3, i % 7)]) for i in range(600)] + [(700, None, "empty"), (701, "", "empty"), (None, "one two", "a"), (5, "x y z", "b"), (5, "x y z", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("block", F.lit(1))
    got = mixing.taken(docs, block_docs=8).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = wanted_targets(sizes)
    assert sum(r.taken for r in got) == pytest.approx(sum(want.values()), abs=8)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns
    by = {r.source: r.n for r in mix.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    assert all(abs(by.get(s, 0) - want[s]) <= 2 for s in sizes)


def test_shards_get_what_the_tree_deals(spark):
    """Every draw of a block is in one shard, in the run that the tree gave it, and the blocks' words add up to the taken ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sized, draws, parts, _ = mixing.plan(docs, block_docs=8)
    sizes = {}
    for r in sized.collect():
        sizes.setdefault((r.src, r.block), []).append((r.size, r.key))
    part = {r.key: r.part for r in parts.collect()}
    by_shard, drawn, words = {}, set(), 0
    for r in draws.collect():
        assert (r.src, r.block, r["pass"]) not in drawn
        drawn.add((r.src, r.block, r["pass"]))
        by_shard[r.shard] = by_shard.get(r.shard, 0) + 1
        words += sum(size if r.whole else part.get(key, 0) for size, key in sizes[r.src, r.block])
    assert len(by_shard) == 32 and max(by_shard.values()) - min(by_shard.values()) <= 1
    quotas = {}
    for src, _, _ in drawn:
        quotas[src] = quotas.get(src, 0) + 1
    tree = mixing.split_tree(spark.createDataFrame(sorted(quotas.items()), "src string, draws long"), 5, 7).collect()
    assert {(r.src, r.shard): r.draws for r in tree} == {(r.src, r.shard): r.n for r in draws.groupBy("src", "shard").agg(F.count("*").alias("n")).collect()}
    got = mixing.taken(docs, block_docs=8).collect()
    assert sum(r.taken for r in got) == words
    shards = {r.key: 0 for r in sized.collect()}
    assert len(shards) and all((r.taken > 0) <= bool(r.shards) for r in got)
    assert {x for r in mixing.query(spark, SF).collect() for x in r.shards.split(",") if x} == {str(x) for x in range(32)}


def test_blocks_in_order(spark):
    rows = [(f"s{i % 3}", i, 1 + i * 7 % 11) for i in range(500)]
    got = mixing.in_order(spark.createDataFrame(rows, "src string, block long, words long"), 3, 16)
    at = {(r.src, r.block): r["at"] for r in got.select("src", "block", F.xxhash64(F.lit(3), "src", "block").alias("at")).collect()}
    for src in ("s0", "s1", "s2"):
        mine = sorted((r for r in got.collect() if r.src == src), key=lambda r: (at[r.src, r.block], r.block))
        upto = 0
        for k, r in enumerate(mine):
            upto += r.words
            assert (r["rank"], r.upto, r.n_blocks) == (k, upto, len(mine))


def test_empty(spark, none):
    assert mixing.taken(none).count() == 0 and mixing.mixed(none).count() == 0


def test_splitting_tree_deals_all_draws(spark):
    quotas = spark.createDataFrame([("sa", 1000), ("sb", 37), ("sc", 1), ("t", 0)], "src string, draws long")
    got = mixing.split_tree(quotas, 4, 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.src, []).append((r["from"], r.draws))
    for src, n in (("sa", 1000), ("sb", 37), ("sc", 1)):
        at = 0
        for start, k in sorted(by[src]):
            assert start == at
            at += k
        assert at == n
    totals = {}
    for r in got:
        totals[r.shard] = totals.get(r.shard, 0) + r.draws
    assert len(totals) == 16 and max(totals.values()) - min(totals.values()) <= 1


def test_hypergeometric_has_its_mean_and_variance(spark):
    for n, k, d in ((50, 20, 10), (1000, 300, 500), (7, 7, 3), (9, 0, 4), (100000, 50000, 50000), (5, 2, 5)):
        u = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
        x = np.array([r.x for r in u.select(mixing.hypergeometric(F.lit(n).cast("long"), F.lit(k).cast("long"), F.lit(d).cast("long"), F.col("u")).alias("x")).collect()])
        assert x.min() >= max(0, d - (n - k)) and x.max() <= min(k, d)
        assert x.mean() == pytest.approx(d * k / n, abs=0.02 + 1e-4 * d * k / n)
        assert x.var() == pytest.approx(d * k / n * (1 - k / n) * (n - d) / max(1, n - 1), rel=0.02, abs=0.02)


def test_no_python_in_the_plan(spark, sf):
    plan = mixing.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

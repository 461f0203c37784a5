"""Mixing sources to target weights with DataFrame functions only.

Targets are shares of the words of all documents, capped at a number of repeats of a source; what is
over a cap is shared again by weight. A source's documents are dealt to blocks by hash, and its quota is
so many block draws: whole passes over its blocks, then blocks in permuted order until the target. A
splitting tree deals the quotas to output shards: a node's left half gets a multivariate hypergeometric
share of them. Each shard draws its own run of a source's permuted blocks, and is shuffled in itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skinnyla.llm.common import cut, table, unused

# Fixed value: what is no word character.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def source_key(source: Column) -> Column:
    """Never null; sorts by the source's code points, null last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("t"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source_size, target) from (src, source_size), a row for each source.

    Sources in their order get the weights in turn. The targets add up to share of all sizes, but none is
    above most times its source's size: with sources ordered by size over weight, those up to some place
    are capped and the others share the rest by weight. There are few sources beside documents; their
    table is ordered as one.
    """
    whole = Window.partitionBy()
    place = F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(weights)))
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * most)
    by = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    capped = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * share - capped) / weight)  # a unit of weight's, if those before are capped
    opens = F.when(F.col("weight") * F.col("level") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))
    s = s.withColumn("level", F.min(opens).over(whole)["level"])
    return s.select("src", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), "cap").alias("target"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(x: Column) -> Column:
    """ln x! for x >= 0 by Stirling's series, shifted by 8."""
    y = x + 9.0
    rising = F.lit(1.0)
    for k in range(1, 9):
        rising = rising * (x + float(k))
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(rising)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many good ones are among those drawn from total, by inversion at u from the mode outwards.

    The steps go far beyond what a double of u can reach (14 standard deviations); they cut off no result.
    """
    n, k, d = (x.cast("double") for x in (total, good, drawn))
    args = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), F.greatest(F.lit(0.0), d - (n - k)).alias("low"), F.least(k, d).alias("high"), u.alias("u"))

    def with_args(a: Column) -> Column:
        mode = F.least(a["high"], F.greatest(a["low"], F.floor((a["d"] + 1) * (a["k"] + 1) / (a["n"] + 2)).cast("double")))
        return let(mode, lambda m: with_mode(a, m))

    def with_mode(a: Column, m: Column) -> Column:
        n, k, d = a["n"], a["k"], a["d"]
        parts = [(1, k), (-1, m), (-1, k - m), (1, n - k), (-1, d - m), (-1, n - k - d + m), (-1, n), (1, d), (1, n - d)]
        logs = F.transform(F.array(*[x for _, x in parts]), log_factorial)
        signs = F.array(*[F.lit(float(sign)) for sign, _ in parts])
        p = F.exp(F.aggregate(F.zip_with(logs, signs, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x))
        return let(p, lambda at_mode: with_p(a, m, at_mode))

    def with_p(a: Column, m: Column, at_mode: Column) -> Column:
        n, k, d, low, high, u = (a[x] for x in ("n", "k", "d", "low", "high", "u"))
        deviation = F.sqrt(F.greatest(F.lit(0.0), d * (k / n) * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0))))
        steps = F.least(high - low, F.ceil(deviation * 14) + 16).cast("int")

        def step(s: Column, _: Column) -> Column:
            up, down = s["up"], s["down"]
            up_p = F.when(up < high, s["up_p"] * (k - up) * (d - up) / ((up + 1) * (n - k - d + up + 1))).otherwise(0.0)
            down_p = F.when(down > low, s["down_p"] * down * (n - k - d + down) / ((k - down + 1) * (d - down + 1))).otherwise(0.0)
            return let(F.struct(up_p.alias("up_p"), down_p.alias("down_p")), lambda p: after(s, p))

        def after(s: Column, p: Column) -> Column:
            left = s["left"] - p["up_p"]
            x = F.when(s["x"].isNotNull(), s["x"]).when(left < 0, s["up"] + 1).when(left - p["down_p"] < 0, s["down"] - 1)
            return F.struct(F.least(s["up"] + 1, high).alias("up"), p["up_p"].alias("up_p"), F.greatest(s["down"] - 1, low).alias("down"), p["down_p"].alias("down_p"), (left - p["down_p"]).alias("left"), x.alias("x"))

        start = F.struct(m.alias("up"), at_mode.alias("up_p"), m.alias("down"), at_mode.alias("down_p"), (u - at_mode).alias("left"), F.when(u < at_mode, m).alias("x"))
        found = F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: F.coalesce(s["x"], m))
        return F.when(steps < 1, m).otherwise(found)

    return F.when(total <= 0, F.lit(0)).otherwise(let(args, with_args)).cast("long")


def unit(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(src, shard, from, draws): the run of each source's draws that a shard gets.

    quotas: (src, draws). Each level splits every node's capacity in half and deals the node's quotas
    to the halves, source by source. All draws are dealt, and shards' totals differ by one at most. Nodes are
    spread over tasks as there get to be many.
    """
    pair = F.struct("src", F.col("draws").cast("long").alias("draws"), F.lit(0).cast("long").alias("from"))
    node = quotas.agg(F.array_sort(F.collect_list(pair)).alias("own")).select(F.lit(0).cast("long").alias("node"), "own")
    for level in range(levels):
        count = F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["draws"])
        node = node.withColumn("n", count).withColumn("d", F.floor((F.col("n") + F.pmod("node", F.lit(2))) / 2).cast("long"))

        def dealt(level: int) -> Column:
            def step(a: Column, x: Column) -> Column:
                got = hypergeometric(a["n"], x["draws"], a["d"], unit(F.lit(seed), F.lit(level), F.col("node"), x["src"], x["from"]))
                return F.struct((a["n"] - x["draws"]).alias("n"), (a["d"] - got).alias("d"), F.concat(a["out"], F.array(got)).alias("out"))

            start = F.struct(F.col("n").alias("n"), F.col("d").alias("d"), F.array().cast("array<bigint>").alias("out"))
            return F.aggregate("own", start, step, lambda a: a["out"])

        node = node.withColumn("left", dealt(level))
        left = F.zip_with("own", "left", lambda x, g: F.struct(x["src"].alias("src"), g.alias("draws"), x["from"].alias("from")))
        right = F.zip_with("own", "left", lambda x, g: F.struct(x["src"].alias("src"), (x["draws"] - g).alias("draws"), (x["from"] + g).alias("from")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("own")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("own")))
        node = node.select(F.explode(halves).alias("half")).select("half.*")
        if level % 5 == 4 and level + 1 < levels:
            node = node.repartition(min(1024, 2 << level), "node")
    return node.select(F.col("node").alias("shard"), F.explode("own").alias("x")).select("x.src", "shard", "x.from", "x.draws").where("draws > 0")


def in_order(blocks: DataFrame, seed: int, runs: int = 1024) -> DataFrame:
    """blocks (src, block, words) with n_blocks of their source, and rank and words summed up to each in its permuted order.

    The order is that of a hash. Its range is cut into runs: sums are made over a source's runs and within a
    run, so no task orders all blocks of a source.
    """
    whole = Window.partitionBy("src")
    b = blocks.withColumn("at", F.xxhash64(F.lit(seed), "src", "block"))
    b = b.withColumn("run", F.shiftright("at", 64 - runs.bit_length() + 1))
    of_run = b.groupBy("src", "run").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    earlier = whole.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    of_run = of_run.select("src", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w_before"), F.sum("n").over(whole).alias("n_blocks"))
    inner = Window.partitionBy("src", "run").orderBy("at", "block")
    b = b.withColumn("place", F.row_number().over(inner) - 1).withColumn("within", F.sum("words").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return b.join(of_run, ["src", "run"]).select("src", "block", "words", (F.col("n_before") + F.col("place")).cast("long").alias("rank"), (F.col("w_before") + F.col("within")).alias("upto"), "n_blocks")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, block_docs: int = 256, shard_docs: int = 20_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_docs: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(sized, draws, parts, blocks): what the mix takes.

    sized: key, doc_id, src, block, size of every row, written so that texts are read once; draws: (src,
    block, pass, shard, whole), a row for each draw of a block; parts: (key, part), the words taken from
    documents of the one block of each source that is drawn in part.
    """
    n = docs.count() if n_docs is None else n_docs
    blocks = 1 << max(3, (max(1, n) // block_docs).bit_length())
    levels = max(5, (max(1, n) // shard_docs).bit_length())
    sized = cut(docs.select(*sized_columns(id_col, text_col, source_col, blocks, seed)))
    stats = cut(sized.groupBy("src", "block").agg(F.sum("size").alias("words")))
    aims = targets(stats.groupBy("src").agg(F.sum("words").alias("source_size")), weights, share, most)
    full = in_order(stats.where("words > 0"), seed).join(aims, "src")
    full = full.withColumn("passes", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    full = full.withColumn("rest", F.round("target").cast("long") - F.col("passes") * F.col("source_size"))
    full = full.withColumn("before", F.col("upto") - F.col("words")).withColumn("some", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    full = cut(full)
    passes = F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("some") > 0, 0).otherwise(1))
    passes = F.when((F.col("passes") > 0) | (F.col("some") > 0), passes).otherwise(F.array().cast("array<bigint>"))
    drawn = full.withColumn("pass", F.explode(passes))
    drawn = drawn.select("src", "block", "pass", (F.col("pass") * F.col("n_blocks") + F.col("rank")).alias("draw"), ((F.col("pass") < F.col("passes")) | (F.col("some") == F.col("words"))).alias("whole"))
    dealt = split_tree(drawn.groupBy("src").agg(F.count("*").alias("draws")), levels, seed)
    dealt = dealt.select("src", "shard", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("draws") - 1)).alias("draw"))
    draws = cut(drawn.join(dealt, ["src", "draw"]).select("src", "block", "pass", "shard", "whole"))
    edge = full.where("some > 0 and some < words").select("src", "block", "some")
    rows = sized.where("size > 0").join(edge, ["src", "block"]).groupBy("src", "key").agg(F.max("size").alias("size"), F.count("*").alias("copies"), F.first("some").alias("some"))
    run = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "key"), "key")
    total = F.col("size") * F.col("copies")
    left = F.col("some") - (F.sum(total).over(run.rowsBetween(Window.unboundedPreceding, 0)) - total)
    parts = rows.select("key", F.floor(F.greatest(F.lit(0), F.least(total, left)) / F.col("copies")).cast("long").alias("part"))
    return sized, draws, cut(parts), blocks


def sized_columns(id_col: str, text_col: str, source_col: str, blocks: int, seed: int) -> list[Column]:
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"), F.col(source_col).cast("string"))
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return [key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), source_key(F.col(source_col)).alias("src"), F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(blocks)).alias("block"), size.alias("size")]


def taken(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, **columns) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, and the shards that draw it.

    A null text has size 0; a null source is a source, the last one; null ids and repeated rows are rows
    like others (equal rows of a block that is drawn in part share its words). Words taken of a source
    are its target rounded, but for what such sharing rounds down. The same input gives the same mix.
    """
    sized, draws, parts, _ = plan(docs, weights, share, most, seed, **columns)
    aims = cut(targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, most))
    per_block = cut(draws.groupBy("src", "block").agg(F.count_if("whole").alias("times"), F.count_if(~F.col("whole")).alias("partial"), F.array_sort(F.collect_set("shard")).alias("shards")))
    out = sized.join(per_block, ["src", "block"], "left").join(parts, "key", "left").join(aims, "src", "left")
    words = F.coalesce(F.col("times"), F.lit(0)) * F.col("size") + F.coalesce(F.col("partial"), F.lit(0)) * F.coalesce(F.col("part"), F.lit(0))
    return out.select("doc_id", "size", "source_size", "target", words.cast("long").alias("taken"), "shards")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: docs' columns, a row for each draw of a document, dealt to shards and shuffled in them.

    A document drawn in part keeps its first words. Documents without words are never drawn.
    """
    _, draws, parts, blocks = plan(docs, weights, share, most, seed, id_col=id_col, text_col=text_col, source_col=source_col)
    own = unused(docs.columns)
    key, src, block, size, pass_, shard, whole, part, at = (F.col(f"{own}{c}") for c in ("key", "src", "block", "size", "pass", "shard", "whole", "part", "at"))
    made = sized_columns(id_col, text_col, source_col, blocks, seed)
    made = [made[k].alias(f"{own}{c}") for k, c in ((0, "key"), (2, "src"), (3, "block"), (4, "size"))]
    draws = draws.select(*[F.col(c).alias(f"{own}{c}") for c in ("src", "block", "pass", "shard", "whole")])
    parts = parts.select(F.col("key").alias(f"{own}key"), F.coalesce("part", F.lit(0)).alias(f"{own}part"))
    rows = docs.select("*", *made).where(size > 0).join(draws, [f"{own}src", f"{own}block"]).join(parts, f"{own}key", "left")
    words = F.filter(F.split(F.col(text_col).cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = F.coalesce(part, F.lit(0))
    rows = rows.where(whole | (some > 0))
    text = F.when(whole | (some >= size), F.col(text_col)).otherwise(F.array_join(F.slice(words, 1, F.greatest(some, F.lit(1)).cast("int")), " "))
    rows = rows.withColumn(f"{own}text", text).withColumn(f"{own}at", F.xxhash64(F.lit(seed), key, pass_))
    rows = rows.repartition(shard).sortWithinPartitions(shard, at)
    return rows.select(*[F.col(f"{own}text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir):
    shards = F.array_join(F.transform("shards", lambda x: x.cast("string")), ",")
    return taken(table(spark, sf_dir, "documents")).withColumn("shards", F.coalesce(shards, F.lit("")))

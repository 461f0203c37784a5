"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A document is the set of its word n-grams. Each tree of the forest is a sorted trie of the documents' MinHash
paths. A document starts with its whole path in every tree and shortens the prefix it has to share, tree after
tree, until the expected recall for it reaches the target: the least similarity above the threshold that a set
of its size can have at all decides how far it has to go, so small sets keep long prefixes and the smallest, which
are like no other set, are in no tree. A sketch of the whole signature drops candidates that are far from alike. What is left
forms families, in which all pairs are compared exactly, block by block, without a row for each pair: a task
counts the links of its documents and returns a forest of links. Classes are the components of links.
"""

from __future__ import annotations

from fractions import Fraction
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skinnyla.llm.common import batches, cut, release, table, unused, utf8_buffer
from skinnyla.llm.components import connected_components

WORDS = 5
THRESHOLD = Fraction(4, 5)
#: Tries, values of a path, and bits of a value behind the shortest prefix.
TREES, DEEPEST, BITS = 16, 5, 7
#: Functions whose low bytes make the sketch, and how many must agree: 0.8 less five standard deviations.
SKETCH, ALIKE = 64, 35
#: Most rows of a bucket, and of a chunk of a family (a family has eight until chunks are full), that a task compares.
BUCKET, BLOCK = 2048, (512, 2048)
#: Most bits of the filter that keeps texts without candidates from being shuffled.
FILTER_BITS = 1 << 26

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOW = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOW[0x41:0x5B] += np.uint64(32)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CONSTANTS = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | np.uint64(1)


def powers(base: np.uint64, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    if len(have := _kept.get(int(base), ())) < n:
        have = _kept[int(base)] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n + n // 4, base)]))
    return have[:n]


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the rows of a string column, one after another, and where rows begin and end.

    Words are runs of ASCII digits and letters, whatever the case, and of non-ASCII characters. A text of
    fewer words than n has one n-gram of all of them; a text without words has none.
    """
    raw, offsets = utf8_buffer(column)
    n = len(raw)
    word = WORD[raw]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(LOW[raw] * powers(BASE, n))])
        hashed = (prefix[last] - prefix[first]) * powers(INVERSE, n)[first] if len(first) else np.zeros(0, np.uint64)
        hashed = mix(hashed + (last - first).astype(np.uint64) * CONSTANTS[0])
        at = np.searchsorted(first, offsets)  # words before each row's end
        count = np.diff(at)
        grams = np.where(count >= words, count - words + 1, (count > 0).astype(count.dtype))
        upto = np.concatenate([[0], np.cumsum(grams)])
        start = np.repeat(at[:-1] - upto[:-1], grams) + np.arange(upto[-1])
        left = np.repeat(at[1:], grams) - start
        out = np.zeros(len(start), np.uint64)
        for k in range(words):
            here = left > k
            out[here] += hashed[start[here] + k] * CONSTANTS[1 + k]
        return mix(out), upto


def attainable(n: int, threshold: Fraction) -> Fraction | None:
    """The least similarity from the threshold on that a set of n can have with another set; None if there is none."""
    best = None
    for both in range(-(-threshold.numerator * n // threshold.denominator), n + 1):
        either = both * threshold.denominator // threshold.numerator
        if either >= n and (both < n or either > n):
            best = min(best or Fraction(1), Fraction(both, either))
    return best


def prefix_lengths(similarity: float, recall: float, trees: int = TREES, deepest: int = DEEPEST) -> list[int]:
    """Prefixes that two sets have to share in some tree, shortened one tree after another until the recall is reached."""
    out, k = [deepest] * trees, 0
    while prod(1 - similarity**d for d in out) > 1 - recall and max(out) > 1:
        out[k % trees] -= 1
        k += 1
    return out


KNOWN = 128  # sets up to this size have prefixes of their own


def prefix_table(threshold: Fraction, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """The shortest prefix of each tree, and for each size up to KNOWN how much longer it is (-1: in no tree)."""
    shortest = np.array(prefix_lengths(float(threshold), recall))
    longer = np.zeros((KNOWN + 1, TREES), np.int64)
    for n in range(KNOWN):
        s = attainable(n, threshold)
        longer[n] = np.array(prefix_lengths(float(s), recall)) - shortest if s is not None else -1
    return shortest, longer


SIGNED = "doc_id long, node long, h1 long, h2 long, n int, keys array<long>, rests array<int>, sketch binary"


def signatures(docs: DataFrame, words: int, threshold: Fraction, recall: float, id_col: str, text_col: str) -> DataFrame:
    """A row per row of docs: two hashes of its n-grams (of the text, if it has none), paths, sketch.

    A path is a key of the shortest prefix, and in rests the next values and, lowest, how many of them must agree.
    """
    functions = CONSTANTS[100 : 100 + TREES * DEEPEST]
    shortest, longer = prefix_table(threshold, recall)
    tree = np.arange(TREES)

    def paths(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.zeros((TREES, low.shape[1]), np.uint64)
        for d in range(shortest.max()):
            own = tree[shortest > d]
            keys[own] = mix(keys[own] + low[d * TREES + own] * CONSTANTS[60 + d] + (own + 1).astype(np.uint64)[:, None])
        rests = longer[np.minimum(size, KNOWN)].T.astype(np.int32)
        for d in range(shortest.min(), DEEPEST):
            own = tree[shortest <= d]
            place = 31 - BITS * (d - shortest[own] + 1)
            rests[own] |= (low[d * TREES + own] >> np.uint64(64 - BITS)).astype(np.int32) << place.astype(np.int32)[:, None]
        return keys, rests

    def run(rows):
        for b in batches(rows, 1 << 20):
            sh, upto = shingles(b.column(2), words)
            size = np.diff(upto)
            full = np.flatnonzero(size)
            cuts, n = upto[:-1][full], b.num_rows
            h = np.zeros((2, n), np.uint64)
            inside = longer[np.minimum(size, KNOWN), 0] >= 0  # sets that may be like another
            keys, rests, sketch = np.zeros((TREES, 0), np.uint64), np.zeros((TREES, 0), np.int32), []
            if len(full):
                with np.errstate(over="ignore"):
                    h[0, full] = np.add.reduceat(mix(sh ^ CONSTANTS[50]), cuts)
                    h[1, full] = np.add.reduceat(mix(sh + CONSTANTS[51]), cuts)
                    low = np.zeros((len(functions), len(full)), np.uint64)
                    for k, f in enumerate(functions):
                        low[k] = np.minimum.reduceat(sh * f, cuts)
                    low = mix(low[:, inside[full]])
                    keys, rests = paths(low, size[inside])
                sketch = np.ascontiguousarray((low[:SKETCH] & np.uint64(255)).astype(np.uint8).T)
            text_hash = b.column(3).to_numpy().view(np.uint64)
            h[0, size == 0] = mix(text_hash[size == 0])
            h[1, size == 0] = text_hash[size == 0]
            at = np.zeros(n + 1, np.int32)
            at[1:] = np.cumsum(inside * TREES)
            at, sketch = pa.array(at), iter(sketch)
            lists = [pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(x.T).ravel())) for x in (keys.view(np.int64), rests)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(h[0].view(np.int64)), pa.array(h[1].view(np.int64)), pa.array(size.astype(np.int32)), *lists, pa.array([next(sketch).tobytes() if x else None for x in inside], pa.binary())],
                names=["doc_id", "node", "h1", "h2", "n", "keys", "rests", "sketch"],
            )

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), node_of(id_col, text_col).alias("node"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"))
    return rows.mapInArrow(run, SIGNED)


def node_of(id_col: str, text_col: str) -> Column:
    """The id; where it is null, a number below -2^62 made of the text's hash."""
    other = F.lit(-(1 << 62)) - F.pmod(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(1 << 61))
    return F.coalesce(F.col(id_col).cast("long"), other)


def runs(rows, columns: int):
    """Groups of consecutive rows that agree in the first columns; a group may come in several batches."""
    tail = None
    for b in rows:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([tail, t]).combine_chunks() if tail is not None else t
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for c in range(columns):
            x = t.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        at = np.concatenate([[0], np.flatnonzero(change) + 1])
        yield t, at[:-1], at[1:]
        tail = t.slice(int(at[-1]))
    if tail is not None:
        yield tail, np.array([0]), np.array([tail.num_rows])
    del tail
    release()


def forest(a: np.ndarray, b: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the nodes a (rows) and b (columns) that connect what the matrix connects, as few as that takes."""
    label, none = np.arange(len(a), dtype=np.int32), np.int32(len(a))
    while True:
        down = np.where(links, label[:, None], none).min(axis=0)
        new = np.minimum(label, np.where(links, down[None, :], none).min(axis=1))
        if (new == label).all():
            break
        label = new
    mine, other = label != np.arange(len(a)), down < none
    return np.concatenate([a[mine], b[other]]), np.concatenate([a[label[mine]], a[down[other]]])


def chunked(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """rows with chunk and pair: a group of m chunks is dealt to a task for each two of them.

    sizes: (key, m) of the groups with m > 1. Every two rows of a group meet in a task.
    """
    rows = rows.join(sizes, key, "left").withColumn("m", F.coalesce("m", F.lit(1)))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("m").cast("int") - 1))
    rows = rows.withColumn("other", other)
    return rows.withColumn("pair", (F.least("chunk", "other") * F.col("m") + F.greatest("chunk", "other")).cast("long")).drop("other", "m")


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether paths with the same key share as many of the next values as both have to."""
    differ, out = (x ^ y) >> 3, np.zeros(np.broadcast(x, y).shape, bool)
    need = np.maximum(x & 7, y & 7)
    for k in range(5):
        out |= (need == k) & (differ >> (28 - BITS * k) == 0)
    return out


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b): for the documents that share a prefix and whose sketches are alike, enough edges to connect them.

    The rows of a task are its tries' leaves in order: of a key, then of the values behind it.
    """

    def run(rows):
        for t, start, stop in runs(rows, 2):
            many = np.flatnonzero(stop - start > 1)
            if not len(many):
                continue
            node, rest = t.column("node").to_numpy(), t.column("rest").to_numpy()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            a, b = [], []
            two = many[stop[many] - start[many] == 2]
            i = start[two]
            i = i[agreeing(rest[i], rest[i + 1])]
            i = i[(sketch[i] == sketch[i + 1]).sum(axis=1) >= ALIKE]
            a.append(node[i])
            b.append(node[i + 1])
            for g in many[stop[many] - start[many] > 2]:
                s, own, r = sketch[start[g] : stop[g]], node[start[g] : stop[g]], rest[start[g] : stop[g]]
                links = np.zeros((len(s), len(s)), bool)
                step = max(1, 4_000_000 // (len(s) * SKETCH))
                for k in range(0, len(s), step):
                    links[k : k + step] = (s[k : k + step, None] == s[None]).sum(axis=2, dtype=np.uint8) >= ALIKE
                links &= agreeing(r[:, None], r[None])
                x, y = forest(own, own, links)
                a.append(x)
                b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    rows = reps.where("sketch is not null").select(F.explode(F.arrays_zip("keys", "rests")).alias("path"), "node", "sketch")
    rows = rows.select(F.col("path.keys").alias("key"), F.col("path.rests").alias("rest"), "node", "sketch")
    big = cut(rows.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.ceil(F.col("count") / (BUCKET // 2)).cast("int").alias("m")))
    rows = chunked(rows, "key", big).select("key", "pair", "rest", "node", "sketch")
    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair", "rest").mapInArrow(run, "a long, b long").where("a <> b")


def compare(t: pa.Table, threshold: Fraction):
    """(node, links, a, b) of the rows of one block: links counted across its two chunks, and a forest of them."""
    node, chunk, copies = (t.column(c).to_numpy() for c in ("node", "chunk", "copies"))
    sets = [np.frombuffer(x, np.uint64) for x in t.column("grams").to_pylist()]
    size = np.array([len(x) for x in sets])
    g = len(sets)
    left = np.flatnonzero(chunk == chunk.min())
    right = np.flatnonzero(chunk == chunk.max())
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(g), size)
    place = np.cumsum(n > 1) - 1
    shared = n[at] > 1
    row, at = row[shared], place[at[shared]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = int(at[-1]) + 1 if len(at) else 0
    step = min(max(256, 8_000_000 // g), max(1, width))
    for k in range(0, width, step):
        lo, hi = np.searchsorted(at, [k, k + step])
        x = np.zeros((g, step), np.float32)
        x[row[lo:hi], at[lo:hi] - k] = 1
        both += x[left] @ x[right].T
    links = np.zeros(both.shape, bool)
    for k in range(0, len(left), 256):
        same = both[k : k + 256].astype(np.int64)
        links[k : k + 256] = same * threshold.denominator >= threshold.numerator * (size[left[k : k + 256], None] + size[right][None] - same)
    links &= node[left][:, None] != node[right][None]
    count = np.zeros(g, np.int64)
    count[left] = links @ copies[right]
    if chunk.min() != chunk.max():
        count[right] = links.T @ copies[left]
    return node, count, *forest(node[left], node[right], links)


def filter_of(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter (4 places of 16 bits for each) of the nodes; its size is bounded by FILTER_BITS.

    Beyond that it lets more through, which the join that follows sorts out.
    """
    bits = min(FILTER_BITS, 1 << max(16, (16 * nodes.count()).bit_length()))
    place = F.explode(F.array(*[F.pmod(F.xxhash64("node", F.lit(k)), F.lit(bits)) for k in range(4)])).alias("place")
    words = nodes.select(place).groupBy(F.shiftright("place", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def likely_among(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of docs (node, text) whose node is in nodes, and few others, found without a shuffle."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(filter_of(nodes))  # FILTER_BITS at the most
    places = docs.select("node", "text", F.array(*[F.xxhash64("node", F.lit(k)) for k in range(4)]).alias("places"))

    def run(rows):
        bits = held.value
        for b in rows:
            at = b.column(2).flatten().to_numpy().reshape(-1, 4) & (len(bits) * 64 - 1)
            have = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            keep = np.flatnonzero(have.all(axis=1))
            if len(keep):
                yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(keep)) for i in (0, 1)], names=["node", "text"])

    return places.mapInArrow(run, "node long, text string")


def verified_links(docs: DataFrame, families: DataFrame, words: int, threshold: Fraction, id_col: str, text_col: str) -> DataFrame:
    """(a, b, n): rows with b are links that connect the classes, rows without are counts of links.

    families: (node, label, copies, n) of the candidates. Their texts are read again, as n-grams of all
    documents would be far more than those of the candidates; a filter keeps the other texts where they are. The
    join is a merge of shuffled candidates at any size. A family of N rows is dealt in chunks, eight of them until
    a chunk is full, and each chunk is sent to as many tasks as there are chunks.
    """
    small, large = BLOCK
    sizes = families.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    block = F.greatest(F.lit(small), F.least(F.lit(large), F.col("rows") / 8))
    m = F.greatest(F.ceil(F.col("rows") / block), F.ceil(F.col("grams") * 8 / (16 << 20))).cast("int")
    sizes = cut(sizes.select("label", m.alias("m")).where("m > 1"))

    def sets(rows):
        for b in batches(rows, 1 << 20):
            sh, upto = shingles(b.column(3), words)
            grams = [np.unique(sh[s:e]).tobytes() for s, e in zip(upto[:-1], upto[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(grams, pa.binary())], names=["label", "node", "copies", "grams"])

    def verify(rows):
        for t, start, stop in runs(rows, 2):
            a, b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            none = []
            for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                own = t.slice(s, e - s)
                if e - s > 1:
                    node, count, x, y = compare(own, threshold)
                    some = count > 0
                    a += [node[some], x]
                    b += [np.zeros(some.sum(), np.int64), y]
                    n += [count[some], np.zeros(len(x), np.int64)]
                    none += [np.ones(some.sum(), bool), np.zeros(len(x), bool)]
            if none:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b), mask=np.concatenate(none)), pa.array(np.concatenate(n))], names=["a", "b", "n"])

    text = docs.select(node_of(id_col, text_col).alias("node"), F.col(text_col).cast("string").alias("text"))
    found = likely_among(text, families.select("node")).join(families.select("node", "label", "copies").hint("merge"), "node").select("label", "node", "copies", "text")
    found = found.mapInArrow(sets, "label long, node long, copies long, grams binary")
    found = chunked(found, "label", sizes).select("label", "pair", "node", "chunk", "copies", "grams")
    return found.repartition("label", "pair").sortWithinPartitions("label", "pair", "node").mapInArrow(verify, "a long, b long, n long")


def classes(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(signed rows of docs, (h1, h2, class_id, n_links) of each distinct text)."""
    signed = cut(signatures(docs, words, threshold, recall, id_col, text_col))
    reps = signed.groupBy("h1", "h2").agg(F.min("node").alias("node"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("rests").alias("rests"), F.first("sketch").alias("sketch"))
    reps = cut(reps)
    families = connected_components(candidate_edges(reps))
    of = reps.groupBy("node").agg(F.max("copies").alias("copies"), F.sum("n").alias("n"))
    families = cut(families.join(of, "node"))
    links = cut(verified_links(docs, families, words, threshold, id_col, text_col))
    degree = cut(links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links")))
    label = connected_components(links.where("b is not null").select("a", "b"))
    table_ = reps.select("h1", "h2", "node", "copies").join(degree, "node", "left").join(label, "node", "left")
    return signed, cut(table_.select("h1", "h2", F.coalesce("label", "node").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))


def join(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links.

    n_links: how many other rows have a Jaccard similarity of word n-grams of at least the threshold, copies
    included. class_id: the smallest id among the rows that links connect. A text without words is alike
    to equal texts only (null is empty). Rows that repeat an id are one document; rows with a null id
    are told by their texts, and where all of a class have none, its id is a number below -2^62. Other
    columns are not read.
    """
    signed, known = classes(docs, words, threshold, recall, id_col, text_col)
    return signed.select("doc_id", "h1", "h2").join(known, ["h1", "h2"]).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, words: int = WORDS, threshold: Fraction = THRESHOLD, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those of a class beside the one with its smallest id."""
    signed, known = classes(docs, words, threshold, recall, id_col, text_col)
    rows = signed.select("node", "h1", "h2").join(known, ["h1", "h2"])
    own = f"{unused(docs.columns)}node"
    gone = cut(rows.where("node <> class_id").select(F.col("node").alias(own)).distinct())
    again = signed.groupBy("node").count().where(F.col("count") > 1).limit(1).count() > 0
    kept = docs.withColumn(own, node_of(id_col, text_col)).join(gone, own, "left_anti")
    return (kept.dropDuplicates([own]) if again else kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir):
    return join(table(spark, sf_dir, "documents"))

"""I-Match fingerprints with DataFrame functions only.

Document frequencies of all terms are counted exactly, by 64-bit hash, over all documents. Terms whose frequency
lies in a band, relative to the number of documents, make the lexicon: n documents with t distinct terms on
average have at most t / (lower bound) such terms, whatever n is, so it is a literal of the plan. A fingerprint's
components are hashes of the sorted distinct terms of a text that lie in randomised subsets of the lexicon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skinnyla.llm.common import table

#: Band of document frequency, as a share of the documents.
BAND = (0.002, 0.25)
#: Most blocks of the id's range.
BLOCKS = 1 << 16
#: Random partitions of the lexicon: into how many parts, and how many of these are subsets. Large
#: subsets tell near copies, small ones also texts that share a part.
PARTS = ((1, 1), (4, 2), (8, 3), (16, 4), (32, 6), (64, 8), (128, 16))


def words_of(text: Column) -> Column:
    """Runs of letters and digits of a text, lower-cased, and perhaps an empty one."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def hashed_terms(text: Column) -> Column:
    """Distinct hashed terms of a text."""
    return F.array_remove(F.array_distinct(F.transform(words_of(text), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, text: Column, band=BAND) -> tuple[Column, int]:
    """The hashes of the terms whose document frequency lies in the band, as a table of two places for each, and its mask.

    Counts are aggregated before the shuffle; the driver collects what lies in the band only.
    """
    n = docs.count()
    low, high = max(2.0, band[0] * n), max(3.0, band[1] * n)
    terms = docs.select(F.explode(F.array_distinct(words_of(text))).alias("t")).where("t <> ''").select(F.xxhash64("t").alias("t"))
    held = terms.groupBy("t").count().where(F.col("count").between(low, high)).select("t").toArrow().column("t").to_pylist()
    slots = place(sorted(held))
    return F.split(F.lit(",".join(map(str, slots))), ",").cast("array<bigint>"), len(slots) - 1  # folded into a literal


def places(term: int, mask: int) -> tuple[int, int]:
    return term & mask, term >> 32 & mask


def place(terms: list[int]) -> list[int]:
    """A table of a power of 2 in which each term stands at one of its two places; a term moves the one it meets to its other.

    A free place holds a number that is looked up elsewhere.
    """
    first = max(4, (3 * len(terms)).bit_length())
    for size in (1 << k for k in range(first, first + 8)):
        slots: list[int | None] = [None] * size
        for term in terms:
            at = places(term, size - 1)[0]
            for _ in range(500):
                term, slots[at] = slots[at], term
                if term is None:
                    break
                a, b = places(term, size - 1)
                at = b if at == a else a
            else:
                break  # a circle: a larger table
        else:
            return [(0 if i == size - 1 else -1) if x is None else x for i, x in enumerate(slots)]
    raise ValueError("the terms are no hashes: too many have the same places")


def kept(terms: Column, words: tuple[Column, int]) -> Column:
    """The terms that are in the lexicon, sorted."""
    slots, mask = words

    def known(t: Column) -> Column:
        first, second = t.bitwiseAND(F.lit(mask)), F.shiftright(t, 32).bitwiseAND(F.lit(mask))
        return (F.get(slots, first.cast("int")) == t) | (F.get(slots, second.cast("int")) == t)

    return F.sort_array(F.filter(terms, known))


def part_of(term: Column, parts: int) -> Column:
    """Which part of the lexicon a term is in: bits of its hash, others for each number of parts (a power of 2)."""
    first = sum(p.bit_length() - 1 for p, _ in PARTS if p < parts)
    return F.shiftright(term, first).bitwiseAND(F.lit(parts - 1))


def text_of(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda x: F.coalesce(F.lpad(F.hex(x), 8, "0"), F.lit("-"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components among those that one of two fingerprints has; null if either is null."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    any_ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda e: e))
    return F.when(a.isNotNull() & b.isNotNull(), same / any_)


def fingerprint(docs: DataFrame, text_col: str = "text", band=BAND) -> tuple[DataFrame, tuple[Column, int]]:
    """docs with a column marks (the components), and the lexicon they were made with.

    A null text is empty. Texts without a term of the lexicon are told by all their terms; equal texts have
    equal fingerprints, as have texts with equal terms in the lexicon.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = lexicon(docs, text, band)
    return with_marks(docs, text, words, "marks"), words


def with_marks(df: DataFrame, text: Column, words: tuple[Column, int], name: str) -> DataFrame:
    """df with the components of a text: array<long>, 32 bits of a hash for each subset, null where it has no term.

    The first component, of the whole lexicon, falls back on all terms where none is in the lexicon. Terms
    and the subsets' terms are steps of their own, so that they are made once.
    """

    def few(parts: int, k: int) -> Column:
        return F.filter("__own", lambda t: part_of(t, parts) < k)

    def subset(parts: int, k: int) -> Column:
        return F.filter(f"__few{parts}", lambda t: part_of(t, parts) == k)

    def mark(terms: Column) -> Column:
        return F.when(F.size(terms) > 0, F.xxhash64(terms).bitwiseAND(F.lit(0xFFFFFFFF)))

    names = df.columns
    df = df.withColumn("__every", hashed_terms(text)).withColumn("__own", kept(F.col("__every"), words))
    df = df.withColumns({f"__few{parts}": few(parts, k) for parts, k in PARTS if parts > 1})
    marks = [F.coalesce(mark(F.col("__own")), F.xxhash64(F.sort_array("__every")).bitwiseAND(F.lit(0xFFFFFFFF)))]
    marks += [mark(subset(parts, k)) for parts, n in PARTS if parts > 1 for k in range(n)]
    return df.select(*[F.col(f"`{c}`") for c in names], F.array(*marks).alias(name))


def block_of(value: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most the value, by binary search."""
    n = len(bounds)
    if not n:
        return F.lit(0)
    held = F.array(*map(F.lit, bounds))
    state = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    mid = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.element_at(held, mid(s) + 1) <= value, F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length() + 1)), state, step, lambda s: s["lo"])


def with_next(df: DataFrame, id_col: str, columns: list[str], rows_a_block: int = 2000, n: int | None = None) -> DataFrame:
    """df with next_<c> for each column, from the row that follows by id (after the last: the first).

    Rows are dealt to blocks of the id's range by quantiles that are ids themselves; the row that opens
    a block is also a guest of the block before, so no window goes beyond a block. There are BLOCKS at the most, as
    their bounds are a literal; larger ones are sorted with spill, and a window holds a row ahead only. Ties of the
    id are ordered by the columns; null ids come first.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    df = df.withColumn("__key", key)
    n = df.count() if n is None else n
    blocks = min(BLOCKS, max(1, n // rows_a_block))
    ends = df.agg(F.min("__key").alias("lo")).first()
    if ends.lo is None:
        return df.drop("__key").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    bounds = sorted({int(x) for x in df.agg(F.percentile_approx("__key", [k / blocks for k in range(1, blocks)], 10 * blocks).alias("q")).first().q} - {ends.lo}) if blocks > 1 else []
    last = len(bounds)
    opens = F.array_contains(F.array(*map(F.lit, bounds)), F.col("__key")) if bounds else F.lit(False)
    own = F.struct(F.col("__block").alias("block"), F.lit(False).alias("guest"), F.lit(False).alias("wrap"))
    before = F.struct((F.col("__block") - 1).alias("block"), F.lit(True).alias("guest"), F.lit(False).alias("wrap"))
    wrapped = F.struct(F.lit(last).cast("int").alias("block"), F.lit(True).alias("guest"), F.lit(True).alias("wrap"))
    places = F.when(F.col("__key") == F.lit(ends.lo), F.array(own, wrapped)).when(opens, F.array(own, before)).otherwise(F.array(own))
    dealt = df.withColumn("__block", block_of(F.col("__key"), bounds).cast("int")).withColumn("__place", F.explode(places))
    w = Window.partitionBy("__place.block").orderBy(F.col("__place.wrap"), "__key", *columns, F.col("__place.guest"))
    dealt = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return dealt.where(~F.col("__place.guest")).drop("__key", "__block", "__place")


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band=BAND) -> DataFrame:
    """Fingerprints of the texts and of their edited texts, with likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document by id. A null text is empty, and an empty text's fingerprint is that of no
    terms. Repeated ids are ordered by their texts. Other columns are not read.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked, words = fingerprint(named, "text", band)
    near = with_next(marked, "doc_id", ["text", "marks"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    near = with_marks(near.withColumn("edited", edited), F.col("edited"), words, "edited_marks")
    return near.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("marks")).alias("fingerprint"), text_of(F.col("edited_marks")).alias("edited_fingerprint"), likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))


def query(spark, sf_dir):
    return compare_next(table(spark, sf_dir, "documents"))

import hashlib
import random

import pytest
import regex
import xxhash

from skinnyla.llm import fingerprints


def expected(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest(), n)
    return out


def test_edited_texts_and_equal_fingerprints(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, texts = expected(rows), dict(rows)
    got = fingerprints.query(spark, sf).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        assert (r.n_chars, r.edited_sha256) == want[r.doc_id][:2]
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if texts[r.doc_id] == want[r.doc_id][2]:
            assert r.near_next == 1
    assert len(by_text) < len(rows) and len(set(by_text.values())) > 0.95 * len(by_text)
    assert sum(r.near_edited > r.near_next for r in got) > 0.8 * len(got)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*longs, seed=42):
    for x in longs:
        seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), seed)
    return seed


def plain_marks(texts, edited, band=fingerprints.BAND):
    """Components of texts and of edited texts by counting terms in a dictionary."""
    terms = lambda t: {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    count = {}
    for t in texts:
        for x in terms(t):
            count[x] = count.get(x, 0) + 1
    lexicon = {x for x, c in count.items() if max(2, band[0] * len(texts)) <= c <= max(3, band[1] * len(texts))}

    def marks(t):
        every = sorted(terms(t))
        own = [x for x in every if x in lexicon]
        out, used = [hash_of(*(own or every)) & 0xFFFFFFFF], 1
        for parts, n in fingerprints.PARTS[1:]:
            dealt = [(x // used % parts, x) for x in own]
            used *= parts
            for k in range(n):
                mine = [x for p, x in dealt if p == k]
                out.append(hash_of(*mine) & 0xFFFFFFFF if mine else None)
        return out

    return [marks(t) for t in texts], [marks(t) for t in edited]


def test_fingerprints_and_likeness_equal_plain_ones(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    texts = [t for _, t in rows]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    own, other = plain_marks(texts, edited)
    text_of = lambda m: "".join(f"{x:08X}" if x is not None else "-" for x in m)
    like = lambda a, b: sum(x == y and x is not None for x, y in zip(a, b, strict=True)) / sum(x is not None or y is not None for x, y in zip(a, b, strict=True))
    got = {r.doc_id: r for r in fingerprints.query(spark, sf).collect()}
    for k, (i, _) in enumerate(rows):
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (text_of(own[k]), text_of(other[k]))
        assert abs(r.near_edited - like(own[k], other[k])) < 1e-12 and abs(r.near_next - like(own[k], own[(k + 1) % len(rows)])) < 1e-12


def test_every_term_has_its_place():
    rng = random.Random(3)
    for n in (0, 1, 5, 3000):
        terms = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(n)]
        terms += [0, -1, 5 << 32] * (n > 1)
        slots = fingerprints.place(terms)
        holds = lambda x: x in {slots[i] for i in fingerprints.places(x, len(slots) - 1)}
        assert all(map(holds, terms)) and len(slots) <= 16 * max(16, n)
        assert not any(holds(x) for x in [*range(-200, 200), *(rng.randrange(-(1 << 63), 1 << 63) for _ in range(500))] if x not in terms)
    with pytest.raises(ValueError, match="no hashes"):
        fingerprints.place([0, 5, 5 << 32])


def test_blocks_and_ties(spark):
    rows = [(i * i % 997, f"text number {i} " * (i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.text): r.next_text for r in fingerprints.with_next(df, "doc_id", ["text"], rows_a_block=10).collect()}
    rows.sort()
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        if rows.count((i, t)) == 1:
            assert got[i, t] == n


def test_near_copies_are_alike(spark):
    words = [f"w{k}x{k % 7}" for k in range(300)]
    rows = [(i, " ".join(words[i : i + 120])) for i in range(0, 160)]
    rows += [(1000, rows[5][1] + " more"), (1001, rows[5][1])]
    marked, _ = fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"), band=(0.0, 0.9))
    m = {r.doc_id: r.marks for r in marked.collect()}
    like = lambda a, b: sum(x == y and x is not None for x, y in zip(a, b, strict=True)) / sum(x is not None or y is not None for x, y in zip(a, b, strict=True))
    assert m[5] == m[1001] and like(m[5], m[1000]) > 0.8 and like(m[5], m[150]) < 0.2


def test_odd_rows(odd, none):
    got = fingerprints.compare_next(odd)
    assert got.count() == 9 and got.where("near_edited is null or near_next is null").count() == 0
    assert {r.n_chars for r in got.where("doc_id in (1, 2)").collect()} == {0}
    assert fingerprints.compare_next(none).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = fingerprints.query(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

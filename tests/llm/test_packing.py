import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from skinnyla.llm import packing
from skinnyla.llm.common import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def test_encoder_equals_the_library():
    library, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH, cache_entries=40)
    rng = random.Random(3)
    parts = ["Aé", "b", " ", "\n", "\t", "12", "'s", "'LL", "!?", "Σ", "İ", "\xa0", "́", "<|endoftext|>", "th", "\x1c", "Œ", "€", "ª", "½"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 10)))
        assert encode(s) == packing.pack_ids(library.encode(s, add_special_tokens=False).ids), repr(s)


def test_fill_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randint(1, 12) for _ in range(rng.randint(0, 7))]
        room = rng.randint(0, 25)
        counts = defaultdict(int)
        for x in items:
            counts[x] += 1
        used = packing.fill(counts, sorted(counts, reverse=True), room)
        best = max(s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room)
        assert sum(x * k for x, k in used.items()) == best
        assert all(k <= counts[x] for x, k in used.items())


def check_packed(rows, texts, window=2048):
    library = Tokenizer.from_file(PATH)
    sequences = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
    for doc, text in texts.items():
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return sum(r.length for r in rows) / (window * len(sequences))


def test_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packed(packing.query(spark, sf).collect(), texts) > 0.98


def test_odd_rows(odd, none):
    rows = packing.pack(odd, PATH, bucket_docs=2).collect()
    assert sum(r.start == 0 for r in rows) == 9
    assert {r.doc_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert packing.pack(none, PATH).count() == 0

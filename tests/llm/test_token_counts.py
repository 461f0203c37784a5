import random

import public_tokenizers
from tokenizers import Tokenizer

from skinnyla.llm import token_counts
from skinnyla.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def test_counts_equal_the_library_on_odd_strings():
    library, count = Tokenizer.from_file(PATH), token_counts.Counter(PATH, cache_entries=50)
    rng = random.Random(5)
    parts = ["a", "b", " ", "\n", "\t", "  ", "1", "é", "'s", "!", "　", "<|endoftext|>", "th", "\x1c", "́"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert count(s) == len(library.encode(s, add_special_tokens=False).ids), repr(s)


def test_query_equals_the_library(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = token_counts.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def test_odd_rows(odd, none):
    got = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_counts.count_tokens(odd, PATH).collect()}
    assert got[1, 0] == got[2, 0] == 0 and got[6, 60000] > 1000
    assert token_counts.count_tokens(odd, PATH).count() == 9
    assert token_counts.count_tokens(none, PATH).count() == 0

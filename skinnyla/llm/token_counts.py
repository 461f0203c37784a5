"""Token counts by byte-pair merging with a heap over a linked list.

Only counts are made: the initial symbols of a piece less the merges done. No identifier is emitted.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.llm.common import batches, per_worker, texts_of, tokenizer_path

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
# Fixed value: the byte-level splitting pattern of the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Counter:
    """Counts tokens of whole texts.

    cache_entries bounds the memory of the word cache, not the work: a full cache is emptied and
    refilled. Words at single spaces and line ends are counted apart, as pieces never reach over the
    start of a space; texts with longer runs of white space are split as one.
    """

    def __init__(self, path: str, cache_entries: int = 700_000):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.bytes = [vocab[x] for x in byte_symbols()]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.find = regex.compile(PIECES).findall
        self.runs = re.compile(r"\s\s(?:\s|\Z)").search
        self.cache_entries = cache_entries
        counter = self

        class Words(dict):
            def __missing__(self, word: str) -> int:
                if len(self) >= counter.cache_entries:
                    self.clear()
                n = counter.plain(word if word[:1] == "\n" else " " + word)
                if len(word) <= 64:
                    self[word] = n
                return n

        class Parts(dict):
            def __missing__(self, piece: str) -> int:
                if len(self) >= counter.cache_entries:
                    self.clear()
                n = counter.merge(piece.encode())
                if len(piece) <= 64:
                    self[piece] = n
                return n

        self.words, self.parts = Words(), Parts()

    def merge(self, piece: bytes) -> int:
        """Tokens of one piece: pops the pair of the lowest rank, leftmost first, until none is left."""
        code, merges = self.bytes, self.merges
        ids = [code[b] for b in piece]
        n = len(ids)
        if n < 2:
            return n
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (m := merges.get(ids[i] << 20 | ids[i + 1])) is not None:
                heap.append((m[0], i, m[1]))
        heapify(heap)
        left = n
        while heap:
            rank, i, made = heappop(heap)
            j = nxt[i] if ids[i] >= 0 else n
            if j >= n or (m := merges.get(ids[i] << 20 | ids[j])) is None or m[0] != rank:
                continue  # the pair was changed by another merge since it was pushed
            ids[i], ids[j] = made, -1
            nxt[i] = k = nxt[j]
            left -= 1
            if k < n:
                prv[k] = i
                if (m := merges.get(made << 20 | ids[k])) is not None:
                    heappush(heap, (m[0], i, m[1]))
            if (h := prv[i]) >= 0 and (m := merges.get(ids[h] << 20 | made)) is not None:
                heappush(heap, (m[0], h, m[1]))
        return left

    def plain(self, text: str) -> int:
        return sum(map(self.parts.__getitem__, self.find(text)))

    def part(self, text: str) -> int:
        if self.runs(text):
            return self.plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.plain(first) if first else 0) + sum(map(self.words.__getitem__, rest))

    def __call__(self, text: str) -> int:
        if not self.special or not self.special_re.search(text):
            return self.part(text)
        parts = self.special_re.split(text)
        return sum(map(self.part, parts)) + len(parts) - 1


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, UTF-8 bytes, tokens, and whether there are more than limit.

    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null. Repeated rows give repeated
    rows. Columns other than the two named are not read, so their names can't clash.
    """

    def run(rows):
        count = per_worker("token counter", path, lambda: Counter(path))
        for b in batches(rows):
            n = [count(x) for x in texts_of(b.column(1))]
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir):
    from skinnyla.llm.common import table

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))

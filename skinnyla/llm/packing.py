"""Packing documents into token sequences by minimum bin slack.

Documents are tokenised where they lie; only a row for each piece (no text, no ids) is shuffled, to
hash buckets of about bucket_docs documents. A document longer than the window is cut into full
windows and a remainder; the remainders of a bucket are packed by subset-sum dynamic programming over
their multiset of lengths.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.llm.common import batches, per_worker, table, texts_of, tokenizer_path

PIECES = "doc_id long, copy int, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, copy int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# Fixed value: the splitting pattern of the vocabulary file.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit words.

    Words at white space and their parts are encoded once and kept, which is exact for texts of the
    listed characters: normalisation does nothing to them but lower their case, and the splitting
    pattern never joins two words. Other texts go to the library whole. cache_entries bounds the memory
    of the word cache.
    """

    def __init__(self, path: str, cache_entries: int = 600_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.path, self.library = path, None  # the library's own way is only loaded for odd texts
        self.parts = Tokenizer.from_file(path)  # for one part at a time, already lower-cased
        self.parts.normalizer = None
        self.parts.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.other = re.compile("[^\n\t\r\x20-\x7e\xa1-\xac\xae-\u012f\u0132-\u017f\u2013\u2014\u2018\u2019\u201c\u201d\u2026\u20ac]").search
        self.split = regex.compile(WORD_PARTS).findall
        self.known: dict[str, bytes] = {}
        self.cache_entries = cache_entries

    def whole(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return pack_ids(self.library.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        if self.other(text) or any(x in text for x in self.special):
            return self.whole(text)
        words, known = text.lower().split(), self.known
        out = list(map(known.get, words))
        if None not in out:
            return b"".join(out)
        if len(known) > self.cache_entries:
            known.clear()
        missing = {w for w, x in zip(words, out, strict=True) if x is None}
        new = {w: [w] if w.isalpha() else self.split(w) for w in missing}
        parts = [p for p in {p for x in new.values() for p in x} if p not in known]
        made = {p: pack_ids(e.ids) for p, e in zip(parts, self.parts.encode_batch_fast(parts, add_special_tokens=False), strict=True)}
        made |= {w: b"".join([known[p] if p in known else made[p] for p in x]) for w, x in new.items() if len(x) > 1}
        known.update((w, x) for w, x in made.items() if len(w) <= 64)
        return b"".join([made[w] if x is None else x for w, x in zip(words, out, strict=True)])


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def fill(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The multiset of lengths (length -> how many) whose sum comes closest to room from below.

    counts: how many of each length there are; order: its lengths, descending. A bit of reach is set
    for each sum that can be had; the layers kept on the way give the counts back.
    """
    reach, mask, layers = 1, (1 << room + 1) - 1, []
    for length in order:
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left > 0:  # binary splitting of the multiplicity
            take = min(part, left)
            layers.append((length, take, reach))
            reach |= reach << length * take & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            used[length] += take
            at -= length * take
    return used


def pack_lengths(lengths: list[int], window: int) -> list[list[int]]:
    """Windows of indexes of lengths (each from 1 to window).

    Each window is seeded with the largest length left and filled to the least slack.
    """
    at: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(lengths):
        at[x].append(i)
    for x in at.values():
        x.reverse()
    order = sorted(at, reverse=True)
    counts = {x: len(v) for x, v in at.items()}
    windows = []
    while order:
        seed = order[0]
        counts[seed] -= 1
        used = fill(counts, order if counts[seed] else order[1:], window - seed)
        used[seed] += 1
        counts[seed] += 1
        own = []
        for x, k in used.items():
            own += [at[x].pop() for _ in range(k)]
            counts[x] -= k
        order = [x for x in order if counts[x]] if any(not counts[x] for x in used) else order
        windows.append(own)
    return windows


def pieces(docs: DataFrame, path: str, window: int, end_id: int, id_col: str, text_col: str, copy_col: str | None) -> DataFrame:
    end = pack_ids([end_id])

    def run(rows):
        encode = per_worker("encoder", path, lambda: Encoder(path))
        for b in batches(rows):
            out = []
            for doc, copy, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
                ids = encode(text) + end
                n, view = len(ids) // 4, memoryview(ids)
                out += [(doc, copy, s, min(window, n - s), zlib.crc32(view[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), *[pa.int64()] * 4), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    copy = F.col(copy_col).cast("int") if copy_col else F.lit(0)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), copy.alias("copy"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, n_docs: int | None = None, bucket_docs: int = 4000, id_col: str = "doc_id", text_col: str = "text", copy_col: str | None = None) -> DataFrame:
    """One row per piece: doc_id, copy, start, length, crc32 of its ids, doc_tokens, sequence_id, offset.

    n_docs (counted if not given) sets how many buckets there are, so that a bucket's pieces fit one
    task at any size. copy_col tells repeated rows of an id apart; without it, equal rows are packed
    one by one alike. A null text is empty (only the end id); a null doc_id is packed like any other.
    An empty table gives an empty result. Columns not named are not read.
    """
    n_docs = docs.count() if n_docs is None else n_docs
    buckets = max(1, -(-n_docs // bucket_docs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "copy", "start", "ids_crc32"], kind="stable", ignore_index=True)
        length = pdf["length"].tolist()
        short = [i for i, x in enumerate(length) if x < window]
        groups = [[i] for i, x in enumerate(length) if x == window]
        groups += [[short[i] for i in g] for g in pack_lengths([length[i] for i in short], window)]
        seq, off = [0] * len(length), [0] * len(length)
        for k, g in enumerate(groups):
            at = 0
            for i in g:
                seq[i], off[i] = k, at
                at += length[i]
        base = int(pdf["bucket"].iloc[0]) << 32
        return pdf.drop(columns="bucket").assign(sequence_id=[base + k for k in seq], offset=off)

    bucket = F.pmod(F.xxhash64("doc_id", "copy", "start", "ids_crc32"), F.lit(buckets))
    return pieces(docs, path, window, end_id, id_col, text_col, copy_col).withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, PACKED)


def query(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).drop("copy")

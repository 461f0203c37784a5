"""License scans: an exact containment join of text blocks with license templates.

Blocks are lines, and windows of consecutive words that go over line ends, so that wrapped notices are found.

A template's tokens are ordered by how many documents hold them, rarest first. A block can only hold
enough of a template if it holds one of the template's first few tokens (prefix filter), has enough
tokens (length filter) and enough of both lists is left after the first match (positional filter);
blocks that pass are compared exactly. Base phrases are found beside that in whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.llm.common import batches, per_worker, table, utf8_buffer

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line: int, label: string, containment: double>>"
# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Templates: a label and the text whose words a block is to hold.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UPPER = np.arange(256, dtype=np.uint8)
UPPER[0x41:0x5B] += 32
#: Words of a window for each word of the template.
WIDTH = 1.5
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def document_frequencies(docs: DataFrame, text_col: str, tokens: Sequence[str]) -> dict[str, int]:
    """How many documents hold each token as a word, over all documents.

    A row is collected for each of the templates' tokens.
    """
    words = F.split(F.lower(F.col(text_col).cast("string")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    held = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, tokens)), words)).alias("t"))
    return dict.fromkeys(tokens, 0) | {r.t: r.n for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}


class Scanner:
    def __init__(self, templates, phrases: Mapping[str, str], frequency: Mapping[str, int], threshold: float):
        rank = {t: i for i, t in enumerate(sorted(frequency, key=lambda t: (frequency[t], t)))}
        self.rank = {t.encode(): r for t, r in rank.items()}
        self.templates, self.widths, self.starts = [], [], {}
        for k, (label, text) in enumerate(templates):
            own = sorted({rank[t] for t in text.split()})
            need = ceil(threshold * len(own) - 1e-9)
            self.templates.append((label, own, need))
            self.widths.append(ceil(WIDTH * len(text.split())))
            for i, r in enumerate(own[: len(own) - need + 1]):
                self.starts.setdefault(r, []).append((k, i))
        rare = sorted((t.encode() for t in frequency if rank[t] in self.starts), key=len, reverse=True)
        self.maybe = re.compile(b"(?<![0-9a-z\x80-\xff])(?:" + b"|".join(map(re.escape, rare)) + b")(?![0-9a-z\x80-\xff])")
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        self.last = re.compile(b"|".join(re.escape(p[-1]) for p, _ in self.phrases))

    def base(self, low: bytes) -> tuple[list[int], set[str]]:
        if not self.last.search(low):
            return [], set()
        words, at, labels = WORDS.findall(low), [], set()
        where: dict[bytes, list[int]] = {}
        firsts = {p[0] for p, _ in self.phrases}
        for i, w in enumerate(words):
            if w in firsts:
                where.setdefault(w, []).append(i)
        for p, label in self.phrases:
            found = [i for i in where.get(p[0], ()) if words[i : i + len(p)] == p]
            at += found
            labels |= {label} if found else set()
        return at, labels

    def blocks(self, low: bytes) -> list[tuple[int, str, float]]:
        found, done = [], -1
        for m in self.maybe.finditer(low):
            if m.start() < done:
                continue
            start = low.rfind(b"\n", 0, m.start()) + 1
            done = low.find(b"\n", m.start())
            done = len(low) if done < 0 else done
            words = set(WORDS.findall(low, start, done))
            size, known = len(words), sorted(r for w in words if (r := self.rank.get(w)) is not None)
            seen: set[int] = set()
            for j, r in enumerate(known):
                for k, i in self.starts.get(r, ()):
                    if k in seen:
                        continue
                    label, own, need = self.templates[k]
                    seen.add(k)
                    if size < need or min(len(own) - i, len(known) - j) < need:
                        continue
                    both = len(set(own).intersection(known))
                    if both >= need:
                        found.append((start, label, both / len(own)))
        return found

    def windows(self, low: bytes) -> list[tuple[int, str, float]]:
        """The best of each run of overlapping windows over line ends that hold enough of a template."""
        if b"\n" not in low or not self.maybe.search(low):
            return []
        known = [(i, r, m.start()) for i, m in enumerate(WORDS.finditer(low)) if (r := self.rank.get(m[0])) is not None]
        have, found = {r for _, r, _ in known}, []
        for (label, own, need), width in zip(self.templates, self.widths, strict=True):
            every = set(own)
            if len(every & have) < need:
                continue
            mine = [x for x in known if x[1] in every]
            n: Counter[int] = Counter()
            left, best, upto = 0, None, -1
            for i, r, at in mine:
                n[r] += 1
                while i - mine[left][0] >= width or n[mine[left][1]] > 1:  # a later one stands for a repeated word
                    n[mine[left][1]] -= 1
                    if not n[mine[left][1]]:
                        del n[mine[left][1]]
                    left += 1
                start = mine[left][2]
                if len(n) < need or low.find(b"\n", start, at) < 0:
                    continue
                if best is not None and start > upto:
                    found.append(best)
                    best = None
                if best is None or len(n) / len(own) > best[2]:
                    best = (start, label, len(n) / len(own))
                upto = at
            if best is not None:
                found.append(best)
        return found


def scan(docs: DataFrame, templates=TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: words, places of base phrases, labels, and the blocks that were found.

    blocks lists each line, and each place where a window of half as many words again as the template has
    goes over line ends, that holds at least the threshold of a template's distinct words, with the number of
    the (first) line. Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A null
    or empty text has no words and score 0; null ids and repeated rows pass through one by one; other
    columns are not read. score is the largest containment found, 1 where a base phrase stands.
    """
    tokens = sorted({t for _, x in templates for t in x.split()})
    frequency = document_frequencies(docs, text_col, tokens)

    def run(rows):
        scanner = per_worker("licenses", (tuple(templates), tuple(phrases), tuple(frequency.items()), threshold), lambda: Scanner(templates, phrases, frequency, threshold))
        for b in batches(rows, 2 << 20):
            raw, offsets = utf8_buffer(b.column(1))
            low = UPPER[raw]
            word = WORD[low]
            begins = word.copy()
            begins[1:] &= ~word[:-1]
            first = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[first] = word[first]
            upto = np.concatenate([[0], np.cumsum(begins)])
            n_words = upto[offsets[1:]] - upto[offsets[:-1]]
            whole, out = low.tobytes(), []
            for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                text = whole[s:e]
                at, base = scanner.base(text)
                found = scanner.blocks(text) + scanner.windows(text)
                out.append((len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[1] for x in found})), 1.0 if at else max((x[2] for x in found), default=0.0), [{"line": text.count(b"\n", 0, p), "label": x, "containment": c} for p, x, c in found]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("line", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), *[pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents")).drop("blocks")

"""Toxicity: texts are restored through a noisy channel, then scored by a lexicon learned from labels.

Counts of character trigrams over all documents make the language model. A word that leetspeak, spacing or
repetition may have changed spans a lattice of characters; Viterbi decoding picks the cheapest path
under the model and the channel. Words with one path are themselves. Restored words and their
beginnings are looked up in a lexicon of smoothed log odds, learned from a bounded sample of labelled
rows; a logistic curve turns a text's evidence into a score. It is fitted to the same rows, each judged
by the lexicon as it would be without that row.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skinnyla.llm.common import batches, cut, per_worker, table, texts_of, unused, utf8_buffer
from skinnyla.llm.near_duplicates import THRESHOLD, WORDS, signatures

# What a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
DROPPED = ".-_*~'"
#: Characters of the model: 0 the edge of a word, 1 to 26 letters, 27 any character beyond ASCII, by its first byte.
SIZE = 28
CLASS = np.zeros(256, np.int32)
CLASS[0x61:0x7B] = CLASS[0x41:0x5B] = np.arange(1, 27)
CLASS[0x80:] = 27

EDGE = re.compile(r"^[^\w@$€£|+(!]+|[^\w@$|€+]+$")
NOISY = re.compile(r"[0-9@$!|+(€£.\-_*~']|([^\W\d_])\1\1")
SPACED = re.compile(r"(?:(?<=\s)|^)(?:[^\W_]|[@$!|])(?:[ .\-_*]{1,3}(?:[^\W_]|[@$!|])(?=[\s.\-_*,;:!?]|$)){3,}")
GAP = re.compile(r"[\s.\-_*]+")
#: Letters of a lexicon word that is found inside a run; letters from which a word is searched like a run.
INSIDE, LONG = 4, 40
BEGINNINGS = (4, 5, 6)


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of character trigrams over all documents, a table of fixed size (SIZE cubed)."""

    def run(rows):
        total = np.zeros(SIZE**3, np.int64)
        for b in batches(rows, 1 << 20):
            raw, offsets = utf8_buffer(b.column(0))
            whole = (raw & 0xC0) != 0x80  # bytes that begin a character
            starts = np.concatenate([[0], np.cumsum(whole)])[offsets[:-1]]
            c = CLASS[raw[whole]]
            c = np.insert(c, starts, 0) if len(c) else c
            if len(c) > 2:
                total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(SIZE**3, np.int64)
    for r in docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r.gram] = r.n
    return out


def model_costs(counts: np.ndarray, pseudo: float = 0.5) -> np.ndarray:
    """-ln P(c | a, b), smoothed by the bigram's and the unigram's shares."""
    c = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    one = (c.sum((0, 1)) + 1) / (c.sum() + SIZE)
    two = (c.sum(0) + 5 * one) / (c.sum((0, 2)).reshape(-1, 1) + 5)
    three = (c + pseudo * SIZE * two[None]) / (c.sum(2, keepdims=True) + pseudo * SIZE)
    return -np.log(three)


def code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27


class Decoder:
    """Viterbi over the lattice of a noisy word; states are the last two characters."""

    def __init__(self, costs: np.ndarray, swap: float = 0.7, drop: float = 0.3, squeeze: float = 0.3, keep: float = 9.0):
        self.costs = costs.tolist()
        self.swap, self.drop, self.squeeze, self.keep = swap, drop, squeeze, keep

    def edges(self, word: str) -> list[list[tuple[int, str, float]]]:
        """For each place: (next place, character or nothing, cost of the channel)."""
        out: list[list[tuple[int, str, float]]] = []
        n, i = len(word), 0
        while i < n:
            ch, own, end = word[i], [], i + 1
            if ch.isalpha():
                while end < n and word[end] == ch:
                    end += 1
                run = end - i
                if run >= 3:
                    own = [(end, ch, self.squeeze), (end, ch + ch, self.squeeze)]
                else:
                    own, end = [(i + 1, ch, 0.0)], i + 1
            elif ch in LEET:
                while end < n and word[end] == ch:
                    end += 1
                own = [(end, c, self.swap) for c in LEET[ch]] + [(end, c + c, 2 * self.swap) for c in LEET[ch] if end - i >= 2]
                own += [(end, "", self.drop + 1.0)] if ch in "!|+(" else []
            elif ch in DROPPED or ch.isspace():
                own = [(i + 1, "", self.drop)]
            else:
                own = [(i + 1, "", self.keep)]
            out += [own] + [[] for _ in range(end - i - 1)]
            i = end
        return out

    def __call__(self, word: str) -> str:
        edges, costs = self.edges(word), self.costs
        best: list[dict[tuple[int, int], tuple[float, tuple]]] = [{} for _ in range(len(word) + 1)]
        best[0][0, 0] = (0.0, ())
        for i, own in enumerate(edges):
            for (a, b), (cost, done) in best[i].items():
                for to, chars, channel in own:
                    x, y, total = a, b, cost + channel
                    for ch in chars:
                        k = code(ch)
                        total += costs[x][y][k]
                        x, y = y, k
                    if total < best[to].get((x, y), (1e18,))[0]:
                        best[to][x, y] = (total, (done, chars) if chars else done)
            best[i] = {}
        ends = [(cost + costs[a][b][0], k, done) for k, ((a, b), (cost, done)) in enumerate(best[-1].items())]
        if not ends:
            return word
        path, out = min(ends)[2], []
        while path:  # a chain of what was read, the last first
            path, chars = path
            out.append(chars)
        return "".join(reversed(out))


class Restorer:
    """Words of a text as they were meant."""

    def __init__(self, costs: np.ndarray):
        self.decode = Decoder(costs)

    def word(self, chunk: str) -> str:
        w = EDGE.sub("", chunk)
        return self.decode(w) if NOISY.search(w) else w

    def spaced(self, low: str) -> list[str]:
        """Runs of single characters, as far as the text has any, read as one word and, parted at wider gaps, as words."""
        out = []
        for m in SPACED.finditer(low):
            out.append(self.decode(GAP.sub("", m[0])))
            least = min(map(len, GAP.findall(m[0])))
            words = re.split(rf"[\s.\-_*]{{{least + 1},}}", m[0])
            out += [self.decode(GAP.sub("", w)) for w in words] if len(words) > 1 else []
        return out


def features(word: str) -> list[str]:
    """What of a word is looked up: itself and its beginnings."""
    return [word] + [f"{word[:n]}^" for n in BEGINNINGS if len(word) > n] if len(word) >= 3 else []


class Scorer:
    def __init__(self, costs: np.ndarray, lexicon: dict[str, float], curve: tuple[float, float], cache_entries: int = 250_000):
        restore = self.restore = Restorer(costs)
        self.curve = curve

        class Words(dict):
            def __missing__(self, chunk: str) -> float:
                if len(self) >= cache_entries:
                    self.clear()
                e = evidence_of(w := restore.word(chunk), lexicon)
                if len(w) > LONG:
                    e = max(e, inside(w, lexicon)[0])
                if len(chunk) <= 64:
                    self[chunk] = e
                return e

        self.words, self.lexicon = Words(), lexicon

    def evidence(self, text: str) -> float:
        """The strongest evidence of a word, and a third of that of the next three distinct words."""
        low = text.lower()
        found = [e for e in map(self.words.__getitem__, set(low.split())) if e > 0]
        runs = {f: e for w in self.restore.spaced(low) for e, f in [max((evidence_of(w, self.lexicon), w), inside(w, self.lexicon))] if e > 0}
        found += runs.values()
        found.sort(reverse=True)
        return found[0] + sum(found[1:4]) / 3 if found else 0.0

    def __call__(self, text: str) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a * self.evidence(text) + b))))


def evidence_of(word: str, lexicon: dict[str, float]) -> float:
    return max((lexicon.get(f, 0.0) for f in features(word)), default=0.0)


def inside(word: str, lexicon) -> tuple[float, str]:
    """The strongest evidence of a whole lexicon word anywhere in a run of letters, and that word."""
    most = longest_of(lexicon)
    return max(((lexicon.get(f, 0.0), f) for i in range(len(word)) for j in range(i + INSIDE, min(i + most, len(word)) + 1) for f in [word[i:j]]), default=(0.0, ""))


def longest_of(lexicon, _kept: list = []) -> int:  # noqa: B006
    """Letters of the longest lexicon word."""
    for known, n in _kept:
        if known is lexicon:
            return n
    own = lexicon.lexicon.counts if isinstance(lexicon, Without) else lexicon
    _kept[:] = [*_kept[-3:], (lexicon, max((len(f) for f in own if f[-1:] != "^"), default=0))]
    return _kept[-1][1]


def distinct_texts(train: DataFrame, trees: int = 8) -> DataFrame:
    """(text, toxic) of the rows (id, text, toxic) that share no bucket of near copies with a smaller id.

    Else the words of a group of copies would pass for evidence.
    """
    signed = signatures(train, WORDS, THRESHOLD, 0.9999, "id", "text")
    signed = signed.select("node", F.explode(F.concat(F.slice("keys", 1, trees), F.array(F.xxhash64("h1", "h2")))).alias("key"))
    least = signed.groupBy("key").agg(F.min("node").alias("least"))
    again = signed.join(least, "key").where("node > least").select(F.col("node").alias("id")).distinct()
    return train.join(again, "id", "left_anti").select("text", "toxic")


class Lexicon:
    """How many toxic and other texts hold a feature, and the log odds of that at a balance of 1."""

    def __init__(self, counts: dict[str, tuple[int, int]], bad: int, good: int, least: int = 3):
        self.counts, self.bad, self.good, self.least = counts, bad, good, least

    def odds(self, x: int, y: int) -> float:
        o = log((x + 0.5) / (self.bad + 1)) - log((y + 1.0) / (self.good + 1))
        return o if x >= self.least and o > 1.0 else 0.0

    def table(self) -> dict[str, float]:
        return {f: o for f, xy in self.counts.items() if (o := self.odds(*xy)) > 0}

    def without(self, toxic: int) -> "Without":
        """The odds as they would be had a text that holds the feature not been counted."""
        return Without(self, toxic)


class Without:
    def __init__(self, lexicon: Lexicon, toxic: int):
        self.lexicon, self.toxic = lexicon, toxic

    def get(self, feature: str, default: float) -> float:
        if (xy := self.lexicon.counts.get(feature)) is None:
            return default
        return self.lexicon.odds(xy[0] - self.toxic, xy[1] - (1 - self.toxic))


def learn_lexicon(train: DataFrame, costs: np.ndarray, least: int = 3) -> Lexicon:
    """train: (text, toxic) of the bounded sample, so the lexicon is bounded too.

    Counts of texts are summed in each task before the shuffle.
    """

    def counted(n):
        every = list(n[0].keys() | n[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([n[1][f] for f in every], pa.int64()), pa.array([n[0][f] for f in every], pa.int64())], names=["feature", "bad", "good"])

    def run(rows):
        restorer, n = Restorer(costs), {0: Counter(), 1: Counter()}
        for b in batches(rows, 1 << 20):
            for text, toxic in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True):
                low = text.lower()
                words = {restorer.word(w) for w in set(low.split())} | set(restorer.spaced(low))
                n[toxic].update({f for w in words for f in features(w)})
                n[toxic]["\0all"] += 1
            if len(n[0]) + len(n[1]) > 200_000:  # sums go on in Spark; a task holds no more than this
                yield counted(n)
                n = {0: Counter(), 1: Counter()}
        yield counted(n)

    counts = train.mapInArrow(run, "feature string, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    kept = {r.feature: (r.bad, r.good) for r in counts.where((F.col("feature") == "\0all") | (F.col("bad") >= least) & (F.col("bad") * 2 > F.col("good"))).collect()}
    return Lexicon(kept, *kept.pop("\0all", (0, 0)), least)


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope (not below 0) and offset of a logistic curve by Newton's method with a small ridge."""
    design, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.01 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        w = w - np.linalg.solve(hess, grad)
    return float(max(w[0], 0.0)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, dict[str, float], tuple[float, float]]:
    """(costs of the language model, lexicon, curve).

    labels: (id, toxic 0/1); rows with a null in either are left out, and an id that is labelled more
    than once counts as toxic if any label says so. most bounds the labelled rows learned from (those
    with the smallest hash of the id). The language model counts all documents. Without labels the
    lexicon is empty and every score is a half.
    """
    costs = model_costs(trigram_counts(docs, text_col))
    own = labels.where("__id is not null and toxic is not null").groupBy("__id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    own = own.orderBy(F.xxhash64("__id"), "__id").limit(most)
    ids = [(r[0], int(r[1] > 0)) for r in own.collect()]
    if not ids:
        return costs, {}, (0.0, 0.0)
    own = F.broadcast(docs.sparkSession.createDataFrame(ids, "__id long, toxic int"))  # most rows at the most
    named = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = cut(distinct_texts(cut(named.join(own, "__id").select(F.col("__id").alias("id"), "text", "toxic"))))
    lexicon = learn_lexicon(train, costs)

    def run(rows):
        scorers = [Scorer(costs, lexicon.without(toxic), (0.0, 0.0), 50_000) for toxic in (0, 1)]
        for b in batches(rows):
            x = [scorers[toxic].evidence(text) for text, toxic in zip(texts_of(b.column(0)), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), b.column(1)], names=["x", "toxic"])

    seen = train.mapInArrow(run, "x double, toxic int").toPandas()
    return costs, lexicon.table(), fit_curve(seen["x"].to_numpy(), seen["toxic"].to_numpy())


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: crc32 of the id's text mod 5 is not 0."""
    named = labels.select(F.col(id_col).cast("long").alias("__id"), "toxic")
    return named.where(F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != 0)


def score(docs: DataFrame, model, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns of docs in keep and their score; a null text is empty."""
    costs, lexicon, curve = model
    names = [f"`{c}`" for c in keep]
    schema, at = docs.select(*names).schema.add(score_col, "double"), len(keep)

    def run(rows):
        scorer = per_worker("scorer", (curve, lexicon), lambda: Scorer(costs, lexicon, curve))
        for b in batches(rows):
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array([scorer(t) for t in texts_of(b.column(at))], pa.float64())], names=schema.names)

    return docs.select(*names, F.col(text_col).cast("string").alias(f"{unused(docs.columns)}text")).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    A null or empty text has no evidence and the score that goes with none. Null ids (held_out: false) and
    repeated rows are scored like others; only the id and the text are read.
    """
    model = fit(docs, training_labels(labels, id_col), most, id_col, text_col)
    scored = score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, most: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; all of them where no toxic word could be learned."""
    model = fit(docs, training_labels(labels, id_col), most, id_col, text_col)
    if not model[1]:
        return docs
    own = f"{unused(docs.columns)}score"
    return score(docs, model, docs.columns, text_col, own).where(F.col(own) < 0.5).drop(own)


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

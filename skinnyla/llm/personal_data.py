"""Personal data: fixed base patterns, and identifiers found by bootstrapped contexts.

Seeds (base matches, and three quarters of the values under known keys or in known formats) induce contexts: one or two words before, or the
words on both sides, with the punctuation between. Every token in a context that seeds have induced is
an instance, whatever its characters and length. Identifier-like tokens are instances anywhere, with
further patterns: the key that is assigned to (`password=`), and the format with its prefix. Spark scores the graph of patterns and instances in turns: a pattern by the mean confidence of its
distinct instances, an instance by its best pattern. Patterns that end above the threshold mark the
instances that were no seeds. The last quarter of the known values is held out: patterns have to discover them,
which shows what patterns find of values that no list knows; missed ones are marked all the same.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skinnyla.llm.common import batches, cut, table, unused

# The base patterns. Digit runs are matched possessively, with the same matches.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone", "identifier")

DIGITS = re.compile(r"[0-9]+[A-Za-z0-9_+/]*")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/")
KEY_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-")
SEED_KEYS = frozenset(("password", "passwd", "secret", "token", "api_key", "apikey", "access_key"))
SEED_FORMAT = re.compile(r"AKIA[A-Z0-9]{16}$")
LEAST = 8  # characters of an identifier that no context marks

#: A piece of text and the gap behind it; a value in a context; a number with blanks or brackets.
PIECE = re.compile(r"""([^\s=:"'`(\[{<,;|]+)([\s=:"'`(\[{<,;|]*)""")
VALUE = re.compile(r"""[^\s"'`<>()\[\]{},;|]+""")
NUMBER = re.compile(r"\(?\+?\(?[0-9]+(?:[\x20().-]{1,2}[0-9]+)+")
BEFORE, BEHIND = re.compile(r"[^\w+]+"), re.compile(r"[\W_]+$")
QUOTED = {q: re.compile(f"[^{q}\n]+(?={q})") for q in "'\"`"}
ASSIGNED = re.compile(r"""\s*[=:]\s*["'`]?""")
#: Least share of seeds in a context's distinct instances. Under it other patterns would have to vouch for nearly all.
SEED_SHARE = 0.2
#: Words that are looked for one by one before a text is cut into pieces; with more the pieces are faster.
MOST_WORDS = 64

SPAN = "struct<kind: string, start: int, end: int>"
FOUND = "struct<start: int, end: int, instance: long, seed: boolean, known: boolean, patterns: array<string>>"
SCHEMA = f"doc_id long, text_key long, base array<{SPAN}>, base_sha256 string, found array<{FOUND}>, induced array<{FOUND}>"
FOUND_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("known", pa.bool_()), ("patterns", pa.list_(pa.string()))]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping base matches by kind, then start, in code points."""
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    if not HAS_DIGIT(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


HAS_DIGIT = re.compile("[0-9]").search


def form(token: str) -> str:
    kind = "hex" if re.fullmatch("[0-9a-f]+", token) else "upper" if re.fullmatch("[0-9A-Z]+", token) else "lower" if re.fullmatch("[0-9a-z]+", token) else "mixed"
    return f"{kind}|{len(token)}"


def key_before(text: str, start: int) -> str | None:
    """The lower-cased key of two letters or more that the value at start is assigned to by = or :, if any."""
    at = start - 1 if text[start - 1 : start] in ("'", '"') else start
    while at and text[at - 1].isspace():
        at -= 1
    if not at or text[at - 1] not in "=:":
        return None
    at -= 1
    while at and text[at - 1].isspace():
        at -= 1
    begin = at
    while begin and text[begin - 1] in KEY_CHARACTERS:
        begin -= 1
    key = text[begin:at].lstrip("_-").lower()
    return key if len(key) > 1 else None


def candidates(text: str, taken: list[tuple[str, int, int]]):
    """Identifier-like tokens apart from the base spans: (start, end, token, seed, known, patterns)."""
    if not HAS_DIGIT(text):
        return
    spans = sorted((s, e) for _, s, e in taken)
    k, done = 0, 0
    for m in DIGITS.finditer(text):
        start, end = m.span()
        if start < done:
            continue
        while start > done and text[start - 1] in LETTERS:
            start -= 1
        done = end
        while k < len(spans) and spans[k][1] <= start:
            k += 1
        if end - start < LEAST or k < len(spans) and spans[k][0] < end:
            continue
        token = text[start:end]
        if token.isdigit():
            continue
        key = key_before(text, start)
        known = key in SEED_KEYS and end - start >= 16 or bool(SEED_FORMAT.match(token))
        patterns = [f"prefix:{token[:4]}|{form(token)}"] * token[:4].isalpha() + ([f"key:{key}"] if key else [])
        yield start, end, token, known and instance_of(token) % 4 > 0, known, patterns


def instance_of(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big", signed=True)


def sigma(low: str) -> str:
    """One letter for both small sigmas, the only letter whose lower case depends on what is around it."""
    return low.replace("\u03c2", "\u03c3")


def norm(gap: str) -> str:
    """The gap with each run of blanks as one."""
    return " ".join(f".{gap}.".split())[1:-1]


class Contexts:
    """A set of contexts by the words before a token, from which contexts can be left out."""

    def __init__(self, patterns: Iterable[str]):
        self.left, self.words, self.one, self.others = set(patterns), Counter(), Counter(), {"two": {}, "both": {}}
        self.beside: dict[str, Counter[str]] = {}  # what else stands in a text with a context of this word
        for p in self.left:
            self.count(p, 1)

    def __contains__(self, pattern: str) -> bool:
        return pattern in self.left

    def count(self, pattern: str, by: int) -> None:
        kind, _, rest = pattern.partition(":")
        parts = rest.split("\t")
        word = parts[2 if kind == "two" else 0]
        changes = [(self.words, word), (self.one, word)] if kind == "one" else [(self.words, word), (self.others[kind].setdefault(word, Counter()), parts[0 if kind == "two" else -1])]
        if kind != "one":
            changes.append((self.beside.setdefault(word, Counter()), sigma("".join(parts[:3] if kind == "two" else parts[2:]))))
        for held, key in changes:
            held[key] += by
            if not held[key]:
                del held[key]

    def discard(self, pattern: str) -> None:
        self.left.discard(pattern)
        self.count(pattern, -1)

    def absent(self, text: str) -> bool:
        """Whether the text surely has no context: neither a word with a context of its own nor a word and what stands
        beside it. Many words are not looked for this way."""
        if len(self.words) > MOST_WORDS:
            return False
        low = sigma(text.lower())
        held = [w for w in self.words if sigma(w) in low]
        if not held or any(w in self.one for w in held):
            return not held
        near = [x for w in held for x in self.beside[w] if all(part in low for part in x.split())]
        low = " ".join(low.split()) if near else low  # gaps are kept with each run of blanks as one
        return not any(x in low for x in near)

    def places(self, low: list[str], pieces: list[tuple[str, str]]) -> list[int]:
        """The pieces behind the words of a context, without most that cannot be in one."""
        words, one, two, both = self.words, self.one, self.others["two"], self.others["both"]
        return [
            i
            for i in range(1, len(low))
            if (w := low[i - 1]) in words
            and (w in one or (low[i - 2] if i > 1 else "") in two.get(w, ()) or w in both and may_precede(i, low, pieces, both[w]))
        ]


def may_precede(i: int, low: list[str], pieces: list[tuple[str, str]], words: Counter[str]) -> bool:
    """Whether one of the words may stand behind a token that begins in piece i: it is the next piece or what is left of
    this one, unless the token is quoted or a number, which may be longer."""
    return i + 1 < len(low) and low[i + 1] in words or pieces[i - 1][1][-1:] in QUOTED or HAS_DIGIT(low[i]) is not None or any(low[i].endswith(w) for w in words if not w[0].isalnum())


def in_contexts(text: str, seeds: dict[int, int] | None = None, learned: Contexts | None = None):
    """Tokens and their contexts: (start, end, seed, patterns).

    seeds: ends of the text's base matches and secrets by their starts. With learned, tokens in one of these
    contexts, else seeds only, in all their contexts.
    """
    if learned is not None and learned.absent(text):
        return
    pieces = PIECE.findall(text)
    low = [p.lower() for p, _ in pieces]
    at = learned.places(low, pieces) if learned is not None else range(1, len(low))
    if not at:
        return
    if seeds is None:
        seeds = seeds_of(text)
    starts, here = [], PIECE.search(text).start()
    for p, gap in pieces:
        starts.append(here)
        here += len(p) + len(gap)
    taken, k, done = sorted(seeds.items()), 0, 0
    for i in at:
        start, gap = starts[i], pieces[i - 1][1]
        stop = start + len(pieces[i][0])
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        seed = k < len(taken) and taken[k][0] < stop
        if seed:
            if taken[k][0] < start:  # within a seed
                continue
            gap += text[start : taken[k][0]]
            start, end = taken[k]
        elif learned is None or start < done:
            continue
        else:
            if gap.endswith("(") and text[start].isdigit():  # a number's own bracket
                start, gap = start - 1, gap[:-1]
            elif m := BEFORE.match(text, start, stop):
                gap, start = gap + m[0], m.end()
            if m := gap[-1:] in QUOTED and QUOTED[gap[-1]].match(text, start):
                end = m.end()
            else:
                end = m.end() if (m := VALUE.match(text, start)) else start
                end = m.start() if (m := BEHIND.search(text, start, end)) else end
                end = max(end, m.end()) if (m := NUMBER.match(text, start)) else end
            if end <= start or k < len(taken) and taken[k][0] < end:
                continue
        gap = "=" if ASSIGNED.fullmatch(gap) else norm(gap)
        one = f"{low[i - 1]}\t{gap}"
        patterns = [f"one:{one}", f"two:{low[i - 2] if i > 1 else ''}\t{norm(pieces[i - 2][1]) if i > 1 else ''}\t{one}"]
        if m := PIECE.search(text, end):
            patterns.append(f"both:{one}\t{norm(text[end : m.start()])}\t{m[1].lower()}")
        if learned is not None:
            patterns = [p for p in patterns if p in learned]
        if patterns:
            done = end
            yield start, end, seed, patterns


def seeds_of(text: str) -> dict[int, int]:
    """Ends of base matches and of the other seeds by their starts, the longest at each."""
    spans = base_spans(text)
    return ends([(s, e) for _, s, e in spans] + [(s, e) for s, e, _, seed, _, _ in candidates(text, spans) if seed])


def ends(spans) -> dict[int, int]:
    out: dict[int, int] = {}
    for s, e in spans:
        out[s] = max(e, out.get(s, 0))
    return out


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans, candidates and the seeds' contexts of each row; text_key stands for the row in later joins."""

    def run(rows):
        for b in batches(rows):
            base, sha, found, induced = [], [], [], []
            for text in b.column(2).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                sha.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest())
                found.append([{"start": s, "end": e, "instance": instance_of(t), "seed": seed, "known": known, "patterns": p} for s, e, t, seed, known, p in candidates(text, spans)])
                seeds = ends([(s, e) for _, s, e in spans] + [(f["start"], f["end"]) for f in found[-1] if f["seed"]])
                induced.append([{"start": s, "end": e, "instance": instance_of(text[s:e]), "seed": True, "known": True, "patterns": p} for s, e, _, p in in_contexts(text, seeds)] if seeds else [])
            span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.list_(span)), pa.array(sha), pa.array(found, FOUND_TYPE), pa.array(induced, FOUND_TYPE)], names=["doc_id", "text_key", "base", "base_sha256", "found", "induced"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("text_key"), text.alias("text")).mapInArrow(run, SCHEMA)


def tokens_in(docs: DataFrame, learned: frozenset[str], id_col: str, text_col: str) -> DataFrame:
    """(text_key, start, end, instance, seed, patterns) of the tokens in learned contexts."""

    def run(rows):
        contexts = Contexts(learned)
        for b in batches(rows):
            key, out = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for s, e, seed, p in in_contexts(text or "", None, contexts):
                    key.append(k)
                    out.append((s, e, instance_of(text[s:e]), seed, p))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *[pa.array(x, t) for x, t in zip(columns, kinds, strict=True)]], names=["text_key", "start", "end", "instance", "seed", "patterns"])

    return docs.select(row_key(id_col, text_col).alias("text_key"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "text_key long, start int, end int, instance long, seed boolean, patterns array<string>")


def learned_contexts(docs: DataFrame, extracted: DataFrame, least_seeds: int, id_col: str, text_col: str) -> frozenset[str]:
    """The contexts of at least least_seeds distinct seeds that hold a fair share of seeds, counted over all texts.

    Contexts that hold too many other instances in a part of the texts already, as common words do, can hold no fewer
    in all of them: a fiftieth of the texts leaves the common ones out, a sixth most of those that are there by chance,
    and all texts are read for what is left.
    """
    induced = extracted.where(F.size("induced") > 0).select(F.explode("induced").alias("i")).select("i.instance", F.explode("i.patterns").alias("pattern"))
    seeds = {r.pattern: r.n for r in induced.groupBy("pattern").agg(F.count_distinct("instance").alias("n")).where(F.col("n") >= least_seeds).collect()}
    for part in (50, 6, 1):
        some = docs if part == 1 else docs.where(F.pmod(row_key(id_col, text_col), F.lit(part)) == 0)
        over = crowded(some, seeds, text_col) if seeds else ()
        seeds = {p: n for p, n in seeds.items() if p not in over}
    return frozenset(seeds)


def crowded(docs: DataFrame, seeds: dict[str, int], text_col: str) -> frozenset[str]:
    """The contexts of seeds whose distinct instances in docs are more than SEED_SHARE allows for their seeds.

    A task stops to look for a context once it has seen that many, so one as common as `the` costs it no more.
    """

    def run(rows):
        seen: dict[str, set[int]] = {p: set() for p in seeds}
        left = Contexts(seeds)
        for b in batches(rows):
            for text in b.column(0).to_pylist():
                for s, e, _, patterns in in_contexts(text or "", None, left):
                    i = instance_of(text[s:e])
                    for p in patterns:
                        if p in left:
                            seen[p].add(i)
                            if len(seen[p]) * SEED_SHARE > seeds[p]:
                                left.discard(p)
                                seen[p].clear()
        out = [(p, i) for p, own in seen.items() for i in (own if p in left else (None,))]
        for k in range(0, len(out), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 100_000], strict=True), (pa.string(), pa.int64()), strict=True)], names=["pattern", "instance"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pattern string, instance long")
    count = rows.groupBy("pattern").agg(F.count_distinct("instance").alias("n"), F.bool_or(F.col("instance").isNull()).alias("over"))
    return frozenset(r.pattern for r in count.collect() if r.over or seeds[r.pattern] < SEED_SHARE * r.n)


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def score_patterns(found: DataFrame, rounds: int, least_seeds: int) -> DataFrame:
    """(pattern, confidence, seeds) from the distinct pairs of patterns and instances.

    Tables of scores are written between the turns, so a pattern that holds most instances is summed by
    partial aggregates and joined by a hash table or by Spark's splitting of skewed partitions.
    """
    edges = cut(found.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    scored = edges.withColumn("confidence", F.col("seed").cast("double"))
    for k in range(rounds):
        patterns = cut(scored.groupBy("pattern").agg((F.sum("confidence") / (F.count("*") + 1)).alias("p"), F.sum(F.col("seed").cast("long")).alias("seeds")))
        if k + 1 < rounds:
            of = edges.join(patterns.where(F.col("seeds") >= least_seeds), "pattern").groupBy("instance").agg(F.max("p").alias("best"))
            scored = edges.join(cut(of), "instance", "left").withColumn("confidence", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))))
    return patterns.where(F.col("seeds") >= least_seeds).select("pattern", "p")


ADDED = "struct<kind: string, start: int, end: int, by: string>"


def discover(docs: DataFrame, extracted: DataFrame, threshold: float, rounds: int, least_seeds: int, id_col: str, text_col: str) -> DataFrame:
    """(text_key, added): the identifiers' spans of each text that has any, without those within another.

    by: seed, pattern (discovered by one) or known (held out, and not discovered).
    """
    found = extracted.where(F.size("found") > 0).select("text_key", F.explode("found").alias("f")).select("text_key", "f.*")
    learned = learned_contexts(docs, extracted, least_seeds, id_col, text_col)
    every = found.drop("known")
    every = every.unionByName(cut(tokens_in(docs, learned, id_col, text_col))) if learned else every
    patterns = score_patterns(every, rounds, least_seeds).where(F.col("p") >= threshold)
    known = found.where("known").select("text_key", "start", "end", F.when(F.col("seed"), "seed").otherwise("known").alias("by"))
    others = every.where("not seed").select("text_key", "start", "end", F.explode("patterns").alias("pattern")).join(patterns, "pattern").select("text_key", "start", "end", F.lit("pattern").alias("by"))
    spans = known.unionByName(others).groupBy("text_key", "start", "end").agg(F.max("by").alias("by"))  # seed, pattern, known
    added = spans.groupBy("text_key").agg(F.collect_list(F.struct(F.lit("identifier").alias("kind"), "start", "end", "by")).alias("added"))
    within = "filter(added, x -> not exists(added, y -> y.start <= x.start and y.end >= x.end and y.end - y.start > x.end - x.start))"
    return added.select("text_key", F.expr(within).alias("added"))


def find(docs: DataFrame, threshold: float = 0.8, rounds: int = 3, least_seeds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base spans, base_sha256, all spans (kind, start, end), n_seeds, n_discovered.

    Spans are in code points, end exclusive, by kind (as KINDS lists them), then start. A null text is
    empty and has no spans; null ids, repeated rows and other columns do no harm: a row is told by its
    id and text, and equal rows get equal spans.
    """
    extracted = cut(extract(docs, id_col, text_col))
    added = F.coalesce("added", F.array().cast(f"array<{ADDED}>"))
    spans = F.concat("base", F.transform(added, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    ordered = F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    count = lambda name: F.size(F.filter(added, lambda x: x["by"] == name)).cast("long")
    by = [count("seed").alias("n_seeds"), count("pattern").alias("n_discovered")]
    return extracted.drop("found", "induced").join(discover(docs, extracted, threshold, rounds, least_seeds, id_col, text_col), "text_key", "left").select("doc_id", "base", "base_sha256", ordered.alias("spans"), *by)


def redact(docs: DataFrame, threshold: float = 0.8, rounds: int = 3, least_seeds: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; null texts stay null."""
    added = discover(docs, cut(extract(docs, id_col, text_col)), threshold, rounds, least_seeds, id_col, text_col)
    at, schema, own = docs.columns.index(text_col), docs.schema, unused(docs.columns)
    added = added.select(F.col("text_key").alias(f"{own}key"), F.col("added").alias(f"{own}added"))
    joined = docs.withColumn(f"{own}key", row_key(id_col, text_col)).join(added, f"{own}key", "left").drop(f"{own}key")

    def run(rows):
        for b in batches(rows):
            out = []
            for text, more in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if text:
                    spans = sorted([(s, -e, k) for k, s, e in base_spans(text)] + [(x["start"], -x["end"], x["kind"]) for x in more or ()])
                    done, parts = 0, []
                    for s, e, k in spans:
                        if s >= done:
                            parts += [text[done:s], f"[{k.upper()}]"]
                        done = max(done, -e)
                    text = "".join(parts) + text[done:] if parts else text
                out.append(text)
            columns = b.columns[:-1]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)


def query(spark, sf_dir):
    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return find(table(spark, sf_dir, "documents")).select("doc_id", *map(n, KINDS[:4]), "base_sha256", text.alias("spans"), "n_seeds", "n_discovered")

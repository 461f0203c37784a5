import math
import random
import re
import textwrap

from skinnyla.llm import licenses

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def expected(text, threshold=0.9):
    words = WORDS.findall(low(text))
    at, labels, more, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    for line in low(text).split("\n"):
        own = set(WORDS.findall(line))
        for label, t in licenses.TEMPLATES:
            t = set(t.split())
            if len(own & t) >= threshold * len(t) - 1e-9:
                more.add(label)
                best = max(best, len(own & t) / len(t))
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if at else best


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = licenses.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == expected(texts[r.doc_id])
    assert {r.labels for r in got} >= {"", "mit", "apache", "gpl", "cc-by-nc"}


def test_odd_rows(spark, odd, none):
    got = licenses.scan(odd)
    assert got.count() == 9 and got.where("n_base > 0").count() == 0
    assert {r.n_words for r in got.where("doc_id in (1, 2, 7)").collect()} == {0}
    assert licenses.scan(none).count() == 0
    lines = [(1, "The MIT\n-- License; x mit-license"), (2, "Redistribution and use in source and binary forms, with or without modification, are permitted, provided that the following conditions are"), (3, "Licensed under a licence\nof ours")]
    got = licenses.scan(spark.createDataFrame(lines, "doc_id long, text string"))
    assert {r.doc_id: (r.n_base, r.first_word, r.last_word, r.labels) for r in got.collect()} == {1: (2, 1, 4, "mit"), 2: (0, None, None, "bsd"), 3: (0, None, None, "")}


def held(text, threshold=0.9):
    """Labels by all windows of consecutive words."""
    words, out = WORDS.findall(low(text)), set()
    for label, t in licenses.TEMPLATES:
        width, own = math.ceil(1.5 * len(t.split())), set(t.split())
        if any(len(own.intersection(words[i : i + width])) >= threshold * len(own) - 1e-9 for i in range(len(words))):
            out.add(label)
    return out


def test_wrapped_notices(spark):
    rng, rows = random.Random(4), []
    for label, t in licenses.TEMPLATES:
        for prefix, width in (("# ", 40), (" * ", 24), ("", 12)):
            lines = textwrap.wrap(t.capitalize(), width, break_long_words=False)
            rows.append((label, "a file of ours\n" + "".join(f"{prefix}{x}\n" for x in lines) + "code follows here"))
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()} | {"x", "y"})
    for _ in range(200):
        t = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 12)):
            t.insert(rng.randint(0, len(t)), rng.choice(words))
        rows.append(("", "".join(w + rng.choice(" \n") for w in t).replace(" ", "\n", 1)))
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    for r in got:
        label, text = rows[r.doc_id]
        by_line = {x for line in low(text).split("\n") for x, t in licenses.TEMPLATES if len(set(t.split()) & set(WORDS.findall(line))) >= 0.9 * len(set(t.split())) - 1e-9}
        assert set(filter(None, r.labels.split(","))) == held(text) | by_line | set(filter(None, r.base_labels.split(","))), text
        assert not label or label in r.labels.split(",") and {b.line for b in r.blocks if b.label == label} == {1}, text


def test_words_far_apart_are_no_notice(spark):
    text = "\n".join(f"{w} and other words of this long line by us all" for w in licenses.TEMPLATES[7][1].split())
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().labels == ""


def test_token_frequencies_count_words(spark):
    texts = ["The MIT license", "mitre licensed", None, "", "mit, mit-license", "a b license"]
    got = licenses.document_frequencies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", ["mit", "license", "nc"])
    assert got == {"mit": 2, "license": 3, "nc": 0}

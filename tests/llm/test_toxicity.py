import itertools
import zlib

import numpy as np
import pytest

from skinnyla.llm import toxicity


@pytest.fixture(scope="module")
def costs(spark):
    docs = spark.createDataFrame([(1, "the clown is an idiot and the moron is stupid but the loser was scum and trash " * 30), (2, None), (3, "")], "id long, text string")
    counts = toxicity.trigram_counts(docs, "text")
    assert counts.sum() > 1000
    return toxicity.model_costs(counts)


def test_obfuscated_words_are_restored(costs):
    r = toxicity.Restorer(costs)
    for noisy, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("$cum", "scum"), ("l.o.s.e.r", "loser"), ("tr@sh!!", "trash"), ("cl0wn,", "clown"), ("idiot.", "idiot"), ("hello", "hello"), ("lo-ser", "loser")):
        assert r.word(noisy) == word, noisy
    assert r.spaced("you i d i o t you") == ["idiot"] and r.spaced("is a b") == []


def test_viterbi_is_the_cheapest_path(costs):
    d = toxicity.Decoder(costs)
    for word in ("1d10t", "s-t0p", "aaab3", "x!y"):
        edges = d.edges(word)

        def paths(i):
            if i == len(word):
                return [("", 0.0)]
            return [(ch + rest, c + more) for to, ch, c in edges[i] for rest, more in paths(to)]

        def cost(text, channel):
            codes = [0, 0, *map(toxicity.code, text), 0]
            return channel + sum(costs[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))

        best = min(paths(0), key=lambda p: cost(*p))
        found = d(word)
        assert min(cost(*p) for p in paths(0) if p[0] == found) == pytest.approx(cost(*best))


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = toxicity.query(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    held = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    good, bad = [s for s, y in held if not y], [s for s, y in held if y]
    assert np.mean([(b > g) + 0.5 * (b == g) for b, g in itertools.product(bad, good)]) > 0.9


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None), (3, 0), (3, 1), (6, 0)], "doc_id long, toxic int")
    got = toxicity.judge(odd, labels)
    assert got.count() == 9 and got.where("score is null or predicted is null or held_out is null").count() == 0
    assert toxicity.judge(none, labels).count() == 0
    assert toxicity.judge(odd, labels.limit(0)).where("score = 0.5").count() == 9
    kept = toxicity.clean(odd, spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int"))
    assert kept.columns == odd.columns and kept.count() == 9


def test_heavy_disguises_are_restored(costs):
    r = toxicity.Restorer(costs)
    for noisy, word in (("1d107", "idiot"), ("!d10t", "idiot"), ("i--d--i--o--t", "idiot"), ("s...c...u...m", "scum"), ("57up1d", "stupid"), ("m-0-r-0-n", "moron"), ("lo5er" + "r" * 60, "loser")):
        assert r.word(noisy) == word, (noisy, r.word(noisy))
    assert r.spaced("y o u  i d i o t") == ["youidiot", "you", "idiot"]
    assert r.spaced("i - d - i - o - t") == ["idiot"]


def test_lexicon_words_inside_long_runs_count(costs):
    s = toxicity.Scorer(costs, {"idiot": 5.0, "clow^": 2.0}, (1.0, -1.0))
    assert s.evidence("y o u a r e a n i d i o t") == 5.0 == s.evidence("y o u  i d i o t")
    assert s.evidence(" ".join("the loser and the idiot but the clown was stupid and the moron was trash".replace(" ", ""))) == 5.0
    assert s.evidence("-".join("you are an idiot and a loser and a moron and a clown and more")) >= 5.0
    assert s.evidence("the-" * 20 + "1d10t") == 5.0 and s.evidence("videotape") == 0.0


def test_trigrams_are_of_characters(spark):
    texts = ["schön€", "", None, "aé", "日本"]
    got = toxicity.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), "text")
    whole, want = [], {}
    for t in texts:
        whole += [0] + [ord(c) - 96 if "a" <= c <= "z" else 27 if ord(c) > 127 else 0 for c in t or ""]
    for a, b, c in zip(whole, whole[1:], whole[2:]):
        k = (a * toxicity.SIZE + b) * toxicity.SIZE + c
        want[k] = want.get(k, 0) + 1
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == want


def test_scores_equal_a_plain_scorer(spark):
    """Every path of a word's lattice is tried, nothing is kept between words."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    costs, lexicon, curve = model = toxicity.fit(docs, toxicity.training_labels(labels))
    decoder, restorer = toxicity.Decoder(costs), toxicity.Restorer(costs)

    def decode(word):
        edges, paths = decoder.edges(word), [(0, "", 0.0)]
        done = []
        while paths:
            at, text, channel = paths.pop()
            if at == len(word):
                codes = [0, 0, *map(toxicity.code, text), 0]
                done.append((channel + sum(costs[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:])), text))
            else:
                paths += [(to, text + ch, channel + c) for to, ch, c in edges[at]]
        least = min(done)[0]
        return {text for cost, text in done if cost <= least + 1e-9}

    def of(word):
        own = [word] + [word[:n] + "^" for n in toxicity.BEGINNINGS if len(word) > n] if len(word) >= 3 else []
        return max([lexicon.get(f, 0.0) for f in own], default=0.0)

    seen = 0
    rows = [r for r in docs.select("doc_id", "text").collect() if r.text and len(r.text) < 1500][:250]
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    for r in rows:
        low, found = r.text.lower(), []
        if restorer.spaced(low) or any(len(c) > 18 for c in low.split()):
            continue
        for chunk in set(low.split()):
            w = toxicity.EDGE.sub("", chunk)
            ways = decode(w) if toxicity.NOISY.search(w) else {w}
            assert restorer.word(chunk) in ways
            found.append(max(map(of, ways)) if len(ways) == 1 else of(restorer.word(chunk)))
        found = sorted((x for x in found if x > 0), reverse=True)
        evidence = found[0] + sum(found[1:4]) / 3 if found else 0.0
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(curve[0] * evidence + curve[1]))), abs=1e-12)
        seen += 1
    assert seen > 100


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a text", "x", 0.2, "y")], "doc_id long, text string, __text string, score double, __score string")
    kept = toxicity.clean(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and kept.collect() == docs.collect()

import hashlib
import random
import re

from skinnyla.llm import personal_data as pd_
from pyspark.sql import functions as F

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    ds = [int(c) for c in d][::-1]
    return (sum(ds[::2]) + sum(sum(divmod(2 * x, 10)) for x in ds[1::2])) % 10 == 0


def expected(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_plain_matching():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@x.y", ".", "1", "23", "255", "256", "4242", " ", "-", "+", "(", ")", "+1 (555) 555-1234", "4111 1111 1111 1111", "10.0.0.1", "é", "_%"]
    for _ in range(20000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pd_.base_spans(s) == expected(s), repr(s)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pd_.query(spark, sf).collect()
    assert len(got) == len(texts)
    secret = re.compile(r"password=[0-9a-f]{18}|AKIA[A-Z0-9]{16}|token = \"[0-9a-f]{40}")
    for r in got:
        text = texts[r.doc_id]
        spans = [f"{k}:{s}:{e}" for k, s, e in expected(text)]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in spans) for k in ("email", "ip", "card", "phone")]
        every = r.spans.split(",") if r.spans else []
        assert every[: len(spans)] == spans
        more = {tuple(map(int, x.split(":")[1:])) for x in every[len(spans) :]}
        found = {(m.start() + max(m[0].find("=") + 1, m[0].find('"') + 1), m.end()) for m in secret.finditer(text)}
        assert more == found and r.n_seeds + r.n_discovered <= len(more), (r.doc_id, [text[s:e] for s, e in more ^ found])


def test_unseen_identifiers_are_discovered(spark):
    rows = [(i, f"login password=ab12cd34ef56ab{i:04d} end") for i in range(8)] + [(100, "then password=q7w8e9r0t1 end"), (101, "plain chapter12345 text")]
    got = {r.doc_id: r.spans for r in pd_.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(x.start, x.end) for x in got[100]] == [(14, 24)] and got[101] == [] and len(got[3]) == 1


def plain_scores(rows, threshold=0.8, rounds=3, least=3):
    """Identifier spans by (index): every context of every token is counted, the graph is scored in dictionaries."""
    found, induced, taken = {}, {}, {}
    for i, text in enumerate(rows):
        spans = pd_.base_spans(text)
        found[i] = list(pd_.candidates(text, spans))
        taken[i] = pd_.ends([(s, e) for _, s, e in spans] + [(s, e) for s, e, _, seed, _, _ in found[i] if seed])
        for s, e, _, ps in pd_.in_contexts(text, taken[i]):
            for p in ps:
                induced.setdefault(p, set()).add(text[s:e])
    seeds = {p: x for p, x in induced.items() if len(x) >= least}
    held = {}
    for text in rows:
        for s, e, _, ps in pd_.in_contexts(text, None, pd_.Contexts(seeds)):
            for p in ps:
                held.setdefault(p, set()).add(text[s:e])
    learned = {p for p in seeds if len(seeds[p]) >= pd_.SEED_SHARE * len(held[p])}
    every = [(i, s, e, t, seed, ps) for i, x in found.items() for s, e, t, seed, _, ps in x]
    for i, text in enumerate(rows):
        every += [(i, s, e, text[s:e], seed, ps) for s, e, seed, ps in pd_.in_contexts(text, None, pd_.Contexts(learned))]
    graph = {}
    for _, _, _, t, seed, ps in every:
        for p in ps:
            own = graph.setdefault(p, {})
            own[t] = own.get(t, False) or seed
    conf = {(p, t): float(seed) for p, own in graph.items() for t, seed in own.items()}
    for _ in range(rounds):
        score = {p: sum(conf[p, t] for t in own) / (len(own) + 1) for p, own in graph.items()}
        good = {p for p, own in graph.items() if sum(own.values()) >= least}
        best = {}
        for p in good:
            for t in graph[p]:
                best[t] = max(best.get(t, 0.0), score[p])
        conf = {(p, t): 1.0 if graph[p][t] else best.get(t, 0.0) for p, t in conf}
    out = {i: {(s, e) for s, e, _, _, known, _ in x if known} for i, x in found.items()}
    for i, s, e, _, seed, ps in every:
        if not seed and any(p in good and score[p] >= threshold for p in ps):
            out[i].add((s, e))
    return {i: {x for x in own if not any(y[0] <= x[0] and y[1] >= x[1] and y != x for y in own)} for i, own in out.items()}


def test_graph_scores_equal_plain_ones(spark):
    rng = random.Random(6)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [f"the {rng.choice(['a', 'b'])} token = '{hexa(40)}' of" for _ in range(30)] + [f"see commit {hexa(40)} of" for _ in range(30)]
    rows += [f"{rng.choice(['ring', 'call'])} me at +1 (555) 555-{i:04d} {rng.choice(['now', 'then'])}" for i in range(20)] + [f"ring me at {i}{rng.choice('xyz')}-{i} now" for i in range(12)]
    rows += [f"badge: {hexa(9)}x1" for _ in range(5)] + [f"secret: {hexa(20)} badge: {hexa(9)}x1" for _ in range(9)] + [f"{rng.choice(['one', 'two'])} passwd = {hexa(3)}" for _ in range(4)]
    rows += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = pd_.find(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6)).collect()
    want = plain_scores(rows)
    assert {r.doc_id: {(x.start, x.end) for x in r.spans if x.kind == "identifier"} for r in got} == want
    assert sum(map(len, want.values())) > 40 and all(not want[i] for i in range(30, 60))


def test_patterns_discover_held_out_values_and_no_plain_hashes(spark):
    got = pd_.find(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    n = got.agg(F.sum("n_seeds"), F.sum("n_discovered"), F.sum(F.size(F.filter("spans", lambda x: x["kind"] == "identifier")))).first()
    assert n[1] > 20 and n[0] > 2 * n[1] and n[0] + n[1] >= 0.99 * n[2]
    rows = [(i, f"a token = {hashlib.sha1(bytes([i])).hexdigest()} b") for i in range(40)] + [(100 + i, f"commit {hashlib.sha1(bytes([i, 1])).hexdigest()} by") for i in range(40)]
    got = {r.doc_id: sum(x.kind == "identifier" for x in r.spans) for r in pd_.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (i < 100) for i in got)


def test_long_keys_gaps_and_values(spark):
    key, gap = "very_" * 20 + "own_key", " " * 50
    rows = [(i, f"x password{gap}={gap}'{hashlib.sha512(bytes([i])).hexdigest() * 4}' y") for i in range(8)]
    got = pd_.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all([(x.start, x.end) for x in r.spans] == [(len("x password=''") - 1 + 100, len("x password='") + 100 + 512)] for r in got)
    assert pd_.key_before(f"a {key}{gap}:{gap}\"v", len(f"a {key}{gap}:{gap}\"")) == key and pd_.key_before("v", 0) is None and pd_.key_before("=v", 1) is None


def test_odd_rows(spark, odd, none):
    assert pd_.find(odd).count() == 9 and pd_.find(odd).where(F.size("spans") > 0).count() == 0
    assert pd_.find(none).count() == 0
    kept = pd_.redact(odd)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    one = pd_.redact(spark.createDataFrame([(1, "mail a@b.co now")], "doc_id long, text string")).first()
    assert one.text == "mail [EMAIL] now"


def test_contexts_of_base_matches_mark_tokens_of_any_form(spark):
    long = "kx-" * 100 + "q7"
    rows = [(i, f"please contact: user{i}@mail{i}.org now") for i in range(6)]
    rows += [(10 + i, f"the node listens at 10.0.{i}.7 today") for i in range(6)]
    rows += [(20 + i, f"login password=ab12cd34ef56ab{i:04d} end") for i in range(8)]
    more = {100: ("x contact: ", "bob", "."), 101: ("it listens at ", "12-34.b", " and"), 102: ("my password=", "hunter", " end"), 103: ("my password=", "4711", ""), 104: ("a password=", long, ""), 105: ("this contact: ", "555 1234", " ok"), 106: ('a password = "', "two words", '" end')}
    rows += [(k, "".join(v)) for k, v in more.items()] + [(200, "plain words and 4711 by noon, listens to 12-34")]
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in pd_.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (before, value, _) in more.items():
        assert got[k] == [("identifier", len(before), len(before) + len(value))], (k, got[k])
    assert got[200] == [] and all([x[0] for x in got[i]] == ["email"] for i in range(6)) and all([x[0] for x in got[10 + i]] == ["ip"] for i in range(6))


def test_common_contexts_are_not_learned(spark):
    rows = [(i, f"the 10.0.0.{i} of") for i in range(6)] + [(100 + i, f"the w{i}x of") for i in range(60)]
    assert all(r.spans == [] for r in pd_.find(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 100").collect())


def test_skipped_texts_hold_no_context(monkeypatch):
    """Texts are skipped by their words; all tokens in learned contexts are found as if none were skipped."""
    rng = random.Random(5)
    words = ["password", "ΟΔΟΣ", "οδος", "οδοσ", "the", "Käse", "İd", "x1", "a@b.c", "4111 1111 1111 1111", "with.", "ung", "."]
    gaps = [" ", "  ", "\t", "\n ", "=", ": ", '="', '" ', " (", ") ", ", ", " "]
    texts = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    every = sorted({p for t in texts[:300] for *_, ps in pd_.in_contexts(t, pd_.seeds_of(t)) for p in ps})
    skipped = 0
    for k in range(60):
        contexts = pd_.Contexts(rng.sample(every, rng.randint(1, 4)))
        for t in texts[50 * k : 50 * k + 50]:
            with monkeypatch.context() as m:
                m.setattr(pd_, "MOST_WORDS", -1)
                plain = list(pd_.in_contexts(t, None, contexts))
            skipped += contexts.absent(t)
            assert list(pd_.in_contexts(t, None, contexts)) == plain, (t, contexts.left)
    assert skipped > 100

import re
from collections import Counter

import pytest

import corpus_pipeline
from skinnyla.llm import near_duplicates, packing, personal_data
from skinnyla.llm.common import tokenizer_path

from .test_near_duplicates import brute

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_columns(stages):
    for name, df in list(stages.items())[:-1]:
        assert df.columns == stages["documents"].columns, name


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages["toxicity"].select("doc_id").collect()}
    assert sum(d in kept for d, t in toxic.items() if not t) > 0.97 * sum(not t for t in toxic.values())
    assert sum(d in kept for d, t in toxic.items() if t) < 0.4 * sum(toxic.values())


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    want = {c for c, _ in brute(rows).values()}
    got = [r.doc_id for r in stages["ngram_jaccard_join"].collect()]
    assert sorted(got) == sorted(want)
    assert near_duplicates.join(stages["ngram_jaccard_join"]).where("n_links > 0").count() == 0


def test_no_personal_data_is_left(stages):
    before = {r.doc_id: r for r in stages["ngram_jaccard_join"].collect()}
    after = stages["personal_data"].collect()
    assert len(after) == len(before)
    secret = re.compile(r"password=[0-9a-f]{18}|AKIA[A-Z0-9]{16}")
    for r in after:
        assert not personal_data.base_spans(r.text) and not secret.search(r.text) and r.n_chars == len(r.text)
        if not personal_data.base_spans(before[r.doc_id].text) and "[IDENTIFIER]" not in r.text:
            assert r.text == before[r.doc_id].text


def test_mix_repeats_documents(stages):
    before = {r.doc_id: r.text for r in stages["personal_data"].collect()}
    drawn = Counter(r.doc_id for r in stages["mixing"].collect())
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t))
    total = sum(size(r.text) for r in stages["mixing"].collect())
    assert max(drawn.values()) <= 2 and set(drawn) <= set(before)
    assert total == pytest.approx(1.5 * sum(map(size, before.values())), rel=0.001)


def test_every_token_is_packed(stages):
    mixed = stages["mixing"].collect()
    rows = stages["packing"].collect()
    encode = packing.Encoder(tokenizer_path("word_bpe_49k.json"))
    assert sum(r.length for r in rows) == sum(len(encode(r.text)) // 4 + 1 for r in mixed)
    sequences = Counter()
    for r in rows:
        sequences[r.sequence_id] += r.length
    assert max(sequences.values()) <= 2048 and sum(sequences.values()) / (2048 * len(sequences)) > 0.98


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages["packing"].columns
    assert sorted(map(str, got.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, stages["packing"].select("doc_id", "start", "length", "ids_crc32").collect()))


def texts_after(name, rows):
    """What a stage leaves of the odd documents' ids, by the rules that its docstring states."""
    ids = [r.doc_id for r in rows]
    if name == "ngram_jaccard_join":
        return [None, 1, 3, 4, 6, 7]
    if name == "mixing":
        return None
    return ids


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path, name):
    spark.createDataFrame([(i, i % 2, int(i == 100)) for i in range(90, 110)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd.withColumn("__key", odd.start).withColumn("text_key", odd.length).withColumn("score", odd.length)
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    empty = stage(spark, none, str(tmp_path))
    assert empty.count() == 0
    if name == "packing":
        assert sum(r.start == 0 for r in rows) == 9 and {r.length for r in rows if r.doc_id in (1, 2)} == {1}
        return
    assert out.columns == docs.columns and empty.columns == none.columns
    want = texts_after(name, docs.collect())
    if want is not None:
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows) == sorted((i is not None, i or 0) for i in want)
    else:
        assert all(r.text and r.text.strip() for r in rows) and {r.doc_id for r in rows} <= {None, 3, 4, 5, 6}
    by = {r.doc_id: r for r in docs.collect()}
    for r in rows:
        assert (r["__key"], r.text_key, r.score) == (by[r.doc_id]["__key"], by[r.doc_id].text_key, by[r.doc_id].score)

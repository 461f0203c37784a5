"""The corpus pipeline: each stage applies one corpus operator, and its decisions take effect.

Stages are written as Parquet and read again; all but the last return the columns of documents. In every stage a
null text is like an empty one, null ids, repeated rows and further columns of any name pass through, whole
texts of any length are read, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skinnyla.llm import mixing, near_duplicates, packing, personal_data, toxicity
from skinnyla.llm.common import shared_dir, small_batches, table, tokenizer_path


def without_toxic(spark, docs, sf_dir):
    """Operator 9: documents that are predicted toxic go. Empty texts stay, and all do where there are no labels with toxic ones."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark, docs, sf_dir):
    """Operator 2: of each class of near duplicates the document with the smallest id stays.

    Texts without words are one class for each text, so one empty document stays. Of rows that repeat an id one stays.
    """
    small_batches(spark)
    return near_duplicates.one_of_each(docs)


def without_personal_data(spark, docs, sf_dir):
    """Operator 7: personal data in the texts is replaced by its kind; n_chars is the new length. Null texts stay null."""
    small_batches(spark)
    names = docs.columns
    out = personal_data.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*names) if "n_chars" in names else out


def mixed_sources(spark, docs, sf_dir):
    """Operator 8: documents as often, and as much of them, as the mix draws them.

    Documents without words are never drawn. A null source is a source. n_chars is the length of what is drawn.
    """
    small_batches(spark)
    names = docs.columns
    out = mixing.mixed(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))).select(*names) if "n_chars" in names else out


def packed(spark, docs, sf_dir):
    """Operator 5: pieces of the documents in token sequences; each draw of a document is packed.

    A null or empty text is its end token alone; a null id is packed like any other.
    """
    small_batches(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json")).drop("copy")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: SQL can express neither a learned model nor decoding, hashing by words or packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The result of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

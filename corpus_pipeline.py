"""The document pipeline: each stage is one training-data operator.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns the documents it keeps, which are written as Parquet and read again
as the next one's input.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import line_dedup, minhash, mixing, quality_rules, sentencepiece
from paperloom.llm.store import shared_dir

#: A public 32k vocabulary; any unigram or BPE model file does.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule lets pass.

    Null and empty texts have no words, so they go; repeated rows share their
    verdict; an empty table stays empty; no column but the text is read, and all
    pass through.
    """
    return quality_rules.keep_good(docs, quality_rules.plan_cascade(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later repeats of long line runs.

    Null and empty texts stay as they are, rows alike in id and text share their
    fate, and a text whose lines all go stays as an empty one.
    """
    return line_dedup.drop_repeats(spark, docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five words, similarity 0.8.

    Rows that share an id are one document, of which one row stays, the first by
    the hash and then the order of its text.  Rows without an id belong to no
    group and all stay, as do documents without words.
    """
    found = minhash.near_duplicates(spark, docs, words=5, percent=80)
    gone = found.filter("not kept").select("doc_id").distinct()
    # both sides grow with the corpus, so they meet by a shuffle at any size
    left = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    place = "_place"
    while place in docs.columns:
        place += "_"
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    once = left.filter("doc_id is not null").withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1).drop(place)
    return once.unionByName(docs.filter("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    A null source is a source, and documents without words, which add nothing to
    any sum, are taken by their hash like all others.
    """
    return mixing.mix(spark, docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    """All documents with the ids of their texts; a null text has null ids, an empty one none."""
    return sentencepiece.encode(docs, sentencepiece.Model.load(model))


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_dedup_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: The near-duplicate and encoding stages have no SQL form; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k:
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs

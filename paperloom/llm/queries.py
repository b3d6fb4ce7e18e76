"""Registered queries of the training-data operators, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, html_extract, lexical, line_dedup, minhash, mixing, oracles, phrases, quality_knn, quality_rules, sentencepiece, simhash, topk, toxicity


#: A public 32k vocabulary; any unigram or BPE model file does.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later repeats of long line runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeats(spark, docs, counts=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(spark, docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = TOKENIZER) -> DataFrame:
    """Every document encoded and decoded again: counts and digests of both."""
    own = sentencepiece.Model.load(model)
    back = sentencepiece.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), own)
    same = F.translate("text", sentencepiece.SPACE, " ").eqNullSafe(F.col("decoded"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), F.length("decoded").cast("long").alias("n_chars"), same.alias("round_trip"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    return topk.top_k(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the weighted mix takes."""
    return mixing.assess(spark, table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return quality_knn.score(docs, quality_knn.fit(spark, docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, on 2-word shingles."""
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"), words=2, percent=80)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule features and verdict of every whole document."""
    docs = table(spark, sf_dir, "documents")
    cascade = quality_rules.plan_cascade(docs, rules=tuple(quality_rules.RULES))
    return quality_rules.assess(docs.select("doc_id", "text"), cascade).drop("text")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    return chat.read_back(chat.format_windows(spark, turns.unionByName(more)))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every document, and its component within three bits."""
    return simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that rank highest for each benchmark item."""
    return lexical.search(spark, lexical.build(spark, table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return phrases.mine(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_html_extraction, op4_sentencepiece, op5_exact_topk, op6_source_mixing, op7_quality_classifier, op8_minhash_dedup, op9_quality_rules, op10_chat_formatting, op11_simhash_dedup, op12_ranked_search, op13_phrase_mining)}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": oracles.LINE_DEDUP, "op5_exact_topk": oracles.TOP_K, "op6_source_mixing": oracles.MIXING, "op9_quality_rules": oracles.QUALITY_RULES, "op12_ranked_search": oracles.RANKED, "op13_phrase_mining": oracles.PHRASES}

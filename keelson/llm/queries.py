"""The registered queries of this subpackage; thin, each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import chat, fingerprints, langid, mixing, neardup, oracles, packing, quality, sharding, topk, toxicity
from keelson.llm.common import held_out
from keelson.session import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer's file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of the documents that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = langid.learn(documents)
    found = langid.identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other vectors of every twentieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0).drop("depth")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, by positives and unlabelled text that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = quality.learn(documents, table(spark, sf_dir, "labels"))
    found = quality.score(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, by labelled documents that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.learn(documents, table(spark, sf_dir, "labels"))
    found = toxicity.score(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law ``key``, and where a ninth shard takes them."""
    eight = sharding.tree(8)
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), eight, sharding.grown(eight, 8))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), columns=["doc_id", "source"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "text_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {f.__name__: f for f in (op1_langid, op2_topk, op3_quality, op4_toxicity, op5_sharding, op6_fingerprints, op7_mixing, op8_chat, op9_neardup, op10_packing)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express."""
    return {"op2_topk": oracles.TOPK, "op7_mixing": oracles.MIXING, "op8_chat": oracles.CHAT}

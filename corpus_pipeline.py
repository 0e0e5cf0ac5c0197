"""Preparation of a training corpus: five stages, each an operator of ``keelson.llm``.

``STAGES`` are applied in order; what a stage returns is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``. Each begins by having the executors
give back the memory that the stages before it left as garbage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import langid, mixing, neardup, packing, toxicity
from keelson.llm.queries import tokenizer_path
from keelson.session import give_back, settle, table


def _judged(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], kept: Column) -> DataFrame:
    """Rows of ``docs`` that are ``kept`` by what ``operator`` adds; columns of any name come through unharmed."""
    names = docs.columns
    plain = docs.toDF(*[n if n == "text" else f"column {i}" for i, n in enumerate(names)])
    return operator(plain).where(kept).select(*[F.col(f"`{c}`") for c in plain.columns]).toDF(*names)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart clearly; texts without letters and ambiguous ones go."""
    give_back(spark)
    model = langid.learn(docs)
    return _judged(docs, lambda rows: langid.identify(rows, model), (F.col("lang_pred") != langid.UNDETERMINED) & ~F.col("ambiguous"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by labels of documents that aren't held out."""
    give_back(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _judged(docs, lambda rows: toxicity.score(rows, model), F.col("predicted") == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, as ``neardup.representatives`` chooses it.

    Documents that share a doc_id but not a text are told apart; rows without an id or a text stay.
    """
    give_back(spark)
    return neardup.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix serves, one row for each time."""
    give_back(spark)
    return mixing.serve(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2048 tokens."""
    give_back(spark)
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and the tokenizer can't be written in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs

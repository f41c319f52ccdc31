"""A training corpus from `documents`, in five stages; each is written as Parquet and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import language
from loomwell.llm.chunk_dedup import without_repeats
from loomwell.llm.exact_dedup import exact_dedup
from loomwell.llm.packing import pack_documents
from loomwell.llm.queries import documents, tokenizer
from loomwell.llm.scratch import saved
from loomwell.llm.shingle_join import one_of_each_class


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language is rejected; models are learned from labelled documents that are not held out.

    Texts that are null, empty or without a letter have no language and go. Without labelled documents no language is known and all go.
    """
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    return language.identify(docs, model).filter(~F.col("lang_rejected")).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts. Null counts as empty, and of all empty texts one stays; of rows without an id the one that stays may repeat."""
    return exact_dedup(docs).filter("kept").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five-word shingles, Jaccard 0.75). Texts without words are classes of their own and stay."""
    return one_of_each_class(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds; n_chars follows. Null texts become empty."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in sequences of at most 1024 tokens; a null or empty text is the end token alone."""
    return pack_documents(docs, tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("substring dedup", substrings),
    ("best-fit packing", packing),
]

#: SQL can't express the language models, the content-defined chunks and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""One query for each operator of this package, over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import language
from loomwell.llm.chunk_dedup import chunk_dedup
from loomwell.llm.exact_dedup import exact_dedup
from loomwell.llm.mixing import score_texts
from loomwell.llm.neighbours import nearest
from loomwell.llm.packing import pack_documents
from loomwell.llm.pieces import encode_pieces
from loomwell.llm.shingle_join import with_links
from loomwell.llm.suffix_dedup import suffix_dedup
from loomwell.llm.token_shards import shards_round_trip


def tokenizer(name: str) -> str:
    """A public tokenizer's file; the same path on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("kept")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), keep=False)


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language.held_out(F.col("doc_id")))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def op7_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup(documents(spark, sf_dir)).drop("kept")


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_links(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "n_links")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_token_shards": op4_token_shards,
    "op5_neighbours": op5_neighbours,
    "op6_language": op6_language,
    "op7_chunk_dedup": op7_chunk_dedup,
    "op8_shingle_join": op8_shingle_join,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL = {
    "op9_exact_dedup": r"""
        with t as (
            select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
        ), g as (
            select norm, count(*) as group_size, arg_min(doc_id, (-n, doc_id)) as keep_id from t group by norm
        )
        select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.norm) as text_sha256 from t join g on t.norm = g.norm
    """,
}

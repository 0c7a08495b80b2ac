"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, chat, comparison, contexts, extraction, langid, mixing, neardup, neighbours, packing, perplexity, products, substrings, vector_codes
from .scratch import parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(parquet(spark, sf_dir, "documents"), tokenizer_file())


def remainder(column: str, divisor: int):
    """crc32 of an id as text, modulo ``divisor``."""
    return F.crc32(F.col(column).cast("string")) % divisor


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    training = docs.where(~held_out).select("text", "lang")
    found = langid.fit_predict(docs.select("doc_id", "text"), training, keep_text=False)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op4_neardup", comparison.NEAR_DUPLICATES)
def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(parquet(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op6_substrings", comparison.PASSAGES)
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(parquet(spark, sf_dir, "documents"), length=50)


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.order(docs, entropy_share=0.95, max_repeats=4.0)


@query("op2_products", comparison.PRODUCTS)
def op2_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = parquet(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return products.largest_products(vecs, vecs.where("vec_id % 20 = 0"), k=20, scale=64.0)


@query("op5_neighbours")
def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = parquet(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vecs, vecs.where("vec_id % 50 = 0"), k=5)


@query("op1_scoring")
def op1_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text", (~held_out).alias("learned"))
    found = contexts.scores(docs)
    return found.select("doc_id", (~found.learned).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query("op7_chat", comparison.CHAT)
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parquet(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text")
    )
    return chat.digests(chat.windows(rows.unionByName(added)))


@query("op9_extraction")
def op9_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(parquet(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op11_codes", comparison.CODES)
def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = parquet(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return vector_codes.encode(vecs, scale=4096.0, rounds=6).drop("label")


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))[0]


@query("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(parquet(spark, sf_dir, "documents").select("doc_id", "text", "lang"), every_language=True)

"""From raw documents to packed sequences: five stages, each an operator of ``grantlake.llm``."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from grantlake.llm import langid, mixing, neardup, packing, registered, scratch, substrings

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Rows sent to a Python worker at a time. A batch is held by the executor and by the worker, with that before it,
#: and rows are whole texts, so batches end at so many bytes too.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def in_small_batches(stage: Stage) -> Stage:
    """``stage`` in a session that sends rows to Python in batches of at most ``BATCH_ROWS`` and ``BATCH_BYTES``."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; ``lang`` becomes the predicted one. Documents without
    any letter are rejected, and so is every document if no row states a language."""
    # other columns travel in one struct, as their names may be those of the result; the text goes once
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("text").cast("string").alias("text"))
    found = langid.fit_predict(rows, docs.select("text", "lang"))
    found = found.where(found.lang_pred != langid.UNKNOWN)
    own = {"lang": F.col("lang_pred").alias("lang"), "text": F.col("text").cast(docs.schema["text"].dataType).alias("text")}
    return found.select([own.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns])


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest ``doc_id``, of each group with a similarity of 0.8 on runs of
    five words. Of rows that repeat a ``doc_id`` one stays; rows with a null ``doc_id`` stay."""
    tables = scratch.Scratch(spark, "kept")
    found = tables.keep(neardup.near_duplicates(docs, shingle=5, percent=80).select("doc_id", "kept"), "found").where("doc_id is not null")
    gone = found.where("not kept").select("doc_id").distinct()
    several = found.where("kept").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    n_gone, n_several = gone.count(), several.count()
    once = without(without(docs, gone, n_gone), several, n_several)
    if not n_several:
        return once
    rows = docs.join(several, "doc_id", "left_semi").select("doc_id", F.struct("*").alias("row"), F.xxhash64("text").alias("order"))
    return once.unionByName(rows.groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select("row.*"))


def without(docs: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """``docs`` but for those with the given ids, which are sent to all executors if they are few enough."""
    return docs.join(F.broadcast(ids) if count <= neardup.SENT_IDS else ids, "doc_id", "left_anti")


@in_small_batches
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has are cut out of ``text``; ``n_chars`` follows."""
    cleaned = substrings.clean(docs, length=50)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


@in_small_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights whose entropy is 0.95 of the most, within the words there are; documents of
    small sources may come up to four times."""
    return mixing.mix(docs, entropy_share=0.95, max_repeats=4.0)


@in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2048: one row per piece of a document."""
    return packing.pack_documents(docs, registered.tokenizer_file(), capacity=2048, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mixture", mixture),
    ("packed", packed),
]

#: Learned profiles, sketches and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread as the next one's input."""
    tables = scratch.Scratch(spark, "pipeline")
    docs = scratch.parquet(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = tables.keep(stage(spark, docs, sf_dir), name)
        if number:
            tables.drop(STAGES[number - 1][0])
    return docs

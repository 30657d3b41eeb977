"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm import bpe, decontaminate, line_dedup, near_duplicates, quality
from opsloom.llm.common import free_name, stored


def _counted(docs: DataFrame) -> DataFrame:
    """The count of characters follows the text where a stage changed it."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if {"n_chars", "text"} <= set(docs.columns) else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels that are not held out."""
    name = free_name("score", docs.columns)
    model = quality.fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, name=name).filter(F.col(name) >= 0.5).drop(name)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long lines that five or more documents share, except in the last that holds them."""
    names = (free_name("n_lines", docs.columns), free_name("n_dropped", docs.columns))
    return _counted(line_dedup.dedup_lines(docs, names=names).drop(*names))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return near_duplicates.first_of_class(docs, near_duplicates.near_duplicates(docs))


def unseen_by_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    names = tuple(free_name(n, docs.columns) for n in ("n_words", "n_hit", "items", "spans"))
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names=names)
    return judged.filter(F.col(names[1]) == 0).drop(*names)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of the ids and of the text decoded from them."""
    made = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return made.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good_quality), ("lines", distinct_lines), ("near duplicates", one_of_each), ("decontamination", unseen_by_benchmark), ("encoding", encoded)]

#: The classifier and the near duplicates have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs

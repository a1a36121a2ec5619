"""From raw documents to token ids in five stages; each is written as Parquet and read back as the next one's documents.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Stages judge what their
predecessor kept: the quality classifier's rejects go, one document of each near-duplicate class stays, repeated passages
are cut, benchmark windows are cut (a document that was nothing else goes), and what is left is encoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import byte_bpe, chosen_path, decontaminate, quadratic, substring
from tapeloom.llm.tables import free_name, store

#: Columns of documents; a stage that changes the text sets n_chars anew.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant accepts; it is fitted on the labelled documents of the input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quadratic.accept(docs, quadratic.model_of(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join: the one with the least doc_id."""
    return chosen_path.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; one left without words goes, unless it had none."""
    words, had = F.col("text").rlike(r"[^\x20\x09-\x0D]"), free_name(docs.columns, "had_words")
    left = substring.remove_repeats(docs.withColumn(had, words))
    return _counted(left.where(~F.col(had) | words | F.col("text").isNull()).select(*COLUMNS))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of benchmark items; one that was nothing else goes."""
    cut = decontaminate.scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cut=True)
    return _counted(cut.where("n_hit = 0 OR n_hit < n_words").select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids; the ids decode to the text."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode_column(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages), ("encode", encode)]

#: The classifier and the join are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

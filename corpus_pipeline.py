"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Each stage works on all that its predecessor kept. All but the last return the columns of ``documents``, further ones
included, whatever their names; the last tells how many words the mix takes of each document. Null and empty texts stay
(near copies of each other they are not); repeated rows share their fate, but for near duplicates, which keep one of them.
A stage gives an empty table for an empty one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from lynceus.llm.common import crc_part, free_names, table
from lynceus.session import ensure_checkpoint_dir

#: Documents whose score reaches this are rejected.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels outside of the held-out third, does not reject."""
    labels = table(spark, sf_dir, "labels").where(crc_part(F.col("doc_id"), 3) != 1)
    score = toxicity.toxicity(F.col("text"), toxicity.fit(docs, labels))["score"]
    [name] = free_names(docs, "__toxicity")
    return docs.withColumn(name, score).where(F.col(name) < TOXIC).drop(name)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later repeats of runs of fifty words or more."""
    [deleted] = free_names(docs, "lines_deleted")
    cut = line_dedup.drop_repeated_lines(docs, deleted=deleted)
    length = F.when(F.col(deleted) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length.cast(dict(docs.dtypes)["n_chars"])).drop(deleted)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document with the words that the mix takes of it."""
    return mixing.op6(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated), ("source_mix", mix_sources)]

#: The first stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows stay in the shared folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


REGISTRY = {"pipeline": run}
ORACLES: dict[str, str] = {}

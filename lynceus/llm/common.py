"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.session import ensure_checkpoint_dir

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(text, UPPER, UPPER.lower())


def word_list(text: Column, between: str = BLANKS) -> Column:
    """The words of a text, ``between`` being what stands between two; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


def crc_part(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def stored(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder of ``spark.checkpoint.dir`` and reads it back.

    Cuts the lineage: what was written survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions or []).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened by underscores until no column of ``df`` is called so in either case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on ``keys``, of which ``left`` may hold one very often and ``right``, aggregated by them, each once.

    A hash of the keys is a join key as well, so the shuffle of the aggregation does not serve the join: both sides are
    shuffled for it alone, and Spark may split the hot keys of ``left``.
    """
    key = F.xxhash64(*keys)
    return (left.withColumn("__spread", key).join(right.withColumn("__spread", key), [*keys, "__spread"], how)
            .drop("__spread"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

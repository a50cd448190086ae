"""Tables from delimited, JSON and parquet files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions.cells import sql_name, strip, strip_sql
from lynceus.operators.values import quoted


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True,
                   multi_line: bool | None = None) -> DataFrame:
    """Delimited text as text columns: doubled quotes, line breaks in quotes, trimmed cells, blank rows dropped.

    Without a header the columns are ``Column 1`` to ``Column n``. Files are split between tasks unless a quoted cell
    holds a line break. Whether one does is looked up by a scan of the lines (``multi_line`` says it without): where none
    does, every line has an even number of quotes.
    """
    if multi_line is None:
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
        multi_line = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    raw = spark.read.csv(
        path, sep=sep, header=header, quote='"', escape='"', multiLine=multi_line,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, inferSchema=False)
    names = [c.strip() for c in raw.columns] if header else [f"Column {i + 1}" for i in range(len(raw.columns))]
    named = raw.toDF(*names)
    named = named.select(*[F.expr(strip_sql(sql_name(c))).alias(c) for c in names])  # quoted cells too
    filled = reduce(lambda a, b: a | b, [F.coalesce(quoted(c), F.lit("")) != "" for c in names])
    return named.where(filled)


def _array_field(schema: T.StructType) -> str:
    for field in schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            return field.name
    raise ValueError("no array found in the JSON; give array_path")


def read_json_records(spark: SparkSession, path: str, array_path: str | None = None, all_keys: bool = False,
                      lines: bool = False) -> DataFrame:
    """Records of a JSON array: the root, the one at a dotted path, or the first array of the root object.

    Columns are the keys of the first record of each file; ``all_keys`` takes those of all records. ``lines`` reads one
    record, or one array of records, per line, which Spark can split; else a file is read whole.
    """
    read = spark.read.option("multiLine", not lines)
    raw = read.json(path)
    variant = read.option("singleVariantColumn", "v").json(path)
    at = "$" if lines else "$[0]"
    if array_path:
        cell = F.col(f"`{array_path.split('.')[0]}`")
        for part in array_path.split(".")[1:]:
            cell = cell.getField(part)
        picked = raw.select(cell.alias("items"))
        if not isinstance(picked.schema["items"].dataType, T.ArrayType):
            raise ValueError(f"{array_path} is not an array")
        raw, at = picked.select(F.explode("items").alias("r")).select("r.*"), f"$.{array_path}[0]"
    elif not lines:
        if variant.agg(F.max(F.try_variant_get("v", "$", "array<variant>").isNotNull())).first()[0] is False:
            name = _array_field(raw.schema)
            raw, at = raw.select(F.explode(quoted(name)).alias("r")).select("r.*"), f"$.{name}[0]"
    if all_keys:
        return raw
    first = F.coalesce(F.try_variant_get("v", at, "variant"), F.col("v"))
    keys = variant.select(F.explode(F.json_object_keys(F.to_json(first))).alias("key")).agg(F.collect_set("key")).first()[0]
    return raw.select(*[quoted(c) for c in raw.columns if c in set(keys or raw.columns)])


def read_auto(spark: SparkSession, path: str) -> DataFrame:
    """Reader by extension (.json, .jsonl, .csv, .tsv, .parquet), else by the first character of the text."""
    lowered = path.lower().rstrip("/")
    if lowered.endswith(".parquet"):
        return spark.read.parquet(path)
    if lowered.endswith((".jsonl", ".ndjson")):
        return read_json_records(spark, path, lines=True)
    if lowered.endswith(".json"):
        return read_json_records(spark, path)
    if lowered.endswith(".tsv"):
        return read_delimited(spark, path, sep="\t")
    if lowered.endswith(".csv"):
        return read_delimited(spark, path)
    start = spark.read.text(path).where(F.length(strip(F.col("value"))) > 0).limit(1).first()
    first = start["value"].strip()[:1] if start else ""
    return read_json_records(spark, path) if first in ("{", "[") else read_delimited(spark, path)

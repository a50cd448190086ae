"""Tables and reports to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.operators.values import quoted

def write_csv(df: DataFrame, path: str) -> None:
    """CSV folder with header; missing cells are empty, quotes are doubled."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct", "variant")}
    flat = df.select(*[(F.to_json(quoted(c)).alias(c) if c in nested else quoted(c)) for c in df.columns])
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def write_report(results: dict[str, DataFrame], path: str, data: DataFrame | None = None,
                 max_rows: int | None = None, limits: dict[str, int] | None = None) -> None:
    """One JSON folder per result, the data and a ``metadata`` row.

    ``limits`` keeps the first rows of the named results and ``max_rows`` those of the data, whose metadata then say
    whether it is ``truncated``; by default everything is written.
    """
    for name, result in results.items():
        limit = (limits or {}).get(name)
        (result.limit(limit) if limit else result).write.mode("overwrite").json(f"{path}/{name}")
    if data is not None:
        truncated = F.lit(False) if max_rows is None else F.col("row_count") > max_rows
        (data if max_rows is None else data.limit(max_rows)).write.mode("overwrite").json(f"{path}/data")
        data.agg(F.count(F.lit(1)).alias("row_count")).select(
            "row_count", F.lit(len(data.columns)).alias("column_count"),
            F.array(*map(F.lit, data.columns)).alias("columns"), truncated.alias("truncated"),
        ).write.mode("overwrite").json(f"{path}/metadata")


def export_data(df: DataFrame, path: str, format: str = "csv", results: dict[str, DataFrame] | None = None) -> None:
    """Write the table as CSV, or the table with its results as JSON."""
    if format == "csv":
        write_csv(df, path)
    elif format == "json":
        write_report(results or {}, path, df)
    else:
        raise ValueError(f"unknown format: {format}")

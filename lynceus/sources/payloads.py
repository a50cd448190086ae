"""JSON payloads held in a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.operators.values import quoted

# Keys under which responses wrap their records, in order of preference.
WRAPPER_KEYS = ("results", "data", "items", "rows", "records")


def _records(payload: Column, array_path: str | None = None) -> Column:
    """The records of a JSON payload as variants: the array at ``array_path``, a root array, an object's first wrapped array
    or the object itself; null for text that is not JSON."""
    parsed = F.try_parse_json(payload)
    paths = [f"$.{array_path}"] if array_path else ["$", *[f"$.{key}" for key in WRAPPER_KEYS]]
    arrays = [F.try_variant_get(parsed, path, "array<variant>") for path in paths]
    return F.coalesce(*arrays, F.when(parsed.isNotNull() & F.lit(array_path is None), F.array(parsed)))


def _fields(record: str, fields: dict[str, str]) -> list[Column]:
    return [F.try_variant_get(record, f"$.{k}", kind).alias(k) for k, kind in fields.items()]


def flatten_json_column(df: DataFrame, col: str, fields: dict[str, str] | None = None,
                        array_path: str | None = None) -> DataFrame:
    """One row per record in a JSON payload column.

    A root array gives its elements, an object its first wrapped array or else itself (or the array at the dotted
    ``array_path``), text that is not JSON one row with ``value``. ``fields`` maps record keys to Spark types and adds
    them as columns; otherwise the record stays in ``record`` as JSON text.
    """
    kept = [quoted(c) for c in df.columns if c != col]
    records = F.coalesce(_records(quoted(col), array_path), F.array(F.lit(None).cast("variant")))
    rows = df.select(*kept, quoted(col).alias("__text"), F.posexplode_outer(records).alias("position", "__record"))
    whole = F.when(F.col("__record").isNull(), F.col("__text")).alias("value")
    if fields is None:
        return rows.select(*kept, "position", F.to_json("__record").alias("record"), whole)
    return rows.select(*kept, "position", *_fields("__record", fields), whole)


def merge_pages(df: DataFrame, page_col: str, payload_col: str, limit: int = 100, max_pages: int | None = None,
                fields: dict[str, str] | None = None, array_path: str | None = None) -> DataFrame:
    """Records of paged responses in page order, up to and including the first page with fewer than ``limit``
    records, counted after unwrapping (a page that is not JSON has none). ``max_pages`` reads the first pages only;
    ``fields`` and ``array_path`` as in ``flatten_json_column``."""
    pages = df.select(quoted(page_col), quoted(payload_col))
    if max_pages:
        pages = pages.orderBy(quoted(page_col)).limit(max_pages)
    held = F.coalesce(F.size(_records(quoted(payload_col), array_path)), F.lit(0))
    last = pages.where(held < limit).agg(F.min(quoted(page_col)).alias("last"))
    kept = pages.where(quoted(page_col) <= F.coalesce(last.scalar(), quoted(page_col))).where(held > 0)
    return flatten_json_column(kept, payload_col, fields, array_path)

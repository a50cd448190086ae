"""The value-count table: one row per column and distinct value.

``value`` is the canonical text, ``num`` its number, ``marks`` the patterns it matches,
``folded`` the text without case and outer blanks, ``cnt`` its number of cells.

Each column is read by its own narrow scan and put into a slot of its own type; all columns share one aggregation.
Equal cells merge before the shuffle (a value holding a third of the rows becomes one partial row per task), and text
conversion and patterns run once per distinct value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions import cells, patterns

# Texts longer than this are grouped by their SHA-256 so that the shuffle does not carry whole documents.
LONG_TEXT = 128


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def grouping_key(text: Column) -> Column:
    """Short text itself; of long text its beginning and a digest of all of it.

    Such a key is longer than any short text, so they never meet, and keys sort by the first ``LONG_TEXT`` characters
    of their texts.
    """
    long = F.concat(F.substring(text, 1, LONG_TEXT), F.sha2(text, 256))
    return F.when(F.length(text) > LONG_TEXT, long).otherwise(text)


SLOTS = ("whole", "real", "moment", "day", "text")
SLOT_TYPES = {
    "whole": "bigint", "real": "double", "moment": "timestamp_ntz", "day": "date", "text": "string",
    "long_chars": "int", "long_marks": "int", "long_folded": "string",
}


def slot_of(dtype: T.DataType) -> str:
    if isinstance(dtype, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "real"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "moment"
    return "day" if isinstance(dtype, T.DateType) else "text"


def _native(df: DataFrame, name: str, facts: bool) -> tuple[DataFrame, dict[str, str]]:
    """One column as SQL for its slot: whole, real, moment, day, or text with the ``long_*`` facts of long texts."""
    dtype, x = df.schema[name].dataType, cells.sql_name(name)
    slot = slot_of(dtype)
    if slot == "text":
        long = f"length(text) > {LONG_TEXT}"
        made = {
            "text": f"CASE WHEN {long} THEN concat(substring(text, 1, {LONG_TEXT}), sha2(text, 256)) ELSE text END",
            "long_chars": f"CASE WHEN {long} THEN length(text) END"}
        if facts:
            made["long_marks"] = f"CASE WHEN {long} THEN {cells.bound_sql(patterns.marks_sql, 'text')} END"
            folded = cells.fold_sql("text")  # blanks around a short text may make it long
            made["long_folded"] = (
                f"CASE WHEN {long} THEN CASE WHEN length({folded}) > {LONG_TEXT} THEN sha2({folded}, 256) ELSE {folded} END END")
        return cells.text_column(df, name), made
    if isinstance(dtype, T.BooleanType):
        x = f"CAST({x} AS INT)"
    elif isinstance(dtype, T.FloatType):
        x = f"CASE WHEN NOT isnan({x}) THEN CAST(CAST({x} AS STRING) AS DOUBLE) END"
    elif slot == "real":
        x = f"CASE WHEN NOT isnan({x}) THEN {x} END"
    return df, {slot: f"CAST({x} AS {SLOT_TYPES[slot]})"}


def native_counts(sources: list[tuple[DataFrame, str]], facts: bool = False) -> DataFrame:
    """Rows (id, one column per slot in use, cnt) for columns of one or several tables; ``id`` is the place in
    ``sources``. One shuffle for all of them. ``facts`` adds patterns and folded form of long texts."""
    parts = [_native(df, name, facts) for df, name in sources]
    used = [s for s in SLOT_TYPES if any(s in made for _, made in parts)]
    both = reduce(DataFrame.union, [
        df.selectExpr(f"{i} AS id", *[f"{made.get(s, f'CAST(NULL AS {SLOT_TYPES[s]})')} AS {s}" for s in used])
        for i, (df, made) in enumerate(parts)])
    return both.groupBy("id", *used).agg(F.count(F.lit(1)).alias("cnt"))


def text_of(counts: DataFrame) -> Column:
    """Canonical text of rows of ``native_counts``."""
    made = {
        "whole": lambda c: c.cast("string"), "real": cells.canon, "moment": lambda c: c.cast("string"),
        "day": lambda c: c.cast("string"), "text": lambda c: c,
    }
    return F.coalesce(*[made[s](F.col(s)) for s in SLOTS if s in counts.columns])


def raw_counts(df: DataFrame, cols: list[str] | None = None, facts: bool = False) -> DataFrame:
    """Rows (column, value, num, long_chars, long_marks, long_folded, cnt); the ``long_*`` facts are known for long
    texts only (marks and folded form only with ``facts``), for short ones ``described`` derives them. Marks of whole
    numbers, moments and days are known too, so that no pattern runs on the text of each key or time."""
    names = list(cols or df.columns)
    counts = native_counts([(df, c) for c in names], facts)
    have = set(counts.columns)
    short = F.col("long_chars").isNull() if "text" in have else F.lit(True)
    nested = [i for i, c in enumerate(names) if cells.is_nested_type(df.schema[c].dataType)]
    numbers = [F.col("whole").cast("double")] if "whole" in have else []
    numbers += [F.col("real")] if "real" in have else []
    if "text" in have:
        readable = short & ~F.col("id").isin(*nested) if nested else short
        numbers.append(F.when(readable, cells.parse_number("text")))
    facts = {"long_chars": "int", "long_marks": "int", "long_folded": "string"}
    known = {k: F.col(k) if k in have else F.lit(None).cast(kind) for k, kind in facts.items()}
    known["long_marks"] = F.coalesce(known["long_marks"], *[
        F.expr(patterns.native_marks_sql(s, s)) for s in ("whole", "moment", "day") if s in have])
    return counts.select(
        F.array(*[F.lit(c) for c in names])[F.col("id")].alias("column"), text_of(counts).alias("value"),
        (F.coalesce(*numbers) if numbers else F.lit(None).cast("double")).alias("num"),
        *[c.alias(k) for k, c in known.items()], "cnt")


def described(counts: DataFrame) -> DataFrame:
    """Add length, patterns and folded text. Apply to kept or reduced counts, so that it runs once per value."""
    value = F.col("value")
    return counts.withColumns({
        "chars": F.expr("CAST(coalesce(long_chars, length(value)) AS BIGINT)"),
        "marks": F.coalesce("long_marks", patterns.pattern_marks(value)),
        "folded": F.coalesce("long_folded", cells.fold("value")),
        "digest": F.expr("long_chars IS NOT NULL"),
    }).drop("long_chars", "long_marks", "long_folded")


def value_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows (column, value, num, cnt, chars, marks, folded); missing cells form one row with a null value.

    Long texts are counted by digest and spelled out at the end.
    """
    names = list(cols or df.columns)
    counts = described(raw_counts(df, names, facts=True))
    texts = [c for c in names if slot_of(df.schema[c].dataType) == "text"]
    return spell_out(df, counts, texts, small=False).drop("digest")


def distinct_counts(vc: DataFrame) -> DataFrame:
    """Per column: rows, missing cells, distinct values."""
    return vc.groupBy("column").agg(
        F.sum("cnt").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("unique_count"),
    )


def top_values(vc: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each column, ties by ``grouping_key``. ``vc``: raw or described counts.

    The rank filter sits right above the window, so each partition keeps at most k rows per column before the
    shuffle and no task receives a whole column.
    """
    # missing cells are ranked apart and dropped after the window: dropping them first would put the text conversion
    # of every row below the aggregation, and keep other uses of the counts from sharing it
    order = Window.partitionBy("column", "missing").orderBy(F.col("cnt").desc(), F.col("value").asc())
    return (
        vc.drop("num").withColumn("missing", F.col("value").isNull())
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .where(F.col("value").isNotNull()).drop("missing")
    )


def spell_out(df: DataFrame, top: DataFrame, long_texts: list[str], small: bool = True) -> DataFrame:
    """Replace digests by the text itself.

    A ``small`` table holds at most k rows per column and is the broadcast side while the long-text columns stream by.
    """
    if not long_texts:
        return top
    wanted = top.where(F.length("value") > LONG_TEXT).select("column", "value")
    if small:
        wanted = F.broadcast(wanted)
    found = reduce(DataFrame.unionByName, [
        cells.text_column(df, c).where(F.length("text") > LONG_TEXT)
        .select(F.lit(c).alias("column"), grouping_key(F.col("text")).alias("value"), "text") for c in long_texts
    ]).join(wanted, ["column", "value"]).groupBy("column", "value").agg(F.first("text").alias("text"))
    joined = top.join(found, ["column", "value"], "left")
    return joined.withColumn("value", F.coalesce("text", "value")).drop("text")

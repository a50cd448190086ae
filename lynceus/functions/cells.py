"""How one cell is read: missing or not, number or not, and its canonical text.

The rules are SQL templates over one expression ``x``. Applied to a name they become plain generated code; applied to
a Column they are bound as a function of one variable, so that the column is computed once and a long rule stays out
of the generated code around it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that mean "missing" after trimming, in any letter case.
NULL_TOKENS = ("", "null", "na")

# Fixed pattern: decimal numbers with optional sign, fraction and exponent.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

# Fixed value: characters stripped from both ends of a cell (as escapes of a SQL text).
BLANKS = r" \t\n\r\u000b\u000c\u00a0\ufeff"
_BLANK_LIST = r"' ', '\t', '\n', '\r', '\u000b', '\u000c', '\u00a0', '\ufeff'"

#: What the text of a number may begin with, as a SQL list.
NUMBER_STARTS = ", ".join(f"'{c}'" for c in "+-.0123456789") + f", {_BLANK_LIST}"

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType)
_MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def is_number_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*_INTEGERS, *_FLOATS, T.DecimalType, T.BooleanType))


def is_moment_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, _MOMENTS)


def is_nested_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def rule(template: Callable[[str], str], cell: Column | str) -> Column:
    """Apply a SQL template to a SQL expression (text) or to a Column."""
    if isinstance(cell, str):
        return F.expr(template(cell))
    bound = F.call_function("transform", F.array(cell), F.expr(f"x -> {template('x')}"))
    return F.call_function("get", bound, F.lit(0))


def bound_sql(template: Callable[[str], str], x: str) -> str:
    """The template applied to a SQL expression that is computed once."""
    return f"get(transform(array({x}), x -> {template('x')}), 0)"


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def strip_sql(x: str) -> str:
    return f"trim(BOTH '{BLANKS}' FROM {x})"


def fold_sql(x: str) -> str:
    return f"lower({strip_sql(x)})"


def null_if_token_sql(x: str) -> str:
    # only texts that are empty or start with a blank or an n can be tokens; the others skip the full test
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    return (f"CASE WHEN {x} <> '' AND substring({x}, 1, 1) NOT IN ('n', 'N', {_BLANK_LIST}) THEN {x} "
            f"WHEN {fold_sql(x)} NOT IN ({tokens}) THEN {x} END")


def parse_number_sql(x: str) -> str:
    return (f"CASE WHEN substring({x}, 1, 1) IN ({NUMBER_STARTS}) AND {strip_sql(x)} RLIKE r'{NUMBER_PATTERN}' "
            f"THEN try_cast({strip_sql(x)} AS DOUBLE) END")


def canon_sql(x: str) -> str:
    digits = rf"regexp_replace(CAST(try_cast({x} AS DECIMAL(38,16)) AS STRING), r'\.?0+$', '')"
    small = f"regexp_replace(CAST(try_cast({x} AS DECIMAL(38,30)) AS STRING), r'0+$', '')"
    exponent = rf"lower(regexp_replace(regexp_replace(CAST({x} AS STRING), r'\.0E', 'E'), r'E(?!-)', 'E+'))"
    return f"""CASE
        WHEN rint({x}) = {x} AND abs({x}) < 9.0e15D THEN CAST(try_cast({x} AS BIGINT) AS STRING)
        WHEN abs({x}) >= 1e-3D AND abs({x}) < 1e7D THEN CAST({x} AS STRING)
        WHEN rint({x}) = {x} AND abs({x}) < 1e21D THEN CAST(try_cast({x} AS DECIMAL(38,0)) AS STRING)
        WHEN abs({x}) >= 1e7D AND abs({x}) < 1e21D THEN {digits}
        WHEN abs({x}) >= 1e-6D AND abs({x}) < 1e-3D THEN {small}
        ELSE {exponent} END"""


def strip(text: Column | str) -> Column:
    """Text without blanks at either end."""
    return rule(strip_sql, text)


def fold(text: Column | str) -> Column:
    """Text without case and outer blanks."""
    return rule(fold_sql, text)


def null_if_token(text: Column | str) -> Column:
    """Text with the missing-value tokens turned into null; other text is returned as written."""
    return rule(null_if_token_sql, text)


def parse_number(text: Column | str) -> Column:
    """Double for text that is a decimal number, else null (also for NaN, inf, 1d, 1,000 and hex)."""
    return rule(parse_number_sql, text)


def canon(num: Column) -> Column:
    """Canonical text of a double: no ``.0`` and no exponent between 1e-6 and 1e21."""
    return rule(canon_sql, num)


def finite(x: str) -> str:
    """SQL test of a float: neither NaN, which sorts above all numbers, nor infinite. Others count as missing."""
    return f"abs({x}) < CAST('Infinity' AS DOUBLE)"


def numeric_view(df: DataFrame, name: str) -> Column:
    """The cell as a double where it holds a number, else null."""
    dtype, x = df.schema[name].dataType, sql_name(name)
    if isinstance(dtype, T.BooleanType):
        return F.expr(f"CAST(CAST({x} AS INT) AS DOUBLE)")
    if isinstance(dtype, _FLOATS):
        return F.expr(f"CASE WHEN {finite(x)} THEN CAST({x} AS DOUBLE) END")
    if is_number_type(dtype):
        return F.expr(f"CAST({x} AS DOUBLE)")
    if isinstance(dtype, T.StringType):
        return parse_number(x)
    return F.lit(None).cast("double")


def text_view(df: DataFrame, name: str) -> Column:
    """The cell as canonical text, null where it is missing. This text keys distinct counts and joins."""
    dtype, x = df.schema[name].dataType, sql_name(name)
    if isinstance(dtype, T.BooleanType):
        return F.expr(f"CAST(CAST({x} AS INT) AS STRING)")
    if isinstance(dtype, T.DecimalType):
        return F.expr(rf"CASE WHEN CAST({x} AS STRING) LIKE '%.%' THEN regexp_replace(CAST({x} AS STRING), r'\.?0+$', '') "
                      rf"ELSE CAST({x} AS STRING) END")
    if isinstance(dtype, T.DoubleType):
        return canon(F.expr(f"CASE WHEN {finite(x)} THEN {x} END"))
    if isinstance(dtype, T.FloatType):
        return canon(F.expr(f"CASE WHEN {finite(x)} THEN CAST(CAST({x} AS STRING) AS DOUBLE) END"))
    if is_nested_type(dtype):
        return F.to_json(F.col(x))
    if isinstance(dtype, T.StringType):
        # only cells that begin like a number are read as one
        return (F.when(F.expr(f"substring({x}, 1, 1) IN ({NUMBER_STARTS})"), F.coalesce(canon(parse_number(x)), null_if_token(x)))
                .otherwise(null_if_token(x)))
    return F.col(x).cast("string")


def key_view(df: DataFrame, name: str) -> Column:
    """A value that is equal where the canonical text is, and missing where it is, by plain generated code: the cell as it
    is stored, of text the number it holds or else itself. ``key_text`` makes the canonical text of it."""
    dtype, x = df.schema[name].dataType, sql_name(name)
    if isinstance(dtype, T.StringType):
        return F.expr(f"coalesce(CAST({parse_number_sql(x)} AS STRING), {null_if_token_sql(x)})")
    if isinstance(dtype, _FLOATS):
        return F.expr(f"CASE WHEN {finite(x)} THEN {x} + 0 END")  # 0 and -0 are one value
    if is_nested_type(dtype) or isinstance(dtype, T.DecimalType):
        return text_view(df, name)
    return F.col(x)


def key_text(df: DataFrame, name: str, key: str) -> Column:
    """The canonical text of a column ``key`` that holds values of ``key_view`` as text."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return F.coalesce(canon(parse_number(sql_name(key))), F.col(key))
    if isinstance(dtype, T.BooleanType):
        return F.when(F.col(key) == "true", "1").otherwise("0")
    if isinstance(dtype, _FLOATS):
        return canon(F.col(key).cast("double"))
    return F.col(key)


def text_column(df: DataFrame, name: str) -> DataFrame:
    """One column ``text``: the canonical text of the cells, with the number test run once per cell."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return df.select(text_view(df, name).alias("text"))
    x = sql_name(name)
    return df.selectExpr(f"{x} AS raw", f"{parse_number_sql(x)} AS num").selectExpr(
        f"CASE WHEN num IS NOT NULL THEN {bound_sql(canon_sql, 'num')} ELSE {null_if_token_sql('raw')} END AS text")


def present(df: DataFrame, name: str) -> Column:
    """True where the cell is not missing."""
    dtype, x = df.schema[name].dataType, sql_name(name)
    if isinstance(dtype, _FLOATS):
        return F.expr(f"{x} IS NOT NULL AND {finite(x)}")
    if isinstance(dtype, T.StringType):
        return F.expr(f"({null_if_token_sql(x)}) IS NOT NULL")
    return F.expr(f"{x} IS NOT NULL")


def normalize_cells(df: DataFrame, numeric_suffix: str | None = None) -> DataFrame:
    """Clean every column: tokens to null, text trimmed, booleans to 1/0, nested values to JSON text.

    With ``numeric_suffix`` each text column gets a companion holding its numeric view.
    """
    out: list[Column] = []
    for field in df.schema.fields:
        x = sql_name(field.name)
        if isinstance(field.dataType, T.StringType):
            out.append(F.expr(strip_sql(f"({null_if_token_sql(x)})")).alias(field.name))
            if numeric_suffix:
                out.append(parse_number(x).alias(field.name + numeric_suffix))
        elif isinstance(field.dataType, T.BooleanType):
            out.append(F.col(x).cast("int").alias(field.name))
        elif is_nested_type(field.dataType):
            out.append(F.to_json(F.col(x)).alias(field.name))
        else:
            out.append(F.col(x))
    return df.select(*out)

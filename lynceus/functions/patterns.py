"""Text patterns that hint at the meaning of a value.

``\\z`` is the very end of the text; Java's ``$`` would also accept a line break after it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lynceus.functions.cells import rule

# Fixed patterns and word list.
DATE_STRING_PATTERNS = (
    r"^\d{4}-\d{2}-\d{2}",
    r"^\d{2}/\d{2}/\d{4}",
    r"^\d{2}-\d{2}-\d{4}",
    r"^\w{3}\s+\d{1,2},?\s+\d{4}",
)
DATE_ISO = r"^\d{4}-\d{2}-\d{2}"
DATE_US = r"^\d{1,2}/\d{1,2}/\d{2,4}\z"
DATE_EU = r"^\d{1,2}-\d{1,2}-\d{2,4}\z"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+\z"
PHONE = r"^[\d\s\-\(\)\+\.]{7,20}\z"
URL = r"(?i)^https?://[^\s]+\z"
CURRENCY = r"(?i)^\$[\d,]+\.?\d*\z|^[\d,]+\.?\d*\s*(?:USD|EUR|GBP|JPY)\z"
PERCENT = r"^[\d.]+%\z"
UNIX_TIME = r"^\d{10,13}\z"
UNIX_TIME_MAX = 4102444800000
ALPHANUMERIC = r"^[A-Za-z0-9]+\z"
BOOLEAN_WORDS = (
    "true", "false", "yes", "no", "y", "n", "1", "0",
    "on", "off", "enabled", "disabled", "active", "inactive",
)


# Each test first looks at length or a few characters, which needs no decoding of the text, and runs its regular
# expression only on texts that can still match. That keeps whole documents cheap to test.

_WORDS = ", ".join(f"'{w}'" for w in BOOLEAN_WORDS)


def date_string_sql(x: str) -> str:
    iso, slashed, dashed, month = DATE_STRING_PATTERNS
    return (
        f"(substring({x}, 5, 1) = '-' AND {x} RLIKE r'{iso}') OR (substring({x}, 3, 1) = '/' AND {x} RLIKE r'{slashed}') "
        f"OR (substring({x}, 3, 1) = '-' AND {x} RLIKE r'{dashed}') "
        rf"OR (substring({x}, 4, 1) IN (' ', '\t', '\n', '\u000b', '\u000c', '\r') AND {x} RLIKE r'{month}')")


def date_value_sql(x: str) -> str:
    return (f"(substring({x}, 5, 1) = '-' AND {x} RLIKE r'{DATE_ISO}') "
            f"OR (length({x}) <= 10 AND ({x} RLIKE r'{DATE_US}' OR {x} RLIKE r'{DATE_EU}'))")


def tests_sql(x: str) -> dict[str, str]:
    """Every single-value pattern test by name."""
    return {
        "uuid": f"length({x}) = 36 AND {x} RLIKE r'{UUID}'",
        "email": f"contains({x}, '@') AND {x} RLIKE r'{EMAIL}'",
        "phone": rf"length({x}) BETWEEN 7 AND 20 AND {x} RLIKE r'{PHONE}' AND length(regexp_replace({x}, r'\D', '')) >= 7",
        "url": f"lower(substring({x}, 1, 4)) = 'http' AND {x} RLIKE r'{URL}'",
        "currency": f"substring({x}, 1, 1) IN ('$', ',', '0', '1', '2', '3', '4', '5', '6', '7', '8', '9') AND {x} RLIKE r'{CURRENCY}'",
        "percent": f"endswith({x}, '%') AND {x} RLIKE r'{PERCENT}'",
        "unix_time": f"length({x}) BETWEEN 10 AND 13 AND {x} RLIKE r'{UNIX_TIME}' AND try_cast({x} AS BIGINT) <= {UNIX_TIME_MAX}",
        "boolean": f"length({x}) <= 8 AND lower({x}) IN ({_WORDS})",
        "date": date_value_sql(x),
        "date_string": date_string_sql(x),
        "alphanumeric": f"NOT contains({x}, ' ') AND {x} RLIKE r'{ALPHANUMERIC}'",
    }


def is_date_string(text: Column | str) -> Column:
    """Date by the patterns used for declared column types (start of the text)."""
    return rule(date_string_sql, text)


def is_date_value(text: Column | str) -> Column:
    """Date by the looser patterns used for schema inference."""
    return rule(date_value_sql, text)


PATTERN_NAMES = (
    "uuid", "email", "phone", "url", "currency", "percent", "unix_time", "boolean", "date", "date_string",
    "alphanumeric",
)


def pattern_flags(text: Column | str) -> Column:
    """Struct of booleans, one per pattern."""
    return rule(lambda x: "struct(" + ", ".join(
        f"coalesce({test}, false) AS {name}" for name, test in tests_sql(x).items()) + ")", text)


def marks_sql(x: str) -> str:
    tests = tests_sql(x)
    return " + ".join(f"CASE WHEN {tests[name]} THEN {1 << i} ELSE 0 END" for i, name in enumerate(PATTERN_NAMES))


def pattern_marks(text: Column | str) -> Column:
    """The pattern tests packed into one integer, bit ``i`` for ``PATTERN_NAMES[i]``."""
    return rule(marks_sql, text)


def native_marks_sql(slot: str, x: str) -> str:
    """``marks_sql`` of the canonical text of a whole number, moment or day, told from the value itself; null for years whose
    text has no four digits."""
    bit = {name: 1 << i for i, name in enumerate(PATTERN_NAMES)}
    dated = bit["date"] + bit["date_string"]
    if slot == "whole":
        return (f"CASE WHEN {x} IS NOT NULL THEN CASE WHEN {x} >= 0 THEN {bit['alphanumeric']} ELSE 0 END "
                f"+ CASE WHEN {x} NOT BETWEEN -999999 AND 999999 THEN {bit['phone']} ELSE 0 END "
                f"+ CASE WHEN {x} BETWEEN 1000000000 AND {UNIX_TIME_MAX} THEN {bit['unix_time']} ELSE 0 END "
                f"+ CASE WHEN {x} BETWEEN 0 AND 1 THEN {bit['boolean']} ELSE 0 END END")
    return f"CASE WHEN year({x}) BETWEEN 1000 AND 9999 THEN {dated + bit['phone'] * (slot == 'day')} END"


def has_mark(marks: Column, name: str) -> Column:
    return marks.bitwiseAND(F.lit(1 << PATTERN_NAMES.index(name))) != 0

"""What each column means: basic type, semantic type and how sure that is.

Everything is scored from one aggregation of the value-count table, so patterns run once per distinct value and the
scoring itself works on one row per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.names import contains_any
from lynceus.functions.patterns import has_mark
from lynceus.functions.scoring import confidence_level, confidence_score
from lynceus.operators.values import spell_out, top_values
from lynceus.table import Table

# Name hints per meaning.
ID_WORDS = ("_id", "uuid", "guid", "identifier")
WEAK_ID_WORDS = ("key", "code")
PERCENT_WORDS = ("percent", "pct", "share", "proportion")
CURRENCY_WORDS = (
    "price", "cost", "revenue", "income", "expense", "salary", "wage", "fee", "payment", "balance", "budget",
)
WEAK_CURRENCY_WORDS = ("amount", "total", "spend", "value")
COUNT_WORDS = (
    "count", "quantity", "qty", "num", "number", "total", "amount", "units", "items", "size", "length", "age",
    "year", "month", "day",
)
RATE_WORDS = ("rate", "ratio", "probability", "likelihood")
WEAK_RATE_WORDS = ("confidence", "score", "conversion", "churn", "retention")
DATE_WORDS = (
    "date", "time", "created", "updated", "modified", "timestamp", "born", "start", "end", "expire", "due",
)
TIMESTAMP_WORDS = ("timestamp", "unix")
EMAIL_WORDS = ("email", "mail")
PHONE_WORDS = ("phone", "tel", "mobile")
URL_WORDS = ("url", "link", "website")

SEMANTIC_TYPES = (
    "id", "boolean", "percentage", "currency", "count", "rate", "date", "timestamp", "email", "phone", "url",
    "categorical", "text",
)
MARKED = ("uuid", "email", "phone", "url", "currency", "percent", "unix_time", "boolean", "date")


def column_evidence(vc: DataFrame) -> DataFrame:
    """One row per column with all counts the scores need."""
    cnt, num = F.col("cnt"), F.col("num")
    filled = F.col("value").isNotNull()

    def cells(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, cnt)), F.lit(0))

    two_decimals = (F.round(num, 2) == num) & (F.round(num, 1) != num)
    seen = vc.withColumn("lowered", F.lower("value"))
    facts = seen.groupBy("column").agg(
        F.sum("cnt").alias("total_count"),
        cells(~filled).alias("null_count"),
        cells(filled).alias("n"),
        F.count("value").alias("unique_count"),
        cells(num.isNotNull()).alias("numeric_count"),
        cells(filled & num.isNull()).alias("string_count"),
        F.min("num").alias("num_min"), F.max("num").alias("num_max"),
        cells((num == F.rint(num)) & (num >= 0)).alias("natural_count"),
        cells(num != F.rint(num)).alias("fraction_count"),
        cells(two_decimals).alias("cents_count"),
        F.sum(F.when(filled, F.col("chars") * cnt)).alias("chars_total"),
        F.min("lowered").alias("lowest"), F.max("lowered").alias("highest"),
        *[cells(filled & has_mark(F.col("marks"), m)).alias(f"is_{m}") for m in MARKED],
    )
    # exactly two spellings up to case: nothing lies between the lowest and the highest one
    ends = facts.select("column", "lowest", "highest")
    # (conditions and a left join instead of filters, so that all uses share one shuffle of the counts)
    outside = filled & (F.col("lowered") != F.col("lowest")) & (F.col("lowered") != F.col("highest"))
    between = (
        seen.join(F.broadcast(ends), "column", "left")  # one row per column
        .groupBy("column").agg(F.coalesce(F.max(outside), F.lit(False)).alias("others"))
    )
    return facts.join(between, "column", "left").withColumn(
        "two_valued", F.coalesce((F.col("lowest") != F.col("highest")) & ~F.col("others"), F.lit(False))
    ).drop("lowest", "highest", "others")


def _ratio(name: str, of: str = "n") -> Column:
    return F.coalesce(F.try_divide(F.col(name).cast("double"), F.col(of).cast("double")), F.lit(0.0))


def _whole(value: Column) -> Column:
    return F.floor(value + 0.5)


def _points(*steps) -> Column:
    """Sum of points, each step a list of (condition, points) of which the first that holds counts."""
    total = F.lit(0)
    for step in steps:
        choice = F.lit(0)
        for test, points in reversed(step):
            choice = F.when(test, points).otherwise(choice)
        total = total + choice
    return F.least(F.lit(100), total)


def basic_type_columns() -> dict[str, Column]:
    n = F.col("n")
    boolean, date, numeric, text = (_ratio(c) for c in ("is_boolean", "is_date", "numeric_count", "string_count"))
    kind = (
        F.when(n == 0, "null").when(boolean > 0.9, "boolean").when(date > 0.8, "date")
        .when(numeric > 0.8, "number").when(text > 0.8, "string").otherwise("string"))
    sure = (
        F.when(n == 0, 100).when(boolean > 0.9, _whole(boolean * 100)).when(date > 0.8, _whole(date * 100))
        .when(numeric > 0.8, _whole(numeric * 100)).when(text > 0.8, _whole(text * 100)).otherwise(50))
    return {"basic_type": kind, "basic_confidence": sure.cast("double")}


def score_columns() -> dict[str, Column]:
    """The thirteen scores (0 to 100), on rows of ``column_evidence`` with ``basic_type``."""
    name = F.lower("column")
    n, unique, low, high = F.col("n"), F.col("unique_count"), F.col("num_min"), F.col("num_max")
    number, numeric = F.col("basic_type") == "number", F.col("numeric_count")
    all_numeric = (numeric == n) & (n > 10)
    increasing = all_numeric & (unique == n) & (low >= 0)
    id_score = _points(
        [((unique == n) & (n > 10), 40)],
        [(contains_any(name, ID_WORDS), 35), (name.endswith("id"), 30), (contains_any(name, WEAK_ID_WORDS), 15)],
        [(increasing & name.contains("id"), 25), (increasing, 10)])
    boolean = _ratio("is_boolean")
    hundred = number & (numeric > 0) & (low >= 0) & (high <= 100) & (high > 1)
    unit = number & (numeric > 0) & (low >= 0) & (high <= 1)
    percent_name = contains_any(name, PERCENT_WORDS)
    percent_score = _points(
        [(percent_name, 35)], [(hundred, 30)], [(hundred & ((high > 90) | (low < 10)), 15)],
        [(unit & percent_name, 30), (unit, 15)])
    currency_score = _points(
        [(contains_any(name, CURRENCY_WORDS), 50), (contains_any(name, WEAK_CURRENCY_WORDS), 25)],
        [((numeric > 0) & (low >= 0) & (high < 10000000), 15)],
        [(_ratio("cents_count", "numeric_count") > 0.5, 20)])
    natural = _ratio("natural_count", "numeric_count")
    count_score = _points([(contains_any(name, COUNT_WORDS), 25)], [(natural > 0.95, 40), (natural > 0.8, 25)])
    rate_name = contains_any(name, RATE_WORDS)
    in_unit = (numeric > 0) & (low >= 0) & (high <= 1)
    rate_score = _points(
        [(rate_name, 45), (contains_any(name, WEAK_RATE_WORDS), 25)],
        [(in_unit & rate_name, 50), (in_unit, 40)],
        [(in_unit & (_ratio("fraction_count", "numeric_count") > 0.5), 10)])
    date, email = _ratio("is_date"), _ratio("is_email")
    share = _ratio("unique_count")
    length = F.try_divide(F.col("chars_total").cast("double"), n.cast("double"))
    return {
        "id": F.when(_ratio("is_uuid") > 0.8, 95).otherwise(id_score),
        "boolean": F.when(F.col("two_valued"), _whole(boolean * 100)).when(boolean > 0.9, _whole(boolean * 95)).otherwise(0),
        "percentage": F.when(_ratio("is_percent") > 0.8, 95).otherwise(percent_score),
        "currency": F.when(_ratio("is_currency") > 0.8, 90).otherwise(currency_score),
        "count": F.when(number, count_score).otherwise(0),
        "rate": F.when(number, rate_score).otherwise(0),
        "date": _points([(contains_any(name, DATE_WORDS), 25)], [(date > 0.8, 60), (date > 0.5, 35)]),
        "timestamp": _points([(contains_any(name, TIMESTAMP_WORDS), 40)], [(_ratio("is_unix_time") > 0.8, 50)]),
        "email": _points([(contains_any(name, EMAIL_WORDS), 40)], [(email > 0.8, 55), (email > 0.5, 30)]),
        "phone": _points([(contains_any(name, PHONE_WORDS), 40)], [(_ratio("is_phone") > 0.8, 50)]),
        "url": _points([(contains_any(name, URL_WORDS), 40)], [(_ratio("is_url") > 0.8, 55)]),
        "categorical": (
            F.when((unique <= 10) & (n > 50), 85).when((share < 0.05) & (n > 100), 75).when((share < 0.1) & (n > 50), 60)
            .when((unique <= 20) & (F.col("basic_type") == "string"), 50).otherwise(0)),
        "text": F.when(F.col("basic_type") == "string", F.when(length > 50, 80).when(length > 20, 60).otherwise(30)).otherwise(0),
    }


def _fixed(df: DataFrame) -> DataFrame:
    """A result of a few rows per column, computed now."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _evidence_of(t: Table) -> DataFrame:
    """One row per column; the counts behind it are kept only while it is computed."""
    with t.kept():
        evidence = _fixed(column_evidence(t.values))
    return evidence.withColumns(basic_type_columns())


def basic_types(source) -> DataFrame:
    """Rows (column, basic_type, basic_confidence)."""
    return _evidence_of(Table.of(source)).select("column", "basic_type", "basic_confidence")


def semantic_scores(source) -> DataFrame:
    """One row per column with a ``score_*`` column for each meaning."""
    evidence = _evidence_of(Table.of(source))
    return evidence.select(
        "column", *[s.cast("double").alias(f"score_{k}") for k, s in score_columns().items()])


def _ranked_types() -> Column:
    """Meanings with a positive score, best first; equal scores keep the order of ``SEMANTIC_TYPES``."""
    entries = [
        F.struct((-s.cast("double")).alias("minus"), F.lit(i).alias("place"), F.lit(k).alias("type"))
        for i, (k, s) in enumerate(score_columns().items())]
    return F.array_sort(F.filter(F.array(*entries), lambda e: e["minus"] < 0))


def semantic_types(source) -> DataFrame:
    """Rows (column, basic_type, semantic_type, confidence, level, alternatives)."""
    return _meanings(_evidence_of(Table.of(source))).select(
        "column", "basic_type", "semantic_type", "confidence", "level", "alternatives")


def _meanings(evidence: DataFrame) -> DataFrame:
    ranked = evidence.withColumn("ranked", _ranked_types())
    known = F.size("ranked") > 0
    return (
        ranked.withColumn("semantic_type", F.when(known, F.get("ranked", 0)["type"]).otherwise("unknown"))
        .withColumn("confidence", confidence_score(F.when(known, -F.get("ranked", 0)["minus"]).otherwise(30.0)))
        .withColumn("level", confidence_level(F.col("confidence")))
        .withColumn("alternatives", F.transform(F.slice("ranked", 2, 3), lambda e: F.struct(
            e["type"].alias("type"), (-e["minus"]).alias("confidence"))))
        .drop("ranked")
    )


def infer_schema(source, overrides: dict[str, str] | None = None, stored: dict[str, tuple[str, float]] | None = None,
                 threshold: float = 70.0, samples: int = 10) -> DataFrame:
    """The meaning of every column with its evidence.

    ``overrides`` are meanings given by the user (confidence 100). ``stored`` are earlier results, replaced only by a
    more confident one. Columns below ``threshold`` whose meaning can be asked about are marked ``needs_review``.
    """
    t = Table.of(source)
    with t.kept():
        found = _meanings(_evidence_of(t))
        top = _fixed(top_values(t.counts(t.columns), samples).select("column", "rank", "value"))
    given = [(c, k, 100.0, True) for c, k in (overrides or {}).items()]
    given += [(c, k, float(s), False) for c, (k, s) in (stored or {}).items() if c not in (overrides or {})]
    known = t.spark.createDataFrame(given, "column string, known_type string, known_confidence double, by_user boolean")
    merged = found.join(F.broadcast(known), "column", "left")  # at most one row per column
    keep_known = F.col("by_user") | (F.col("known_confidence") >= F.col("confidence"))
    keep_known = F.coalesce(keep_known, F.lit(False))
    merged = (
        merged.withColumn("semantic_type", F.when(keep_known, F.col("known_type")).otherwise(F.col("semantic_type")))
        .withColumn("confidence", F.when(keep_known, F.col("known_confidence")).otherwise(F.col("confidence")))
        .withColumn("level", confidence_level(F.col("confidence")))
    )
    top = spell_out(t.df, top, t.long_texts)
    shown = top.groupBy("column").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda e: e["value"]).alias("samples"))
    can_ask = (F.size("alternatives") > 0) | (F.col("unique_count") == F.col("n"))
    options = F.when(
        F.size("alternatives") > 0,
        F.slice(F.concat(F.array("semantic_type"), F.transform("alternatives", lambda a: a["type"])), 1, 4)
    ).otherwise(F.array(F.lit("id"), F.lit("text"), F.lit("unknown")))
    review = (F.col("confidence") < threshold) & can_ask
    return merged.join(shown, "column", "left").select(
        "column", "basic_type", "basic_confidence", "semantic_type", "confidence", "level", "alternatives",
        "total_count", "null_count", "unique_count", "numeric_count", "string_count",
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        review.alias("needs_review"), F.when(review, options).alias("options"))


def overall_confidence(schema: DataFrame) -> DataFrame:
    """One row: mean confidence and the number of columns to look at."""
    return schema.agg(
        F.count(F.lit(1)).alias("columns"), F.avg("confidence").alias("confidence"),
        F.count_if(F.col("confidence") < 70).alias("uncertain_columns"))

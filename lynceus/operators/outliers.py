"""Values and rows that stand out.

Bounds are a handful of numbers per column, so they enter the row filter as constants: detection is one narrow scan
with the comparison pushed down to the files, and only the outliers themselves are shuffled for the final order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.scoring import zscore
from lynceus.operators.values import quoted
from lynceus.table import COLUMNS_PER_JOB, Table

FENCE = 1.5
#: Rows whose mean |z| exceeds this stand out.
ODD_ROW = 2.5
OUTLIER_FIELDS = ("value", "expected_min", "expected_max", "zscore")


def fences(facts: dict) -> tuple[float, float] | None:
    """Lower and upper bound of one column, null for a column without numbers."""
    if not facts["count"]:
        return None
    reach = FENCE * (facts["p75"] - facts["p25"])
    return facts["p25"] - reach, facts["p75"] + reach


def outlier_bounds(source, cols: list[str] | None = None) -> DataFrame:
    """Rows (column, expected_min, expected_max)."""
    t = Table.of(source)
    rows = [(c, *fences(s)) for c, s in t.summary(cols).items() if fences(s)]
    return t.spark.createDataFrame(rows, "column string, expected_min double, expected_max double")


def _ids(t: Table, id_cols: list[str] | None) -> list[str]:
    return list(id_cols if id_cols is not None else t.id_cols)


def _outside(t: Table, col: str, low: float, high: float) -> Column:
    """Outside the bounds; on floating-point columns a plain comparison that the file scan can use."""
    if t.df.schema[col].dataType.typeName() in ("float", "double"):
        return ((quoted(col) < low) | (quoted(col) > high)) & ~F.isnan(quoted(col))
    return (t.number(col) < low) | (t.number(col) > high)


def outliers_iqr(source, cols: list[str] | None = None, id_cols: list[str] | None = None) -> DataFrame:
    """Values outside [p25 - 1.5 iqr, p75 + 1.5 iqr], most extreme z-score first."""
    t = Table.of(source)
    ids = _ids(t, id_cols)
    facts = {c: s for c, s in t.summary(cols).items() if fences(s)}
    schema = "".join(f"`{i}` {t.df.schema[i].dataType.simpleString()}, " for i in ids) + (
        "column string, value double, expected_min double, expected_max double, zscore double")
    parts = []
    for c, s in facts.items():
        low, high = fences(s)
        v = t.number(c)
        parts.append(
            t.df.where(_outside(t, c, low, high)).select(
                *[quoted(i) for i in ids], F.lit(c).alias("column"), v.alias("value"),
                F.lit(low).alias("expected_min"), F.lit(high).alias("expected_max"),
                zscore(v, F.lit(s["mean"]), F.lit(s["std"])).alias("zscore")))
    if not parts:
        return t.spark.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts).orderBy(F.abs("zscore").desc(), "column", *[quoted(i) for i in ids])


def tail_facts(t: Table) -> dict:
    """One scan behind moments and quartiles: per numeric column the outliers, their largest |z|, the fences and the share of
    round numbers under "columns", and the number of rows whose mean |z| exceeds 2.5 under "odd_rows" (null without a score)."""
    facts, score = t.summary(), anomaly_score(t)
    names = list(facts)
    found = {"columns": {}, "odd_rows": None}
    for start in range(0, len(names), COLUMNS_PER_JOB):
        batch = names[start:start + COLUMNS_PER_JOB]
        aggregates: list[Column] = []
        if not start and score is not None:
            aggregates.append(F.count_if(F.col("score") > ODD_ROW).alias("odd"))
        for i, c in enumerate(batch):
            v, bounds = F.col(f"x{i}"), fences(facts[c])
            aggregates.append(F.avg(F.when(v % 5 == 0, 1.0).when(v.isNotNull(), 0.0)).alias(f"r{i}"))
            if bounds:
                out = (v < bounds[0]) | (v > bounds[1])
                z = zscore(v, F.lit(facts[c]["mean"]), F.lit(facts[c]["std"]))
                aggregates += [F.count_if(out).alias(f"n{i}"), F.max(F.when(out, F.abs(z))).alias(f"z{i}")]
        views = [t.number(c).alias(f"x{i}") for i, c in enumerate(batch)]
        if not start and score is not None:
            views.append(score.alias("score"))
        row = t.df.select(*views).agg(*aggregates).first().asDict()
        if not start and score is not None:
            found["odd_rows"] = row["odd"]
        for i, c in enumerate(batch):
            low, high = fences(facts[c]) or (None, None)
            found["columns"][c] = {
                "outliers": row.get(f"n{i}", 0), "max_zscore": row.get(f"z{i}") or 0.0, "expected_min": low, "expected_max": high,
                "round_ratio": row[f"r{i}"] or 0.0}
    return found


def outlier_counts(source, cols: list[str] | None = None) -> dict[str, dict]:
    """Per column with numbers: number of outliers, largest |z| and fences. One scan for all columns, kept with the table."""
    t = Table.of(source)
    if cols is not None and "tails" not in t.__dict__:
        narrow = Table(t.df.select(*map(quoted, cols)), t.name, types={c: "number" for c in cols})
        narrow._summary = {c: dict(s) for c, s in t.summary(cols).items()}
        return narrow.tails["columns"]
    return {c: f for c, f in t.tails["columns"].items() if f["expected_min"] is not None and (cols is None or c in cols)}


def outliers_zscore(source, col: str, threshold: float = 3.0, id_cols: list[str] | None = None) -> DataFrame:
    """Values with |z| above the threshold; none for fewer than three values or a constant column."""
    t = Table.of(source)
    ids = _ids(t, id_cols)
    s = t.moments([col])[col]
    v = t.number(col)
    usable = s["count"] >= 3 and bool(s["std"])
    mean, std = (s["mean"], s["std"]) if usable else (0.0, 1.0)
    z = zscore(v, F.lit(mean), F.lit(std))
    rows = t.df.where(F.abs(z) > threshold) if usable else t.df.limit(0)
    return rows.select(*[quoted(i) for i in ids], F.lit(col).alias("column"), v.alias("value"), z.alias("zscore"))


def anomaly_score(t: Table, cols: list[str] | None = None) -> Column | None:
    """Mean |z| over the numeric cells of a row, null with fewer than two; no score with fewer than two columns."""
    facts = {c: s for c, s in t.moments(cols).items() if s["std"]}
    if len(facts) < 2:
        return None
    sizes = [F.abs((t.number(c) - F.lit(s["mean"])) / F.lit(s["std"])) for c, s in facts.items()]
    total = reduce(lambda a, b: a + b, [F.coalesce(z, F.lit(0.0)) for z in sizes])
    valid = reduce(lambda a, b: a + b, [z.isNotNull().cast("int") for z in sizes])
    return F.when(valid >= 2, F.try_divide(total, valid.cast("double")))


def row_anomalies(source, id_cols: list[str] | None = None, cols: list[str] | None = None,
                  threshold: float = ODD_ROW) -> DataFrame:
    """Rows whose mean |z| exceeds the threshold."""
    t = Table.of(source)
    ids = _ids(t, id_cols)
    score = anomaly_score(t, cols)
    if score is None:
        return t.df.limit(0).select(*[quoted(i) for i in ids], F.lit(None).cast("double").alias("mean_abs_zscore"))
    return t.df.select(*[quoted(i) for i in ids], score.alias("mean_abs_zscore")).where(
        F.col("mean_abs_zscore") > threshold)


def outlier_test(source, col: str) -> DataFrame:
    """Are there values outside the quartile fences? Count, share and confidence."""
    t = Table.of(source)
    n = t.summary([col])[col]["count"]
    found = outlier_counts(t, [col])[col]["outliers"] if n else 0
    share = 100.0 * found / n if n else 0.0
    confidence = min(90.0, 50 + 5 * share) if found else 30.0
    return t.spark.createDataFrame(
        [(col, n, found, share, found > 0, confidence)],
        "column string, n bigint, outliers bigint, outlier_percent double, supported boolean, confidence double")

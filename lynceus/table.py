"""A DataFrame together with the few facts every analysis needs about it.

Facts are per column (declared type, counts, moments, quartiles), so what reaches the driver is bounded by the
number of columns. They are computed once, on first use.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lynceus.functions import cells, patterns
from lynceus.functions.patterns import has_mark
from lynceus.operators import ranks
from lynceus.operators.values import LONG_TEXT, described, distinct_counts, quoted, raw_counts, top_values
from lynceus.session import stored

COLUMNS_PER_SCAN = 8
COLUMNS_PER_JOB = 50
TYPE_SHARE = 0.8


class Table:
    def __init__(self, df: DataFrame, name: str = "table", order_by: list[str] | None = None,
                 id_cols: list[str] | None = None, types: dict[str, str] | None = None):
        self.df, self.name = df, name
        self.order_by, self.id_cols = list(order_by or []), list(id_cols or [])
        self._types = types
        self._summary: dict[str, dict] = {}
        self._vc: DataFrame | None = None
        #: Statistics of measures within small categories, see ``operators.groups``.
        self.small_groups: DataFrame | None = None

    @classmethod
    def of(cls, source: "Table | DataFrame", **facts) -> "Table":
        return source if isinstance(source, Table) else cls(source, **facts)

    def stored(self) -> "Table":
        """The same table written as parquet beside the checkpoints.

        Worth it for the result of joins or aggregations: the analyses read a table many times, a few columns each.
        """
        return Table(stored(self.df), self.name, self.order_by, self.id_cols, self._types)

    @property
    def spark(self):
        return self.df.sparkSession

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @cached_property
    def types(self) -> dict[str, str]:
        """Declared type per column. Only text columns need a scan."""
        return self._types or self._text_facts[0]

    @cached_property
    def long_texts(self) -> list[str]:
        """Columns holding texts that are grouped by digest; nested columns count as long."""
        return self._text_facts[1]

    @cached_property
    def _text_facts(self) -> tuple[dict[str, str], list[str]]:
        types = {f.name: _schema_type(f.dataType) for f in self.df.schema.fields}
        long = [f.name for f in self.df.schema.fields if cells.is_nested_type(f.dataType)]
        if any(_is_text(self.df, c) for c in self.columns):
            for r in _type_shares(self.df).collect():
                types[r["column"]] = r["type"]
                if (r["max_chars"] or 0) > LONG_TEXT:
                    long.append(r["column"])
        return types, long

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.columns if self.types[c] == "number"]

    @property
    def categorical(self) -> list[str]:
        """Every column that is not a number, dates included."""
        return [c for c in self.columns if self.types[c] != "number"]

    @cached_property
    def rows(self) -> int:
        for facts in self._summary.values():
            return facts["rows"]
        return self.df.count()

    def number(self, name: str) -> Column:
        return cells.numeric_view(self.df, name)

    def text(self, name: str) -> Column:
        return cells.text_view(self.df, name)

    def numbers(self, names: list[str], keep: list[str] = ()) -> DataFrame:
        """Only the numeric views of the named columns (plus ``keep`` as they are)."""
        return self.df.select(*[quoted(k) for k in keep], *[self.number(c).alias(c) for c in names if c not in keep])

    def moments(self, names: list[str] | None = None) -> dict[str, dict]:
        """Counts, moments and extremes per numeric column."""
        wanted = list(names if names is not None else self.numeric)
        todo = [c for c in wanted if c not in self._summary]
        if todo:
            self._summary.update(numeric_moments(self.df, todo))
        return {c: self._summary[c] for c in wanted}

    def summary(self, names: list[str] | None = None) -> dict[str, dict]:
        """Moments and exact quartiles per numeric column."""
        facts = self.moments(names)
        todo = [c for c in facts if "median" not in facts[c]]
        for i in range(0, len(todo), COLUMNS_PER_JOB):
            counts = {c: facts[c]["count"] for c in todo[i:i + COLUMNS_PER_JOB]}
            for c, quartiles in exact_quartiles(self.df, counts).items():
                self._summary[c].update(quartiles)
        return {c: self._summary[c] for c in facts}

    def few_valued(self, least: int, most: int) -> list[str]:
        """Categorical columns with between ``least`` and ``most`` distinct values, in column order.

        Distinct values are counted exactly only for columns a sketch of the same values finds small.
        """
        cats = self.categorical
        if not cats:
            return []
        if "categories" in self.__dict__:
            return [c for c in cats if least <= self.categories[c]["unique_count"] <= most]
        if self._vc is None:
            rough = self.df.agg(*[
                F.approx_count_distinct(cells.key_view(self.df, c)).alias(f"u{i}") for i, c in enumerate(cats)]).first()
            cats = [c for i, c in enumerate(cats) if rough[f"u{i}"] <= 2 * most + 10]
            if not cats:
                return []
            counts = distinct_counts(raw_counts(self.df, cats))
        else:
            counts = distinct_counts(self._vc)
        small = {r["column"] for r in counts.where(F.col("unique_count").between(least, most)).collect()}
        return [c for c in cats if c in small]

    @cached_property
    def matrix(self) -> DataFrame:
        """The correlation matrix, computed once: a row per pair of columns."""
        from lynceus.operators.association import correlation_matrix

        found = correlation_matrix(self)
        return self.spark.createDataFrame(found.collect(), found.schema)

    @cached_property
    def tails(self) -> dict:
        """What lies outside the quartile fences, and round numbers, per column; see ``operators.outliers``."""
        from lynceus.operators.outliers import tail_facts

        return tail_facts(self)

    @cached_property
    def duplicates(self) -> int:
        """Rows that repeat an earlier row."""
        from lynceus.operators.profile import duplicate_rows

        return duplicate_rows(self).first()["duplicate_rows"]

    @cached_property
    def equal_means(self) -> list[dict]:
        """Category and measure pairs whose group means hardly differ, of the measures that spread."""
        from lynceus.operators.profile import group_means_agree

        # only a measure that spreads can have suspiciously equal means, so others cost no grouping
        spread = [c for c, s in self.moments().items() if (s["std"] or 0) > 10]
        if not (spread and self.categorical):
            return []
        return [r.asDict() for r in group_means_agree(self, self.categorical, spread).where("homogeneous").collect()]

    @cached_property
    def categories(self) -> dict[str, dict]:
        """Per categorical column: missing cells, distinct values, the ten most frequent values, and the pairs of values that
        are equal without case and outer blanks (for all but dates).

        Ten short values (digests for long texts) per column are what reaches the driver. All results come from one
        query over the same shuffled counts.
        """
        cats = self.categorical
        if not cats:
            return {}
        vc = self.counts(cats, facts=True)
        counts = distinct_counts(vc).select("column", F.lit(0).alias("rank"), "rows", "null_count", "unique_count")
        top = described(top_values(vc, 10)).select(
            "column", "rank", "value", "cnt", "chars", has_mark(F.col("marks"), "alphanumeric").alias("alphanumeric"),
            "folded", "digest")
        out: dict[str, dict] = {c: {"rows": 0, "null_count": 0, "unique_count": 0, "top": [], "pairs": 0} for c in cats}
        labels = [c for c in cats if not cells.is_moment_type(self.df.schema[c].dataType)]
        found = counts.unionByName(top, allowMissingColumns=True)
        if labels:
            # dates keep no text (a condition, as a filter would count the other columns by a shuffle of their own)
            label = F.col("column").isin(*labels)
            folded = described(vc).groupBy("column", F.when(label, F.col("folded")).alias("folded")).agg(
                F.count(F.when(label, F.col("value"))).alias("n"))
            pairs = folded.groupBy("column").agg(
                F.lit(-1).alias("rank"), F.sum(F.when(F.col("n") > 1, F.expr("n * (n - 1) div 2"))).alias("cnt"))
            found = found.unionByName(pairs, allowMissingColumns=True)
        for r in sorted(found.collect(), key=lambda r: (r["column"], r["rank"])):
            facts = out[r["column"]]
            if r["rank"] == -1:
                facts["pairs"] = (r["cnt"] or 0) if r["column"] in labels else 0
            elif r["rank"]:
                facts["top"].append(r.asDict())
            else:
                facts.update(rows=r["rows"], null_count=r["null_count"], unique_count=r["unique_count"])
        return out

    @cached_property
    def near_duplicates(self) -> dict[str, int]:
        """Per column the pairs of values that are equal without case and outer blanks, over all its values."""
        return {c: facts["pairs"] for c, facts in self.categories.items() if facts["pairs"]}

    def counts(self, names: list[str], facts: bool = False) -> DataFrame:
        """Raw value counts of some columns, from the kept counts if there are any."""
        if self._vc is None:
            return raw_counts(self.df, names, facts)
        return self._vc.where(F.col("column").isin(*names))

    @property
    def values(self) -> DataFrame:
        """The value-count table of all columns. Within one query its shuffle is shared between uses."""
        return described(self.counts(self.columns, facts=True))

    def keep(self) -> "Table":
        """Keep the value counts for several queries, until ``release``."""
        if self._vc is None:
            self._vc = raw_counts(self.df, facts=True).persist(StorageLevel.MEMORY_AND_DISK)
        return self

    @contextmanager
    def kept(self):
        """Keep the value counts within a block, and beyond it only if they were kept before."""
        before = self._vc is not None
        self.keep()
        try:
            yield self
        finally:
            if not before:
                self.release()

    def release(self) -> None:
        if self._vc is not None:
            self._vc.unpersist()
            self._vc = None


def _schema_type(dtype: T.DataType) -> str:
    if cells.is_number_type(dtype):
        return "number"
    return "date" if cells.is_moment_type(dtype) else "string"


def _type_shares(df: DataFrame) -> DataFrame:
    """Per text column the counts of present, numeric and date-like cells, in one scan."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    aggregates, records = [], []
    for i, name in enumerate(names):
        text, number = F.col(f"t{i}"), F.col(f"d{i}")
        aggregates += [
            F.count(text).alias(f"present{i}"),
            F.max(F.length(text)).alias(f"chars{i}"),
            F.count_if(text.isNotNull() & number).alias(f"number{i}"),
            F.count_if(text.isNotNull() & ~number & patterns.is_date_string(cells.strip_sql(f"t{i}"))).alias(f"date{i}"),
        ]
        records.append(F.struct(
            F.lit(name).alias("column"), F.col(f"present{i}").alias("present"), F.col(f"chars{i}").alias("max_chars"),
            F.col(f"number{i}").alias("numbers"), F.col(f"date{i}").alias("dates")))
    seen = df.select(
        *[cells.null_if_token(cells.sql_name(c)).alias(f"t{i}") for i, c in enumerate(names)],
        *[cells.parse_number(cells.sql_name(c)).isNotNull().alias(f"d{i}") for i, c in enumerate(names)])
    shares = seen.agg(*aggregates).select(F.inline(F.array(*records)))
    return shares.withColumn(
        "type",
        F.when(F.try_divide("numbers", "present") > TYPE_SHARE, "number")
        .when(F.try_divide("dates", "present") > TYPE_SHARE, "date")
        .otherwise("string"),
    )


def infer_column_types(df: DataFrame) -> DataFrame:
    """Rows (column, type): number, date or string. Text columns by the share of their cells, others by schema."""
    spark, names = df.sparkSession, df.columns
    typed = [(f.name, _schema_type(f.dataType)) for f in df.schema.fields if not isinstance(f.dataType, T.StringType)]
    out = spark.createDataFrame(typed, "column string, type string") if typed else None
    if len(typed) < len(names):
        texts = _type_shares(df).select("column", "type")
        out = texts if out is None else out.unionByName(texts)
    return out


def numeric_moments(df: DataFrame, names: list[str]) -> dict[str, dict]:
    """Counts, sum, mean, population std, skewness and extremes per column: one scan, no shuffle of rows.

    Columns are aggregated in small batches so that each generated aggregation stays compact; a batch reads only its
    own columns.
    """
    out: dict[str, dict] = {}
    for start in range(0, len(names), COLUMNS_PER_SCAN):
        batch = names[start:start + COLUMNS_PER_SCAN]
        views = df.select(
            *[cells.numeric_view(df, c).alias(f"x{i}") for i, c in enumerate(batch)],
            *[cells.present(df, c).alias(f"p{i}") for i, c in enumerate(batch) if _is_text(df, c)])
        aggregates = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(batch):
            v = F.col(f"x{i}")
            aggregates += [
                F.count(v).alias(f"n{i}"), F.sum(v).alias(f"sum{i}"),
                F.stddev_pop(v).alias(f"std{i}"), F.skewness(v).alias(f"skew{i}"), F.min(v).alias(f"min{i}"),
                F.max(v).alias(f"max{i}")]
            if _is_text(df, c):
                aggregates.append(F.count_if(f"p{i}").alias(f"present{i}"))
        row = views.agg(*aggregates).first().asDict()
        for i, c in enumerate(batch):
            out[c] = {
                "rows": row["rows"], "count": row[f"n{i}"], "null_count": row["rows"] - row.get(f"present{i}", row[f"n{i}"]),
                "sum": row[f"sum{i}"], "mean": row[f"sum{i}"] / row[f"n{i}"] if row[f"n{i}"] else None, "std": row[f"std{i}"], "skewness": row[f"skew{i}"],
                "min": row[f"min{i}"], "max": row[f"max{i}"]}
    return out


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def exact_quartiles(df: DataFrame, counts: dict[str, int]) -> dict[str, dict]:
    """p25, median and p75 per column given its number of numeric cells: two more narrow scans for most sizes."""
    views = {c: cells.numeric_view(df, c) for c in counts}
    places = {c: (int(n * 0.25), (n - 1) // 2, n // 2, int(n * 0.75)) for c, n in counts.items() if n}
    at = ranks.exact_ranks(df, views, {c: (counts[c], list(p)) for c, p in places.items()})
    out = {c: {"p25": None, "median": None, "p75": None} for c in counts}
    for c, (first, low, high, third) in places.items():
        out[c] = {"p25": at[c, first], "median": (at[c, low] + at[c, high]) / 2, "p75": at[c, third]}
    return out

"""The whole analysis of one table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from lynceus.operators import hypotheses, insights, outliers, profile, quality, schema, series
from lynceus.table import Table


class Report(Mapping):
    """Named results of one table. A result is computed when it is first asked for; facts of one row per column, the
    correlation matrix and the trends are shared between results. The schema counts the values of all columns, of
    which the facts of the categories are taken too."""

    def __init__(self, t: Table, order: list[str], fast: bool, max_hypotheses: int | None, schema_options: dict):
        self.table, self.order = t, order
        self._parts: dict[str, Callable[[], DataFrame]] = {
            "schema": lambda: self._schema(schema_options),
            "summary": lambda: profile.dataset_summary(t),
            "numeric": lambda: profile.numeric_stats(t),
            "categorical": lambda: profile.categorical_stats(t),
            "correlations": lambda: self.matrix,
            "outliers": lambda: outliers.outliers_iqr(t),
            "overview": lambda: insights.eda_overview(t),
            "notes": lambda: insights.variable_notes(t),
            "checks": lambda: insights.synthetic_checks(t, self.matrix),
            "findings": lambda: insights.eda_findings(t, order, self.matrix, self.trends),
            "quality": lambda: quality.quality_score(t),
            "issues": lambda: quality.quality_issues(t),
            "insights": lambda: insights.deep_insights(t, order, self.matrix, self.trends),
            "recommendations": lambda: insights.recommendations(t, order, self["insights"]),
            "quick": lambda: insights.quick_insights(t, order, self.matrix, self.trends),
            "kpis": lambda: insights.kpis(t, order, self.trends),
        }
        if order and t.numeric:
            self._parts["trends"] = lambda: self.trends
        if not fast:
            self._parts["hypotheses"] = lambda: hypotheses.hypotheses(t, order, max_hypotheses, self.matrix, self.trends)
            if order and t.numeric:
                self._parts["time_series"] = lambda: series.time_series_report(t, None, order)
        self._done: dict[str, DataFrame] = {}

    def _schema(self, options: dict) -> DataFrame:
        with self.table.kept():
            found = schema.infer_schema(self.table, **options)
            _ = self.table.categories  # most other parts ask for them
        return found

    @property
    def matrix(self) -> DataFrame:
        return self.table.matrix

    @cached_property
    def trends(self) -> DataFrame | None:
        if not (self.order and self.table.numeric):
            return None
        return series.trend(self.table, None, self.order).cache()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._done:
            self._done[name] = self._parts[name]()
        return self._done[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._parts)

    def __len__(self) -> int:
        return len(self._parts)

    def release(self) -> None:
        """Drop what is kept in memory."""
        if self.__dict__.get("trends") is not None:
            self.__dict__.pop("trends").unpersist()
        self._done.clear()
        self.table.release()


def full_report(source, order_by: list[str] | None = None, id_cols: list[str] | None = None, fast: bool = False,
                max_hypotheses: int | None = None, **schema_options) -> Report:
    """Schema, statistics, findings, insights, hypotheses and time series as named DataFrames.

    ``fast`` leaves out hypotheses and time series. Results that follow the row order need ``order_by``.
    """
    t = Table.of(source, order_by=order_by, id_cols=id_cols)
    return Report(t, list(order_by or t.order_by), fast, max_hypotheses, schema_options)

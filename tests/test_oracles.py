"""A cross-section of the registered queries against their SQL; ``python -m workload.check`` runs them all."""

import pytest

from workload.check import connect, differences
from workload.oracles import ORACLES
from workload.queries import REGISTRY

SF = "/root/testdata/sf0.001"
CHOSEN = (
    "numeric_stats", "numeric_stats_missing", "categorical_stats_documents", "dataset_summary", "correlation_matrix_missing",
    "cramers_v_events", "outliers_iqr", "change_points", "acf_events", "seasonality", "welch_t_test", "semantic_scores",
    "find_relationships", "quality_issues", "deep_insights", "hypotheses", "dataset_fingerprint", "flatten_json_column",
)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(REGISTRY)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, name):
    assert ORACLES.get(name)
    rows = differences(spark, connect(SF), SF, name, ORACLES[name])
    assert rows is None, rows

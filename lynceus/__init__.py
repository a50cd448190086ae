"""Profiling and exploratory analysis of tables of any size, on Spark."""

from lynceus.functions.cells import canon, normalize_cells
from lynceus.operators.association import (
    confounders, correlation_insights, correlation_matrix, cramers_v, point_biserial,
)
from lynceus.operators.catalog import catalog_similarity, column_sets, compare_datasets, dataset_fingerprint
from lynceus.operators.hypotheses import (
    hypotheses, hypotheses_anomaly, hypotheses_correlation, hypotheses_group_difference, hypotheses_trend,
)
from lynceus.operators.insights import (
    deep_insights, eda_findings, eda_overview, kpis, quick_insights, recommendations, synthetic_checks, trend_insights,
    variable_notes,
)
from lynceus.operators.outliers import outlier_bounds, outlier_test, outliers_iqr, outliers_zscore, row_anomalies
from lynceus.operators.profile import (
    categorical_stats, category_distribution, column_nulls_uniques, dataset_summary, distribution_shape,
    dominant_values, duplicate_rows, group_mean_homogeneity, mean_by_category, near_duplicate_labels, numeric_stats,
    round_number_ratio, segment_profile, similar_distributions, uniformity_check,
)
from lynceus.operators.quality import quality_issues, quality_score
from lynceus.operators.relations import (
    candidate_keys, find_relationships, join_related, orphan_report, orphans, value_overlap,
)
from lynceus.operators.schema import basic_types, infer_schema, overall_confidence, semantic_scores, semantic_types
from lynceus.operators.series import (
    acf, change_points, global_index, local_peaks, seasonality, series_head, time_series_report, trend, trend_test,
)
from lynceus.operators.testing import correlation_test, test_hypothesis, welch_t_test
from lynceus.operators.values import value_counts
from lynceus.plans.report import full_report
from lynceus.sources.payloads import flatten_json_column, merge_pages
from lynceus.sources.readers import read_auto, read_delimited, read_json_records
from lynceus.sources.sampling import sampling_plan, systematic_sample, tiered_sample
from lynceus.sources.writers import export_data, write_csv, write_report
from lynceus.streaming.chunks import apply_in_chunks
from lynceus.streaming.profile import mergeable_profile, read_streaming_profile, streaming_profile
from lynceus.table import Table, infer_column_types

__all__ = [n for n in dir() if not n.startswith("_")]

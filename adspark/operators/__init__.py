"""DataFrame operators."""

from adspark.operators.association import adjust_p, association, chi_squared, contingency
from adspark.operators.evaluate import (
    align_by_position, align_predictions, auc, confusion, delong, failure_counts, fit_quality, is_false_negative,
    is_false_positive, log_loss, metrics_long, metrics_table, roc_points, rows_by_position,
    score_curve, score_groups, youden,
)
from adspark.operators.features import (
    add_split, attach_frequency, device_features, frequencies_in_one_scan, key_frequencies,
    model_features, numeric_features, split_rates, temporal_features,
)
from adspark.operators.levels import (
    dominant_levels, keep_top_levels, level_counts, overall_rate, target_rates, top_levels,
)
from adspark.operators.lookup import bucketed_lookup, lookup_join
from adspark.operators.prefix import (
    cut_points, running_totals, text_cut_points, with_bucket,
)
from adspark.operators.profile import (
    cardinality, coverage, histogram, integrity, level_distribution,
    level_distribution_pair, metric_by_level, preview, rate_by_hour, split_summary,
    suggest_encoding, temporal_overview,
)
from adspark.operators.rankcorr import rank_correlation, value_ranks
from adspark.operators.sampling import (
    class_counts, draw_cases, row_sample, sample_summary, stratified_folds,
    stratified_sample, train_valid_split,
)
from adspark.operators.summaries import (
    frequent_levels, merge_summaries, read_summaries, summarize_levels, summary_cardinality,
    write_summaries,
)

__all__ = [n for n in dir() if not n.startswith("_")]

"""Sources, sinks and relation resolution."""

from adspark._checks import missing_columns, require_columns, require_rows
from adspark.sources.gzipped import (
    gzip_ranges, read_gzip_csv, read_gzip_lines, write_gzip_csv,
)
from adspark.sources.readers import (
    IMPRESSIONS_SCHEMA, csv_to_parquet, read_grid_json, read_history_json,
    read_impressions_csv, read_split, register_parquet,
)
from adspark.sources.relation import (
    as_df, as_predictions, stack_predictions, stack_scores,
)
from adspark.sources.scratch import materialize, path_exists, release, scratch_root
from adspark.sources.writers import (
    append_results, predictions_path, save_model, write_history,
    write_predictions, write_subset, write_subsets,
)

__all__ = [
    "IMPRESSIONS_SCHEMA", "append_results", "as_df", "as_predictions",
    "csv_to_parquet", "gzip_ranges", "materialize", "missing_columns", "path_exists",
    "predictions_path", "read_grid_json", "read_gzip_csv", "read_gzip_lines", "read_history_json",
    "read_impressions_csv", "read_split", "register_parquet", "release",
    "require_columns", "require_rows", "save_model", "scratch_root",
    "stack_predictions", "stack_scores", "write_history",
    "write_gzip_csv", "write_predictions", "write_subset", "write_subsets",
]

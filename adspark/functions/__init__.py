"""Column expressions."""

from adspark.functions.hashing import bucket100, order_key, split_label
from adspark.functions.scalars import (
    above, level_label, list_position, log_frequency, safe_ratio, strip_step_prefix,
)
from adspark.functions.tails import (
    chi2_sf, chi2_sf_column, normal_sf, two_sided_p,
)
from adspark.functions.temporal import (
    day_of_month, hour_code, hour_cos, hour_of_day, hour_sin, time_band,
)

__all__ = [
    "above", "bucket100", "chi2_sf", "chi2_sf_column", "day_of_month",
    "hour_code", "hour_cos", "hour_of_day", "hour_sin", "level_label",
    "list_position", "log_frequency", "normal_sf", "order_key", "safe_ratio",
    "split_label", "strip_step_prefix", "time_band", "two_sided_p",
]

"""Default column roles, labels and the encoding configuration.

Everything here is a parameter somewhere; no operator reads these values unless
the caller leaves the parameter at its default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values -----------------------------------------------------------
TARGET = "click"
TRAIN_LABEL = "Entrenamiento"
HOLDOUT_LABEL = "Prueba"
TRAIN_RATIO = 0.70
TIME_BANDS = ("Madrugada", "Mañana", "Tarde", "Noche")
DEVICE_PLACEHOLDER = "a99f214a"
OTHER = "Other"
CATEGORICAL_COLUMNS = (
    "site_id", "site_domain", "site_category", "app_id", "app_domain",
    "app_category", "device_model", "device_type", "device_conn_type",
    "banner_pos", "C1", "C14", "C15", "C16", "C17", "C18", "C19", "C20", "C21",
)
DICHOTOMIZE = ("C1", "C15", "C16", "device_type", "device_conn_type")
TOP_K = {
    "banner_pos": 2, "C18": 3, "app_category": 3, "site_category": 3,
    "app_domain": 6, "C19": 10, "C20": 10, "C21": 10,
}
HYBRID = ("app_id", "site_domain", "site_id")
TARGET_RATE = ("C14", "C17", "device_model")
ONE_HOT = ("time_band",)
SCALED = ("log_freq_device_id", "log_freq_device_ip")
NUMERIC = ("day", "hour_sin", "hour_cos")
DERIVED = ("device_id", "device_ip")
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class EncodingConfig:
    """Which column gets which encoding.

    ``dichotomize``  flag for the dominant level
    ``top_k``        most frequent levels kept, the rest collapsed, one-hot
    ``hybrid``       dominant flag and smoothed target rate
    ``target_rate``  smoothed target rate only
    ``one_hot``      every level kept, one-hot
    ``scaled``       numeric, standardised
    ``numeric``      numeric, passed through
    """

    dichotomize: tuple[str, ...] = DICHOTOMIZE
    top_k: dict[str, int] = field(default_factory=lambda: dict(TOP_K))
    hybrid: tuple[str, ...] = HYBRID
    target_rate: tuple[str, ...] = TARGET_RATE
    one_hot: tuple[str, ...] = ONE_HOT
    scaled: tuple[str, ...] = SCALED
    numeric: tuple[str, ...] = NUMERIC
    target: str = TARGET

    @property
    def categorical(self) -> tuple[str, ...]:
        """Every column that needs level statistics."""
        return (*self.dichotomize, *self.top_k, *self.hybrid,
                *self.target_rate, *self.one_hot)

    @property
    def inputs(self) -> tuple[str, ...]:
        """Every input column, without the target."""
        return (*self.categorical, *self.scaled, *self.numeric)

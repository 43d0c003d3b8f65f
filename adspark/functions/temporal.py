"""Calendar features out of an integer ``YYMMDDHH`` column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adspark.config import TIME_BANDS

HOURS_PER_BAND = 6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of_month(hour: Column | str) -> Column:
    """Day of month."""
    return F.pmod(F.floor(_col(hour) / 100), F.lit(100)).cast("int")


def hour_of_day(hour: Column | str) -> Column:
    """Hour of day, 0 to 23."""
    return F.pmod(_col(hour), F.lit(100)).cast("int")


def hour_sin(hour: Column | str) -> Column:
    """Sine of the hour on the 24-hour circle."""
    return F.sin(2 * F.pi() * hour_of_day(hour) / 24)


def hour_cos(hour: Column | str) -> Column:
    """Cosine of the hour on the 24-hour circle."""
    return F.cos(2 * F.pi() * hour_of_day(hour) / 24)


def time_band(hour: Column | str, labels: tuple[str, ...] = TIME_BANDS) -> Column:
    """Six-hour band of the day; the last label also takes whatever is left."""
    if len(labels) != 4:
        raise ValueError("'labels' must hold four names")
    h = hour_of_day(hour)
    out = None
    for i, label in enumerate(labels[:-1]):
        inside = h.between(HOURS_PER_BAND * i, HOURS_PER_BAND * (i + 1) - 1)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out.otherwise(labels[-1])


def hour_code(ts: Column | str) -> Column:
    """The ``YYMMDDHH`` integer of a timestamp."""
    return F.date_format(_col(ts), "yyMMddHH").cast("int")

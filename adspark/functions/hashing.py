"""Portable hash rules: the same answer in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket100(id_column: Column | str) -> Column:
    """First eight hex digits of ``md5(id)`` modulo 100."""
    digest = F.md5(_col(id_column).cast("string"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(100)).cast("int")


def split_label(id_column: Column | str, train_ratio: float, train_label: str,
                holdout_label: str) -> Column:
    """Train or holdout label of a row, a function of its identifier alone."""
    return F.when(
        bucket100(id_column) < round(train_ratio * 100), train_label
    ).otherwise(holdout_label)


def order_key(id_column: Column | str, seed: int | str) -> Column:
    """A reproducible pseudo-random sort key for a row.

    Fixed by the identifier and the seed, so that a recomputed task or another
    partitioning gives the same order.
    """
    return F.md5(F.concat(_col(id_column).cast("string"), F.lit(str(seed))))

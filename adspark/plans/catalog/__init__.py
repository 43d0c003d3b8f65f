"""Registered queries and the SQL they are checked against."""

from adspark.plans.catalog import (
    encoding, evaluation, modelling, profiling, sampling, statistics, storage, temporal,
)

_PARTS = [temporal, profiling, statistics, sampling, encoding, evaluation, modelling,
          storage]


def all_queries() -> dict:
    """Every registered query by name."""
    out: dict = {}
    for part in _PARTS:
        out.update(part.QUERIES)
    return out


def all_oracles() -> dict:
    """Oracle SQL of the queries that SQL can express."""
    out: dict = {}
    for part in _PARTS:
        out.update(part.ORACLE)
    return out

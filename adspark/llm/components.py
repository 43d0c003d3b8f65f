"""Connected components of a graph of integer ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adspark.llm._common import spread_lookup, stored
from adspark.sources.scratch import release


def _with_least(edges: DataFrame, with_self: bool) -> tuple[DataFrame, DataFrame]:
    """Adds ``m``, the least neighbour of ``u`` (or ``u`` itself); the table it is looked up in."""
    least = F.min("v")
    least = F.least(least, F.col("u")) if with_self else least
    mins = stored(edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("n")), "least")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = mins.agg(F.sum("n")).first()[0] or 0
    return spread_lookup(edges, mins, "u", "n", int(total), parts, F.xxhash64("v")), mins


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (id, root), written: for each linked id the smallest id it reaches.

    Each round hangs larger neighbours of a node, then smaller ones, on the least
    of them; stars remain after a number of rounds that grows with the logarithm
    of the nodes. Every round is written, and heavy nodes are looked up by broadcast.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        found, mins = _with_least(both, True)
        large = stored(found.filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        release(mins)
        small, mins = _with_least(large, False)
        hung = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = small.select("u", F.col("m").alias("v"))
        fresh = stored(hung.unionByName(kept).distinct(), "edges")
        state = tuple(fresh.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
                      .first())
        for table in (mins, large, edges):
            release(table)
        edges = fresh
        if state == seen:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
            out = stored(edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
                         .unionByName(roots), "components")
            release(edges)
            return out
        seen = state

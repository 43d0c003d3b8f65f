"""Joins and running totals that must hold under skew."""

import math
import random

import pytest
from pyspark.sql import functions as F

from adspark.operators import (
    cut_points, lookup_join, running_totals, text_cut_points, with_bucket,
)
from adspark.operators.lookup import SALT, _salted_join, bucketed_lookup
from adspark.sources.scratch import release, released


@pytest.mark.parametrize("null_matches", [False, True])
@pytest.mark.parametrize("limit", [0, 100_000])
def test_lookup_equals_plain_join(spark, null_matches, limit):
    rng = random.Random(3)
    keys = ["hot"] * 400 + ["ph"] * 300 + [None] * 50 + [f"k{rng.randrange(90)}" for _ in range(250)]
    facts = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    dim = facts.where("key is null or key <> 'ph'").where("key is null or key <> 'k7'") \
        .groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.col("n") * 2)
    got = lookup_join(facts, dim, "key", ["v"], ["id"], no_match=F.col("key") == "ph",
                      null_matches=null_matches, broadcast_bytes=limit)
    assert got.columns == ["id", "key", "v"]
    values = {r["key"]: r["v"] for r in dim.collect()}
    rows = got.collect()
    assert len(rows) == len(keys)
    for r in rows:
        want = values.get(r["key"])
        if r["key"] is None and not null_matches:
            want = None
        assert r["v"] == want


def test_hot_rows_get_their_own_join_keys(spark):
    facts = spark.range(3000).withColumn(
        "key", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(-1)))
    dim = facts.groupBy("key").agg(F.count("*").alias("n"))
    before = int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = _salted_join(facts, dim, "key", ["n"], ["id"], None, False, 64)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "_join_key" in plan
        # partitions of the shuffled join are even although one key has 2/3 of the rows
        sizes = [r["count"] for r in
                 joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 3000 / 8
        assert joined.where("key = -1 and n <> 2000").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_a_hot_key_that_the_lookup_lacks_is_spread(spark):
    facts = spark.range(6000).withColumn(
        "key", F.when(F.col("id") % 5 < 2, F.col("id")).otherwise(F.lit(-1))).repartition(8)
    dim = facts.where("key >= 0").groupBy("key").agg(F.count("*").alias("n"))
    before = int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        joined = lookup_join(facts, dim, "key", ["n"], ["id"], broadcast_bytes=0)
        sizes = [r["count"] for r in
                 joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 6000 and max(sizes) < 2 * 6000 / 8
        assert joined.where("key = -1 and n is not null").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", True)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_running_totals_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [None, float("nan"), 0.0, -1.5, 2.25] + [rng.random() for _ in range(40)]
    rows = [(g, k, rng.randrange(5)) for g in "ab" for k in rng.sample(pool, 30)]
    df = spark.createDataFrame(rows, "g string, k double, w long")
    cuts = cut_points(df, "k", 8)
    assert len(cuts) <= 7
    got = running_totals(df, "k", ["w"], cuts, by=["g"]).collect()
    assert len(got) == len(rows)

    def place(k):
        return (2, 0) if k is None else (1, 0) if math.isnan(k) else (0, k)

    for r in got:
        below = sum(w for g, k, w in rows if g == r["g"] and place(k) < place(r["k"]))
        assert r["w_below"] == below
        assert r["w_total"] == sum(w for g, _, w in rows if g == r["g"])


def test_one_value_only(spark):
    df = spark.createDataFrame([(1.0, 5)], "k double, w long")
    assert running_totals(df, "k", ["w"], cut_points(df, "k")).first()["w_below"] == 0
    assert running_totals(df, "k", ["w"], []).first()["w_total"] == 5


def test_text_buckets(spark):
    df = spark.range(2000).select(F.concat(F.lit("http://site/"), F.col("id")).alias("k"))
    cuts = text_cut_points(df, "k", 8, 16)
    sizes = with_bucket(df, "k", cuts).groupBy("_bucket").count().collect()
    assert len(sizes) == len(cuts) + 1
    assert max(r["count"] for r in sizes) < 2000 / 2


def test_bucketed_lookup_is_not_shuffled(spark):
    keys = ["hot"] * 900 + ["ph"] * 700 + [None] * 50 + [f"k{i % 400}" for i in range(1500)]
    facts = spark.createDataFrame(list(enumerate(keys)), "id long, key string").repartition(5)
    dim = facts.where("key <> 'ph' and key <> 'k7'").groupBy("key").agg(F.count("*").alias("n"))
    table = bucketed_lookup(dim, "key", ["n"])
    assert set(table.columns) == {"key", "n", SALT}
    got = lookup_join(facts, table, "key", ["n"], ["id"], no_match=F.col("key") == "ph",
                      broadcast_bytes=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    # the rows are shuffled, the lookup is read in its buckets
    assert "Bucketed: true" in join and join.count("Exchange hashpartitioning") == 1
    want = {r["key"]: r["n"] for r in dim.collect()}
    rows = got.collect()
    assert len(rows) == len(keys) and all(r["n"] == want.get(r["key"]) for r in rows)
    again = lookup_join(facts.limit(20), table, "key", ["n"], ["id"])  # small: broadcast
    assert again.columns == ["id", "key", "n"] and again.count() == 20
    name = table.inputFiles()[0]
    release(table)
    from adspark.sources.scratch import path_exists
    assert not path_exists(spark, name)
    before = len(spark.catalog.listTables())
    with released(spark):
        bucketed_lookup(dim, "key", ["n"])
        assert len(spark.catalog.listTables()) == before + 1
    assert len(spark.catalog.listTables()) == before

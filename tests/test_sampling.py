import hashlib

import pytest
from pyspark.sql import functions as F

from adspark.operators import (
    class_counts, draw_cases, row_sample, stratified_folds, stratified_sample,
    train_valid_split,
)

N = 2000


def _df(spark):
    return spark.range(N).withColumn("click", (F.col("id") % 6 == 0).cast("int"))


def _key(i, seed=42):
    return hashlib.md5(f"{i}{seed}".encode()).hexdigest()


def _ordered(cls, seed=42):
    return sorted((i for i in range(N) if (i % 6 == 0) == bool(cls)), key=lambda i: _key(i, seed))


@pytest.mark.parametrize("n", [1, 7, 300, N - 1])
def test_stratified_sample_against_brute_force(spark, n):
    want = set()
    for cls in (0, 1):
        order = _ordered(cls)
        want |= set(order[:max(1, round(n * len(order) / N))])
    got = [r["id"] for r in stratified_sample(_df(spark), n).collect()]
    assert len(got) == len(want) and set(got) == want


def test_sample_bounds(spark):
    with pytest.raises(Exception, match="smaller than the number of rows"):
        stratified_sample(_df(spark), N).collect()
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError):
            stratified_sample(_df(spark), bad)


def test_row_sample(spark):
    order = sorted(range(N), key=_key)
    assert {r["id"] for r in row_sample(_df(spark), 50).collect()} == set(order[:50])
    assert row_sample(_df(spark), 10 * N).count() == N


def test_partitioning_does_not_matter(spark):
    one = stratified_sample(_df(spark), 100).collect()
    two = stratified_sample(_df(spark).repartition(5).orderBy(F.desc("id")), 100).collect()
    assert sorted(one) == sorted(two)


def test_folds(spark):
    rows = stratified_folds(_df(spark), 4, seed=7).collect()
    got = {r["id"]: r["fold"] for r in rows}
    assert len(rows) == N
    for cls in (0, 1):
        for place, i in enumerate(_ordered(cls, 7)):
            assert got[i] == place % 4
    loose = stratified_folds(_df(spark), 4, exact=False).groupBy("fold").count().collect()
    assert len(loose) == 4 and min(r["count"] for r in loose) > N / 4 * 0.8
    with pytest.raises(ValueError):
        stratified_folds(_df(spark), 1)


def test_folds_keep_null_targets(spark):
    df = _df(spark).withColumn("click", F.when(F.col("id") < 10, None).otherwise(F.col("click")))
    assert stratified_folds(df, 3).count() == N


def test_train_valid(spark):
    rows = train_valid_split(_df(spark), 0.25).collect()
    valid = [r for r in rows if r["part"] == "valid"]
    assert len(rows) == N
    pos = sum(r["click"] for r in valid)
    assert (pos, len(valid) - pos) == (round(0.25 * 334), round(0.25 * 1666))


def test_counts_and_draws(spark):
    got = {r["target"]: (r["n"], r["proportion"]) for r in class_counts(_df(spark)).collect()}
    assert got == {1: (334, 0.167), 0: (1666, 0.833)}
    assert draw_cases(_df(spark), F.col("click") == 1, 3).count() == 3
    assert draw_cases(_df(spark), F.col("click") == 5, 3).count() == 0


def test_null_and_repeated_ids_keep_exact_sizes(spark):
    rows = [(None if i % 10 == 0 else i % 40, int(i % 7 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, click int")
    counts = {c: sum(r[1] == c for r in rows) for c in (0, 1)}
    got = stratified_sample(df, 100).groupBy("click").count().collect()
    assert {r["click"]: r["count"] for r in got} == {
        c: round(100 * n / 400) for c, n in counts.items()}
    assert row_sample(df, 20).count() == 20
    parts = train_valid_split(df, 0.25).where("part = 'valid'").groupBy("click").count().collect()
    assert {r["click"]: r["count"] for r in parts} == {c: round(n / 4) for c, n in counts.items()}
    folds = stratified_folds(df, 4).groupBy("click", "fold").count().collect()
    assert sum(r["count"] for r in folds) == 400
    for c in (0, 1):
        sizes = [r["count"] for r in folds if r["click"] == c]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_any_number_of_strata(spark):
    df = spark.range(6000).withColumn("click", (F.col("id") % 1500).cast("int"))
    got = stratified_sample(df, 3000).groupBy("click").count().collect()
    assert len(got) == 1500 and {r["count"] for r in got} == {2}


def test_null_ids_spread_and_samples_stay_exact(spark):
    from adspark.operators.sampling import _keyed
    df = spark.range(3000).select(
        F.when(F.col("id") % 5 < 2, F.col("id")).alias("id"), (F.col("id") % 6 == 0).cast("int").alias("click"),
        F.col("id").alias("other"))
    tasks = _keyed(df, "id", 42).groupBy(F.substring("_key", 1, 1)).count().collect()
    assert len(tasks) == 16 and max(r["count"] for r in tasks) < 2 * 3000 / 16
    one = stratified_sample(df, 300)
    assert one.count() == 300
    assert 120 < one.where("id is null").count() < 240
    again = stratified_sample(df.repartition(7).orderBy(F.desc("other")), 300)
    assert sorted(r["other"] for r in one.collect()) == sorted(r["other"] for r in again.collect())
    twins = df.where("id is null").limit(1).unionByName(df.where("id is null").limit(1))
    assert row_sample(twins.unionByName(df), 3002).count() == 3002
    fold = stratified_folds(df, 4).groupBy("click", "fold").count().groupBy("click").agg(
        (F.max("count") - F.min("count")).alias("gap")).collect()
    assert max(r["gap"] for r in fold) <= 1

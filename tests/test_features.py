import hashlib

import pytest
from pyspark.sql import functions as F

from adspark.functions import (
    bucket100, day_of_month, hour_of_day, hour_sin, list_position, split_label, time_band,
)
from adspark.operators import (
    add_split, device_features, frequencies_in_one_scan, key_frequencies, split_rates,
)
from adspark.plans.feature_build import build_features, run_feature_build
from adspark.sources import read_split


def test_calendar(spark):
    df = spark.createDataFrame([(14102100,), (14102105,), (14102106,), (14103023,)], "hour int")
    rows = df.select(day_of_month("hour").alias("d"), hour_of_day("hour").alias("h"),
                     time_band("hour").alias("b")).collect()
    assert [tuple(r) for r in rows] == [
        (21, 0, "Madrugada"), (21, 5, "Madrugada"), (21, 6, "Mañana"), (30, 23, "Noche")]
    with pytest.raises(ValueError):
        time_band("hour", ("a", "b"))


def test_keys_of_any_type_are_counted_in_one_scan(spark):
    rows = [("a" if i % 3 else "ph", i % 4 if i % 5 else None, i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b bigint, c boolean")
    keys = {"a": "ph", "b": None, "c": True}
    for (key, placeholder), got in zip(keys.items(), frequencies_in_one_scan(df, keys)):
        want = key_frequencies(df, key, placeholder)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    for got in frequencies_in_one_scan(df.where("false"), keys):
        assert got.count() == 0


def test_split_depends_on_the_id_only(spark):
    ids = spark.range(5000).withColumn("id", F.col("id").cast("string"))
    one = {r["id"]: r["split"] for r in add_split(ids).collect()}
    other = {r["id"]: r["split"] for r in
             add_split(ids.orderBy(F.desc("id")).repartition(3)).collect()}
    assert one == other
    for key, label in list(one.items())[:50]:
        bucket = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % 100
        assert label == ("Entrenamiento" if bucket < 70 else "Prueba")
    share = sum(v == "Entrenamiento" for v in one.values()) / len(one)
    assert abs(share - 0.7) < 0.02
    with pytest.raises(ValueError):
        add_split(ids, train_ratio=1.0)
    with pytest.raises(ValueError):
        add_split(ids, id_column="none")


def _rows(spark):
    data = [(i, i % 3 % 2, 14102100 + i % 24, "ph" if i % 3 else f"d{i % 7}", f"ip{i % 5}", "x")
            for i in range(300)]
    return spark.createDataFrame(
        data, "id long, click int, hour int, device_id string, device_ip string, c string")


def test_device_frequencies(spark):
    df = _rows(spark)
    got = {r["id"]: r for r in device_features(df, placeholder="ph").collect()}
    assert len(got) == 300
    counts = df.groupBy("device_id").count().rdd.collectAsMap()
    for r in df.collect():
        want = 0 if r["device_id"] == "ph" else counts[r["device_id"]]
        assert got[r["id"]]["freq_device_id"] == want
    assert got[1]["log_freq_device_id"] == 0.0
    assert "ph" not in {r["device_id"] for r in
                        key_frequencies(df, "device_id", "ph").collect()}


def test_holdout_rows_do_not_change_training_features(spark, tmp_path):
    df = _rows(spark)
    changed = df.withColumn(
        "device_ip", F.when(bucket100("id") >= 70, F.lit("new")).otherwise(F.col("device_ip")))
    one, two = (
        sorted(map(tuple, build_features(d, keep=["c"], placeholder="ph").subset(
            "Entrenamiento").collect())) for d in (df, changed))
    assert one == two
    unseen = build_features(changed, keep=["c"], placeholder="ph").subset("Prueba")
    assert {r["log_freq_device_ip"] for r in unseen.collect()} == {0.0}

    built = run_feature_build(df, str(tmp_path / "out"), keep=["c"], placeholder="ph")
    back = read_split(spark, str(tmp_path / "out"), "Prueba")
    assert back.columns == ["id", "click", "day", "hour_sin", "hour_cos", "time_band",
                            "log_freq_device_id", "log_freq_device_ip", "c"]
    rates = {r["split"]: r["n"] for r in built.rates.collect()}
    assert rates["Prueba"] == back.count() and sum(rates.values()) == 300


def test_rates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("b", 1)], "split string, click int")
    assert [tuple(r) for r in split_rates(df).collect()] == [("a", 3, 33.3333), ("b", 1, 100.0)]


def test_order_of_labels(spark):
    df = spark.createDataFrame([("y",), ("z",), ("x",), (None,)], "v string")
    got = {r[0]: r[1] for r in df.select("v", list_position("v", ("x", "y"))).collect()}
    assert got == {"x": 0, "y": 1, "z": 2, None: 2}


def test_row_expressions_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    _rows(spark).write.parquet(path)
    stream = spark.readStream.schema(_rows(spark).schema).parquet(path).select(
        "id", day_of_month("hour").alias("day"), hour_sin("hour").alias("hs"),
        time_band("hour").alias("band"), split_label("id", 0.7, "a", "b").alias("s"))
    query = (stream.writeStream.format("memory").queryName("rows_out")
             .option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    assert spark.table("rows_out").count() == 300

import gzip
import json

import pytest
from pyspark.sql import functions as F

from adspark.config import CATEGORICAL_COLUMNS
from adspark.operators import add_split
from adspark.sources import (
    IMPRESSIONS_SCHEMA, as_df, as_predictions, csv_to_parquet, materialize, missing_columns,
    path_exists, read_grid_json, read_history_json, read_split, register_parquet, release,
    scratch_root, stack_predictions, write_subset, write_subsets,
)

LONG_ID = "10000174058809263569"


def _csv(path, rows):
    names = [f.name for f in IMPRESSIONS_SCHEMA]
    with gzip.open(path, "wt") as out:
        out.write(",".join(names) + "\n")
        for r in rows:
            out.write(",".join(str(r.get(n, 1)) for n in names) + "\n")


def test_gzip_csv_becomes_parquet(spark, tmp_path):
    source, target = str(tmp_path / "in.csv.gz"), str(tmp_path / "out")
    _csv(source, [{"id": LONG_ID, "click": i % 2, "hour": 14102100 + i} for i in range(20)])
    df = csv_to_parquet(spark, source, target, partitions=4)
    assert df.count() == 20
    assert {r["id"] for r in df.collect()} == {LONG_ID}
    assert [f.dataType for f in df.schema] == [f.dataType for f in IMPRESSIONS_SCHEMA]
    assert set(CATEGORICAL_COLUMNS) < set(df.columns)
    _csv(source, [{"click": 1}])
    assert csv_to_parquet(spark, source, target).count() == 20


def test_bad_csv_fails(spark, tmp_path):
    source = str(tmp_path / "bad.csv.gz")
    _csv(source, [{"click": "no number"}])
    with pytest.raises(Exception, match="(?i)malformed|number"):
        csv_to_parquet(spark, source, str(tmp_path / "out"))
    with pytest.raises(FileNotFoundError):
        csv_to_parquet(spark, str(tmp_path / "none.gz"), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        csv_to_parquet(spark, source, str(tmp_path / "out"), partitions=0)


def test_relations(spark, sf):
    events = register_parquet(spark, f"{sf}/events.parquet", "raw_events")
    n = events.count()
    assert as_df(spark, events) is events
    assert as_df(spark, "raw_events").count() == n
    assert as_df(spark, "(SELECT * FROM raw_events WHERE event_type = 'click')").count() < n
    with pytest.raises(TypeError):
        as_df(spark, 3)
    with pytest.raises(FileNotFoundError):
        register_parquet(spark, f"{sf}/nothing.parquet")
    assert missing_columns(events, ["ts", "nope"]) == ["nope"]


def test_predictions(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, 0.25), (2, 1, 0.5)], "id long, click int, prediction double")
    path = str(tmp_path / "p")
    write_subset(df, path)
    assert as_predictions(spark, path, id_column="id").columns == ["id", "target", "prediction"]
    assert stack_predictions(spark, {"a": df, "b": path}).count() == 4
    with pytest.raises(ValueError):
        as_predictions(spark, df, prediction="score")
    with pytest.raises(TypeError):
        as_predictions(spark, 1)


def test_subsets_in_one_pass(spark, tmp_path):
    df = add_split(spark.range(1000).withColumnRenamed("id", "key"), "key")
    path = str(tmp_path / "f")
    write_subsets(df, path)
    train = read_split(spark, path, "Entrenamiento")
    test = read_split(spark, path, "Prueba")
    assert train.count() + test.count() == 1000
    assert abs(train.count() - 700) < 60
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_stored_tables(spark):
    table = materialize(spark.range(10), "ids", sort_by=("id",))
    path = table.__dict__["_scratch_path"]
    assert path.startswith(scratch_root(spark)) and path_exists(spark, path)
    assert table.count() == 10
    release(table)
    assert not path_exists(spark, path)


def test_result_files(spark, tmp_path):
    grid = tmp_path / "g.json"
    entry = {"signature": "s", "params": {"net__alpha": 0.1, "net__layers": [100, 50]},
             "fold_scores": [0.5, 0.7], "fold_times": [1.0, 2.0], "mean_auc": 0.6,
             "std_auc": 0.1, "mean_fit_time": 1.5, "total_fit_time": 3.0}
    grid.write_text(json.dumps({"metadata": {"cv": 2}, "results": [entry]}, indent=2))
    row = read_grid_json(spark, str(grid)).first()
    assert row["fold_scores"] == [0.5, 0.7]
    assert row["params"] == {"net__alpha": "0.1", "net__layers": "[100,50]"}
    hist = tmp_path / "h.json"
    hist.write_text(json.dumps({"epoch": [1, 2], "train_loss": [.4, .3], "val_loss": [.5, .4],
                                "train_auc": [.6, .7], "val_auc": [.5, .6]}, indent=2))
    assert [r["epoch"] for r in read_history_json(spark, str(hist)).collect()] == [1, 2]
    with pytest.raises(FileNotFoundError):
        read_grid_json(spark, str(tmp_path / "no.json"))


def test_unfinished_output_is_written_again(spark, tmp_path):
    source, target = str(tmp_path / "in.csv.gz"), tmp_path / "out"
    _csv(source, [{"click": 1}] * 5)
    csv_to_parquet(spark, source, str(target))
    (target / "_SUCCESS").unlink()
    _csv(source, [{"click": 1}] * 7)
    assert csv_to_parquet(spark, source, str(target)).count() == 7


def test_scopes_release_what_they_materialize(spark):
    from adspark.operators import auc
    from adspark.sources.scratch import released
    df = spark.createDataFrame([("m", i % 2, i / 10) for i in range(10)],
                               "model string, target int, prediction double")

    def tables():
        import glob
        return set(glob.glob(scratch_root(spark).removeprefix("file:") + "/adspark/*"))

    before = tables()
    with released(spark):
        assert 0 <= auc(df).first()["auc"] <= 1
    assert tables() == before


def test_refreshing_a_subset_leaves_the_others(spark, tmp_path):
    import os

    from adspark.sources.writers import refresh_subset, subset_mark, subset_written
    path = str(tmp_path / "table")
    rows = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b c").alias(
        "split"))
    write_subsets(rows, path)
    assert subset_written(spark, path, "a") and subset_written(spark, path, "b c")
    files = sorted(os.listdir(f"{path}/split=a"))
    refresh_subset(rows.withColumn("id", F.col("id") + 1000), path, "b c")
    assert sorted(os.listdir(f"{path}/split=a")) == files
    assert read_split(spark, path, "b c").agg(F.min("id"), F.count("*")).first() == (1001, 133)
    assert read_split(spark, path, "a").count() == 67 and subset_written(spark, path, "b c")
    broken = rows.withColumn("id", F.raise_error(F.lit("stop")).cast("long"))
    with pytest.raises(Exception, match="stop"):
        refresh_subset(broken, path, "b c")
    assert not subset_written(spark, path, "b c") and subset_written(spark, path, "a")
    assert "%20" in subset_mark(path, "b c")


def test_the_result_log_takes_up_what_a_crash_left(spark, tmp_path):
    from adspark.ml.search import RESULT_SCHEMA, read_results
    from adspark.sources.writers import append_results
    path = str(tmp_path / "log")
    row = lambda name, auc: (name, {"k": "v"}, [auc], [1.0], auc, 0.0, 1.0, 1.0)
    table = lambda *rows: spark.createDataFrame(list(rows), RESULT_SCHEMA)
    append_results(table(row("s1", .5), row("s2", .6)), path)
    append_results(table(row("s1", .7)), path)
    append_results(table(row("s2", .1)), path, seq=5)  # an older one that arrives late
    (tmp_path / "log" / "part-torn.json").write_text(
        '{"signature":"s3","mean_auc":0.9,"fold_scores":[0.9')
    (tmp_path / "log" / "part-old.json").write_text('{"signature":"s4","mean_auc":0.4}\n{}\n')
    got = {r["signature"]: r["mean_auc"] for r in read_results(spark, path).collect()}
    assert got == {"s1": .7, "s2": .6, "s4": .4}
    assert read_results(spark, path).first()["params"] in ({"k": "v"}, None)

import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, TargetEncoder
from pyspark.sql import functions as F

from adspark.config import EncodingConfig
from adspark.ml import (
    ImpressionEncoder, code_book, encode_rows, encoding_plan, explain, feature_names, grid_search,
    model_width,
    perceptron, predict, predict_and_save, read_results, show_results, top_results,
    train_classifier, train_in_rounds,
)
from adspark.ml.explain import value_pool
from adspark.ml.search import combinations
from adspark.sources import save_model

CONFIG = EncodingConfig(
    dichotomize=("d",), top_k={"t": 2}, hybrid=("h",), target_rate=("r",), one_hot=("band",),
    scaled=("x",), numeric=("y",))


def _rows(spark, n=600):
    i = F.col("id")
    return spark.range(n).select(
        "id", F.when(i % 10 < 8, "big").otherwise("small").alias("d"),
        F.concat(F.lit("t"), i % 7 % 4).alias("t"), F.concat(F.lit("h"), i % 5).alias("h"),
        (i % 9).cast("int").alias("r"),
        F.when(i % 2 == 0, "am").otherwise("pm").alias("band"),
        (i % 13).cast("double").alias("x"), (i % 3).cast("double").alias("y"),
        ((i % 9 < 3) & (i % 4 != 0)).cast("int").alias("click"))


@pytest.fixture(scope="module")
def rows(spark):
    return _rows(spark)


@pytest.fixture(scope="module")
def encoder(rows):
    return ImpressionEncoder.of(CONFIG, smoothing=10.0).fit(rows)


@pytest.fixture(scope="module")
def model(rows):
    return train_classifier(rows, CONFIG, (6,), 10.0, max_iter=60)


def test_width_and_names(rows, encoder):
    vector = encoder.transform(rows).first()["features"]
    names = feature_names(encoder)
    assert vector.size == len(names) == model_width(encoder)
    assert names == ["x", "y", "d_is_dominant", "h_is_dominant", "h_te", "r_te",
                     "t_Other", "t_t0", "t_t1", "band_am", "band_pm"]


def test_rates_equal_the_built_in_encoder(spark, rows, encoder):
    ours = encoder.transform(rows).select("id", "r_te")
    coded = StringIndexer(inputCol="r", outputCol="i").fit(rows).transform(rows)
    te = TargetEncoder(inputCols=["i"], outputCols=["te"], labelCol="click",
                       targetType="binary", smoothing=10.0).fit(coded).transform(coded)
    worst = ours.join(te.select("id", "te"), "id").agg(
        F.max(F.abs(F.col("r_te") - F.col("te")))).first()[0]
    assert worst < 1e-12


def test_unseen_and_null_values(spark, rows, encoder):
    mean = rows.agg(F.avg("click")).first()[0]
    odd = rows.limit(1).withColumns({
        "r": F.lit(99), "h": F.lit(None).cast("string"), "t": F.lit("new"), "band": F.lit("xx"),
        "d": F.lit(None).cast("string")})
    r = encoder.transform(odd).first()
    assert r["r_te"] == pytest.approx(mean) and r["h_te"] == pytest.approx(mean)
    assert (r["d_is_dominant"], r["h_is_dominant"], r["t_top"]) == (0.0, 0.0, "Other")
    assert list(r["features"].toArray()[-2:]) == [0.0, 0.0]
    slot = ImpressionEncoder.of(CONFIG, unknownSlot=True).fit(rows)
    assert slot.transform(odd).first()["features"].toArray()[-1] == 1.0


def test_large_level_tables_take_the_shuffled_lookup(rows, encoder, monkeypatch):
    want = sorted(map(tuple, encoder.transform(rows).select("id", "r_te", "h_te").collect()))
    import adspark.operators.lookup as lookup
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 0)
    got = sorted(map(tuple, encoder.transform(rows).select("id", "r_te", "h_te").collect()))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(a - b) < 1e-12 for g, w in zip(got, want) for a, b in zip(g, w))


def test_small_levels_get_the_overall_rate(spark):
    df = spark.createDataFrame(
        [(i, "a" if i < 20 else "b", i % 2) for i in range(22)], "id long, r string, click int")
    cfg = EncodingConfig((), {}, (), ("r",), (), (), ())
    m = ImpressionEncoder.of(cfg, smoothing=0.0, minCategorySize=5).fit(df)
    got = {r["r"]: r["r_te"] for r in m.transform(df).collect()}
    assert got == {"a": 0.5, "b": 0.5}


def test_default_plan(spark):
    rows = {r["column"]: (r["strategy"], r["k"]) for r in encoding_plan(spark).collect()}
    assert len(rows) == 21
    assert rows["C19"] == ("top_k", 10) and rows["device_ip"] == ("derived", None)


def test_codes(spark, rows):
    got = {(r["column"], r["level"]): r["code"] for r in code_book(rows, ["h", "d"]).collect()}
    assert got == {**{("h", f"h{i}"): i for i in range(5)}, ("d", "big"): 0, ("d", "small"): 1}


def test_save_load_and_score(spark, rows, model, tmp_path):
    path = str(tmp_path / "net")
    save_model(model, path)
    with pytest.raises(FileExistsError):
        save_model(model, path, overwrite=False)
    save_model(model, path, overwrite=True)
    back = PipelineModel.load(path)
    one = predict(model, rows).orderBy("id").collect()
    two = predict(back, rows).orderBy("id").collect()
    assert one == two

    out = predict_and_save(spark, path, rows, output_dir=str(tmp_path), n_rows=100, threshold=0.3)
    saved = spark.read.parquet(out.output_path)
    assert out.output_path.endswith("net_predictions.parquet") and saved.count() == 100
    wrong = saved.where((F.col("prediction") >= 0.3).cast("int") != F.col("click")).count()
    assert out.n_failures == wrong == out.n_fp + out.n_fn
    kinds = [r["kind"] for r in out.failing_cases.collect()]
    assert len(kinds) == (out.n_fp > 0) + (out.n_fn > 0)
    assert set(CONFIG.inputs) < set(out.failing_cases.columns)
    with pytest.raises(FileNotFoundError):
        predict_and_save(spark, str(tmp_path / "no"), rows)
    with pytest.raises(ValueError):
        predict_and_save(spark, path, rows, threshold=1.0)


def test_search_resumes(spark, rows, tmp_path):
    path = str(tmp_path / "grid")
    first = grid_search(rows, CONFIG, {"hidden": [(3,)], "max_iter": [5]}, path, num_folds=2)
    assert first.count() == 1
    before = read_results(spark, path).first()
    both = grid_search(rows, CONFIG, {"hidden": [(3,), (4, 3)], "max_iter": [5]}, path,
                       num_folds=2, parallelism=2)
    got = {r["signature"]: r for r in both.collect()}
    assert len(got) == 2 and got[before["signature"]] == before
    for r in got.values():
        assert len(r["fold_scores"]) == 2 and all(0 <= s <= 1 for s in r["fold_scores"])
        assert r["mean_auc"] == pytest.approx(sum(r["fold_scores"]) / 2)
        assert r["std_auc"] == pytest.approx(abs(r["fold_scores"][0] - r["fold_scores"][1]) / 2)
    top = top_results(both, 1, display_names={"hidden": "layers"})
    assert top.columns == ["layers", "max_iter", "mean_auc", "std_auc"] and top.count() == 1


def test_smoothing_values_share_their_encoded_folds(spark, rows, tmp_path, monkeypatch):
    from adspark.ml import encode, search

    written, write = [], search.materialize

    def spy(df, label, *args, **kw):
        written.append(label)
        return write(df, label, *args, **kw)

    monkeypatch.setattr(search, "materialize", spy)
    grid = {"hidden": [(3,)], "max_iter": [3], "smoothing": [10.0, 50.0]}
    assert grid_search(rows, CONFIG, grid, str(tmp_path / "shared"), num_folds=2).count() == 2
    assert written.count("encoded-fold") == 2  # once a fold, not once a fold and smoothing
    encoder = ImpressionEncoder.of(CONFIG, smoothing=50.0).fit(rows)
    levels = next(s for s in encoder.stages if isinstance(s, encode.LevelEncoderModel))
    both = encode.encode_smoothings(encoder, rows, {"_0": 10.0, "_1": 50.0})
    for suffix, smoothing in (("_0", 10.0), ("_1", 50.0)):
        alone = encode.assemble_encoder(levels.with_smoothing(smoothing), rows).transform(rows)
        got = dict(both.select("id", f"features{suffix}").collect())
        assert got == dict(alone.select("id", "features").collect())


def test_grid_settings():
    same = combinations({"hidden": [(3,)], "step_size": [0.1, 0.01]})
    assert len(same) == 1
    assert len(combinations({"solver": ["gd"], "step_size": [0.1, 0.01]})) == 2
    with pytest.raises(ValueError):
        combinations({"hidden": []})
    with pytest.raises(ValueError):
        combinations({"alpha": [1]})


def test_nested_result_file(spark, tmp_path):
    import json
    results = [{"signature": str(i), "params": {"net__alpha": i}, "fold_scores": [], "mean_auc": i / 10,
                "std_auc": 0.0, "fold_times": []} for i in range(3)]
    (tmp_path / "grid_results.json").write_text(json.dumps({"results": results}))
    rows = show_results(spark, str(tmp_path), top_n=2).collect()
    assert [(r["alpha"], r["mean_auc"]) for r in rows] == [("2", 0.2), ("1", 0.1)]


def test_rounds_keep_the_best(spark, rows, encoder):
    fit, check = rows.where("id % 5 <> 0"), rows.where("id % 5 = 0")
    a, b = encode_rows(encoder, fit, "click"), encode_rows(encoder, check, "click")
    run = train_in_rounds(a, b, perceptron(model_width(encoder), (4,)), rounds=4,
                          iterations_per_round=3, patience=1, min_delta=0.0)
    losses = [r["val_loss"] for r in run.rounds]
    assert losses[run.best_round - 1] == min(losses)
    assert run.stopped_early == (len(losses) < 4 or losses[-1] >= min(losses[:-1]))
    hist = run.history(spark)
    assert hist.columns == ["epoch", "train_loss", "val_loss", "train_auc", "val_auc"]
    assert hist.count() == len(losses)
    for bad in ({"rounds": 0}, {"patience": 0}, {"min_delta": -1}):
        with pytest.raises(ValueError):
            train_in_rounds(a, b, perceptron(3, (2,)), **bad)


def test_explanations(rows, model):
    cases = rows.where("id in (1, 5)")
    names = ["d", "t", "h", "r", "band"]
    args = dict(categorical=names, numeric=["x", "y"], num_features=3, num_samples=400)
    one = explain(model, cases, rows, **args).collect()
    two = explain(model, cases.repartition(3), rows.repartition(5), **args).collect()
    assert len(one) == 6
    for a, b in zip(one, two):
        assert (a["case_id"], a["feature"]) == (b["case_id"], b["feature"])
        assert a["weight"] == pytest.approx(b["weight"], abs=1e-9)
    # the click rule depends on r most of all
    first = {r["case_id"]: r for r in one if r["rank"] == 1}
    assert first["1"]["feature"] == "r" and first["1"]["condition"] == "r=1"
    assert first["1"]["weight"] > 0 > first["5"]["weight"]
    assert all(math.isfinite(r["r2"]) for r in one)
    with pytest.raises(ValueError):
        explain(model, cases, rows, ["none"], ["x"])


def test_holdout_does_not_reach_the_fitted_state(rows):
    train = rows.where("id % 3 <> 0")
    changed = rows.withColumn("r", F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("r")))
    a = ImpressionEncoder.of(CONFIG).fit(train)
    b = ImpressionEncoder.of(CONFIG).fit(changed.where("id % 3 <> 0"))
    pick = ["id", "r_te", "h_te", "t_top"]
    assert a.transform(train).select(pick).exceptAll(b.transform(train).select(pick)).count() == 0


def test_search_runs_again_when_anything_changes(rows, spark, tmp_path):
    path, grid = str(tmp_path / "grid"), {"hidden": [(3,)], "max_iter": [4]}
    first = {r["signature"] for r in grid_search(rows, CONFIG, grid, path, num_folds=2).collect()}
    other = {r["signature"] for r in grid_search(rows, CONFIG, grid, path, num_folds=2,
                                                 seed=7).collect()}
    assert len(first) == len(other) == 1 and first != other
    again = grid_search(rows, CONFIG, grid, path, num_folds=2).collect()
    assert {r["signature"] for r in again} == first
    meta = spark.read.json(f"{path}.metadata").collect()
    assert len(meta) == 3 and {r["grid_size"] for r in meta} == {1}


def test_pool_draws_levels_by_their_frequency(spark):
    i = F.col("id")
    df = spark.range(9000).select(
        F.when(i % 3 > 0, "hot").otherwise(F.concat(F.lit("x"), i)).alias("a"),
        F.when(i % 4 == 0, None).otherwise((i % 2).cast("int")).alias("b"))
    pool = value_pool(df, ["a", "b"], 3000)
    rows = {r["draw"]: r for r in pool.collect()}
    assert sorted(rows) == list(range(3000)) and pool.columns == ["draw", "a", "b"]
    hot = sum(r["a"] == "hot" for r in rows.values())
    assert abs(hot - 2000) < 150
    assert len({r["a"] for r in rows.values()}) > 500
    for level, n in ((None, 750), ("0", 750), ("1", 1500)):
        assert abs(sum(r["b"] == level for r in rows.values()) - n) < 130
    both = sum(r["a"] == "hot" and r["b"] is None for r in rows.values())
    assert abs(both - 500) < 100  # unrelated columns
    again = value_pool(df.repartition(11).orderBy(F.desc("a")), ["a", "b"], 3000)
    assert {r["draw"]: r for r in again.collect()} == rows
    assert value_pool(df, ["a", "b"], 3000, seed=1).exceptAll(pool).count() > 0
    assert value_pool(df.limit(0), ["a", "b"], 10).count() == 0
    assert value_pool(df.limit(1), ["a"], 5).count() == 5


def test_encoding_queries_read_features_written_once(spark, sf):
    from adspark.plans.catalog import encoding

    for query in (encoding.encode_hybrid, encoding.encode_hybrid_bucketed, encoding.encoded_matrix):
        files = query(spark, sf).inputFiles()
        assert files and not any("events.parquet" in f for f in files)

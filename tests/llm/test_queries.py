"""Registered queries of the package against their SQL, and the pipeline."""

import oracle
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from adspark.llm.catalog import ORACLE, QUERIES
from conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    oracle.compare(QUERIES[name](spark, sf), oracle.connect(SF), ORACLE[name])


def test_all_are_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql())


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
        if name != "packing":
            assert out.columns == docs.columns, name
            assert 0 < out.count()
    assert out.agg(F.max("length")).first()[0] <= 1024
    bins = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert bins.agg(F.max("n")).first()[0] <= 1024
    whole = corpus_pipeline.run(spark, sf)
    assert whole.count() == out.count()


def test_pipeline_takes_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_pipeline_stages_take_null_and_repeated_ids(spark, sf, tmp_path):
    """Near duplicates against pairs of word shingles, the mix against its counts of words."""
    rows = []
    for k in range(12):
        base = [f"w{k}x{j}" for j in range(60)]
        for i in range(5):
            w = base if i % 2 else base[:-1] + [f"end{k}"]
            doc_id = None if (k + i) % 3 == 0 else 7 if (k + i) % 3 == 1 else 100 + 5 * k + i
            rows.append((doc_id, " ".join(w) + (f" {k}" if i == 4 else ""), "en", f"s{k % 2}", 1))
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars int").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    family = lambda text: text.split("x")[0]
    best = {}
    for doc_id, text, *_ in rows:
        key = (doc_id is None, doc_id or 0)
        best[family(text)] = min(best.get(family(text), key), key)
    assert sorted((family(r["text"]), (r["doc_id"] is None, r["doc_id"] or 0)) for r in got) == (
        sorted(best.items()))

    # all texts differ, so that copies can be told apart
    docs.withColumn("text", F.concat("text", F.lit(" "), F.monotonically_increasing_id().cast(
        "string"))).write.parquet(str(tmp_path / "own"))
    own = spark.read.parquet(str(tmp_path / "own"))
    size = lambda text: len(text.split())
    texts = {r["text"]: r["source"] for r in own.collect()}
    assert len(texts) == len(rows)
    out = corpus_pipeline.source_mix(spark, own, sf).collect()
    assert {r["text"] for r in out} <= set(texts) and any(r["doc_id"] is None for r in out)
    total = sum(map(size, texts))
    for source, weight in (("s0", 5), ("s1", 2)):
        mine = sum(size(t) for t, s in texts.items() if s == source)
        target = min(3 * mine, total * weight / 7)
        taken = sum(size(r["text"]) for r in out if r["source"] == source)
        assert abs(taken - target) <= 32
        times = [sum(r["text"] == t for r in out) for t, s in texts.items() if s == source]
        assert max(times) - min(times) <= 1  # whole repetitions, and one more for some


def test_stages_take_odd_rows_and_leave_one_table(spark, sf):
    """Null, empty, very long and repeated texts, null and repeated ids, extra columns."""
    good = " ".join(f"word{i} and other{i}." for i in range(60))
    rows = [(None, good), (None, good + " more"), (3, good), (3, None), (4, ""), (5, " \n "),
            (3, "a line that only this row has, as long as it needs\n" + good.replace("word", "w")),
            (6, " ".join(f"term{i}" for i in range(60_000)))]
    docs = spark.createDataFrame(
        [(i, t, "en", None if i == 3 else "s", None, "x", 1) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, gone int")
    kept = corpus_pipeline.quality_rules(spark, docs, sf)
    assert kept.columns == corpus_pipeline.COLUMNS
    assert {r["text"] for r in kept.collect()} <= {t for _, t in rows if t and t.strip()}
    out = corpus_pipeline.line_dedup(spark, docs, sf)
    assert not corpus_pipeline._returned["quality_rules"]  # was not read: it is written elsewhere
    got = out.collect()
    assert out.columns == corpus_pipeline.COLUMNS
    assert any("only this row has" in (r["text"] or "") for r in got)
    again = corpus_pipeline.near_duplicates(spark, out, sf)
    assert corpus_pipeline._returned["line_dedup"]  # read by the docs, so it stays
    mixed = corpus_pipeline.source_mix(spark, again, sf)
    packed = corpus_pipeline.packing_stage(spark, mixed, sf)
    assert packed.agg(F.max("length")).first()[0] <= 1024
    assert again.count() <= out.count()


def test_source_mix_leaves_the_texts_where_they_are(spark, sf, monkeypatch):
    from adspark.llm import mixing

    plans, expand = [], mixing.expand

    def seen(*args):
        out = expand(*args)
        plans.append(out._jdf.queryExecution().sparkPlan().toString())
        return out

    monkeypatch.setattr(mixing, "expand", seen)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        assert corpus_pipeline.source_mix(spark, docs, sf).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert len(plans) == 1
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]

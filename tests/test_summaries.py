"""Merged summaries against counts of all rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from adspark.operators import summaries as sm
from adspark.sources.scratch import new_scratch_path

SCHEMA = "day int, common string, even string, few int, none string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return [(rng.randint(1, 4), f"v{min(int(rng.paretovariate(0.9)), 900)}" if rng.random() < 0.9 else None,
             f"e{i % 3000}", i % 7, None) for i in range(9000)]


def brute(rows, at, k):
    counts = Counter(str(r[at]) for r in rows if r[at] is not None)
    return [(lv, n, i + 1) for i, (lv, n) in enumerate(
        sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k])]


@pytest.mark.parametrize("tracked", [64, 1024])
def test_frequent_levels_are_exact(spark, rows, tracked):
    df = spark.createDataFrame(rows, SCHEMA)
    names = ["common", "even", "few", "none"]
    stored = sm.summarize_levels(df, names, "day", tracked=tracked)
    got = sm.frequent_levels(df, stored, 5, tracked).collect()
    for i, name in enumerate(names, 1):
        mine = sorted((r["level"], r["n"], r["rank"]) for r in got if r["column"] == name)
        assert mine == sorted(brute(rows, i, 5)), name


def test_no_level_left_out_exceeds_the_bound(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    found = sm.candidate_levels(sm.summarize_levels(df, ["common", "even"], "day", tracked=64), 64).collect()
    for i, name in ((1, "common"), (2, "even")):
        mine = {r["level"]: r["bound"] for r in found if r["column"] == name}
        bound = max(mine.values())
        counts = Counter(r[i] for r in rows if r[i] is not None)
        assert len(counts) > 64
        assert all(n <= bound for lv, n in counts.items() if lv not in mine)


def test_groups_are_replaced_alone(spark, rows):
    path = new_scratch_path(spark, "summaries")
    df = spark.createDataFrame(rows, SCHEMA)
    columns = ["common", "even", "none"]
    sm.write_summaries(sm.summarize_levels(df.filter("day < 3"), columns, "day"), path, "day")
    wrong = df.filter("day = 3").limit(1).withColumn("day", F.lit(4))
    sm.write_summaries(sm.summarize_levels(wrong, columns, "day"), path, "day")
    sm.write_summaries(sm.summarize_levels(df.filter("day > 2"), columns, "day"), path, "day")
    stored = sm.read_summaries(spark, path)
    assert stored.count() == 12
    got = {r["column"]: r for r in sm.summary_cardinality(stored).collect()}
    for i, name in ((1, "common"), (2, "even"), (4, "none")):
        levels = {r[i] for r in rows} - {None}
        assert got[name]["n"] == len(rows)
        assert got[name]["n_null"] == sum(r[i] is None for r in rows)
        assert abs(got[name]["n_distinct"] - len(levels)) <= sm.DISTINCT_ERROR * len(levels)
    some = sm.summary_cardinality(stored.filter("day = 2")).filter("column = 'even'").first()
    assert some["n"] == sum(r[0] == 2 for r in rows)


def test_empty_tables_and_bad_sizes(spark, rows):
    df = spark.createDataFrame(rows[:3], SCHEMA)
    none = df.filter("false")
    stored = sm.summarize_levels(none, ["common"], "day")
    assert stored.count() == 0
    assert sm.frequent_levels(none, stored, 3).count() == 0
    with pytest.raises(ValueError):
        sm.frequent_levels(df, stored, 2000)

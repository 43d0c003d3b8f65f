import gzip
import random

import pytest
from pyspark.sql import functions as F

from adspark.sources import csv_to_parquet
from adspark.sources.gzipped import (
    SPLIT_BYTES, gzip_ranges, range_lines, read_gzip_csv, read_gzip_lines, write_gzip_csv,
)


def _by_ranges(path, step):
    size = path.stat().st_size
    return [x for low in range(0, size, step)
            for x in range_lines(f"file://{path}", low, min(size, low + step), size)]


def _members(rng, data):
    """The data cut anywhere, some members empty."""
    out, at = b"", 0
    while at < len(data):
        n = rng.choice([0, 1, 3, 50, 400])
        out += gzip.compress(data[at:at + n], rng.choice([0, 1, 9]))
        at += n
    return out


@pytest.mark.parametrize("seed", range(12))
def test_lines_against_brute_force(tmp_path, seed):
    rng = random.Random(seed)
    data = b"\n".join(bytes(rng.choice(b"abc, ") for _ in range(rng.choice([0, 1, 20, 900])))
                      for _ in range(60)) + rng.choice([b"", b"\n"])
    path = tmp_path / "x.gz"
    path.write_bytes(_members(rng, data))
    want = data.split(b"\n")
    want = want[:-1] if want[-1] == b"" else want
    for step in (1, 7, 100, 1000, 10**6):
        assert _by_ranges(path, step) == want


def test_one_member_is_read_by_the_first_range(spark, tmp_path):
    lines = [f"{i * i},{i}" for i in range(20_000)]
    path = tmp_path / "one.gz"
    path.write_bytes(gzip.compress("\n".join(lines).encode()))
    got = read_gzip_lines(spark, str(path), 10_000)
    assert got.rdd.getNumPartitions() == -(-path.stat().st_size // 10_000) > 1
    assert [r[0] for r in got.collect()] == lines
    tell = gzip_ranges(spark, str(path), 10_000).orderBy("low").collect()
    assert [r["first_member"] for r in tell] == [0] + [None] * (len(tell) - 1)


def test_a_member_inside_a_member_is_an_error_and_loses_nothing(tmp_path):
    inner = gzip.compress(b"mistaken\n" * 20)
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(b"a\n" * 50 + inner + b"\nb\n" * 50, 0) + gzip.compress(b"c\n"))
    with pytest.raises(ValueError, match="no gzip member ends"):
        _by_ranges(path, 60)


def test_damaged_files_are_errors(tmp_path):
    whole = gzip.compress(b"a,b\n" * 5000) + gzip.compress(b"c,d\n" * 5000)
    path = tmp_path / "x.gz"
    for bad in (whole[:-6], b"a,b\n" + whole):
        path.write_bytes(bad)
        with pytest.raises(Exception):
            _by_ranges(path, 10**6)
    path.write_bytes(b"")
    assert _by_ranges(path, 10) == []


def test_csv_by_ranges(spark, tmp_path):
    rows = spark.range(0, 5000, numPartitions=3).select(
        "id", F.when(F.col("id") % 7 > 0, F.concat(F.lit('x,"é'), F.col("id"))).alias("name"))
    folder = write_gzip_csv(rows, str(tmp_path / "csv"), 300)
    got = read_gzip_csv(spark, folder, rows.schema, 2_000)
    assert got.rdd.getNumPartitions() > 6
    assert sorted(got.collect()) == sorted(rows.collect())
    starts = gzip_ranges(spark, folder, 2_000).where("first_member is not null").count()
    assert starts > 6
    out = csv_to_parquet(spark, folder, str(tmp_path / "out"), rows.schema, gzip_split_bytes=2_000)
    assert out.count() == 5000
    plain = spark.read.schema(rows.schema).option("header", True).csv(folder)
    assert sorted(plain.collect(), key=str) == sorted(rows.collect(), key=str)


def test_headers_and_malformed_rows_fail(spark, tmp_path):
    path = tmp_path / "x.csv.gz"
    path.write_bytes(gzip.compress(b"a,b\r\n1,2\r\n") + gzip.compress(b"x,4\r\n"))
    schema = spark.createDataFrame([], "a int, b int").schema
    with pytest.raises(Exception, match="MALFORMED"):
        read_gzip_csv(spark, str(path), schema).collect()
    with pytest.raises(Exception, match="the header is"):
        read_gzip_csv(spark, str(path), spark.createDataFrame([], "a int, c int").schema).collect()
    with pytest.raises(Exception):
        read_gzip_csv(spark, str(tmp_path / "none"), schema).collect()
    with pytest.raises(ValueError):
        read_gzip_lines(spark, str(path), 0)
    assert SPLIT_BYTES > 0

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyspark.sources import clustered as C


def rows(spark, n=40_000):
    """Seven of ten rows lie in one month."""
    return spark.range(n).select(
        F.format_string("u%04d", F.col("id") * 7919 % 1000).alias("user_id"),
        (F.col("id") % 97).cast("double").alias("amount"),
        F.when(F.col("id") % 10 < 7, "2024-02").otherwise(F.concat(F.lit("2024-0"), F.col("id") % 10 - 4)).alias("period"),
    )


def test_scans_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    assert C.write_clustered(rows(spark), path, "a", "period", ["user_id"], files=8, group_bytes=4096) == 1
    table = C.read_clustered(spark, path)
    assert sorted(table.collect()) == sorted(rows(spark).collect())
    one = table.where("period = '2024-02' and user_id = 'u0124'")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "EqualTo(user_id,u0124)" in plan
    assert one.count() == rows(spark).where("period = '2024-02' and user_id = 'u0124'").count() > 0
    hot = glob.glob(f"{path}/data/*/period=2024-02/*.parquet")
    assert len(hot) >= 4  # the hot month is spread
    groups = [g for f in hot for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    spans = [g.column(0).statistics for g in groups]
    assert len(spans) >= 8 and sum(s.min <= "u0124" <= s.max for s in spans) <= 2


def test_versions_are_committed_once(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no committed version"):
        C.read_clustered(spark, path)
    for run_id, n, version in (("a", 100, 1), ("b", 200, 2), ("a", 999, 1), ("b", 999, 2)):  # the last two are retries
        assert C.write_clustered(rows(spark, n), path, run_id, "period", ["user_id"]) == version
    assert [C.read_clustered(spark, path, v).count() for v in (None, 1, 2)] == [200, 100, 200]
    assert C.manifest(spark, path).n_rows == 200 and len(C.committed(spark, path)) == 2
    # A run lost before its manifest was complete is not seen, and is written again by its retry.
    for mark in (tmp_path / "t" / "manifest").glob("*02-*/_SUCCESS"):
        mark.unlink()
    assert C.read_clustered(spark, path).count() == 100
    assert C.write_clustered(rows(spark, 300), path, "b", "period", ["user_id"]) == 2
    assert C.read_clustered(spark, path).count() == 300


def test_empty_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    C.write_clustered(rows(spark, 0), path, "empty", "period", ["user_id"])
    assert C.read_clustered(spark, path).count() == 0
    odd = spark.createDataFrame([(None, 1.0, "m"), ("u", None, None), ("u", None, None)], "user_id string, amount double, period string")
    C.write_clustered(odd, path, "odd", "period", ["user_id"])
    got = C.read_clustered(spark, path)
    assert got.columns == odd.columns and sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))

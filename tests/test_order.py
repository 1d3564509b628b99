from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import order
from tallyspark.functions.draws import row_hash, row_hashes
from tallyspark.functions.order import carry_forward, exact_median, place, running_position
from tallyspark.operators import splits as SP


@pytest.mark.parametrize("n", [0, 1, 3, 10, 90, 1000])
def test_split_sizes_are_exact(spark, n):
    rows = spark.range(n).select("id", (F.col("id") % 3).alias("v"))
    got = Counter(r.split for r in SP.split_by_hash(rows, ["id"]).collect())
    assert got["train"] == int(n * 0.8)
    assert got["train"] + got["val"] == int(n * 0.9)
    assert sum(got.values()) == n


def test_ninety_rows_give_sixty_two(spark):
    rows = spark.range(90).selectExpr("id", "date_add(date'2020-01-01', cast(id % 5 as int)) as period")
    split = SP.split_by_time(rows, "period", ["id"])
    got = Counter(r.split for r in split.collect())
    assert got == {"train": 62, "val": int(90 * 0.85) - 62, "test": 90 - int(90 * 0.85)}
    last = {s: split.where(F.col("split") == s).agg(F.max("period"), F.min("period")).first() for s in got}
    assert last["train"][0] <= last["val"][1] and last["val"][0] <= last["test"][1]


def test_split_does_not_depend_on_partitions(spark):
    rows = spark.range(500).select("id")
    one = {tuple(r) for r in SP.split_by_hash(rows.coalesce(1), ["id"]).collect()}
    many = {tuple(r) for r in SP.split_by_hash(rows.repartition(13), ["id"]).collect()}
    assert one == many


def test_split_inside_a_huge_group_of_copies(spark):
    rows = spark.range(200_000).select(F.when(F.col("id") < 199_990, "same").otherwise(F.col("id").cast("string")).alias("x"))
    split = SP.split_by_hash(rows)
    got = {(r.split): r["count"] for r in split.groupBy("split").count().collect()}
    assert got == {"train": 160_000, "val": 20_000, "test": 20_000}
    assert split.where("x = 'same'").count() == 199_990


def test_nulls_are_whole(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("b", 4)] * 5, "k string, v int")
    split = SP.split_by_hash(rows)
    assert split.count() == 20
    assert Counter(r.split for r in split.collect()) == {"train": 16, "val": 2, "test": 2}


def test_shuffled_split_moves_the_border_row_to_val(spark):
    got = Counter(r.split for r in SP.split_shuffled(spark.range(100), ["id"]).collect())
    assert got == {"train": 80, "val": 11, "test": 9}


def test_samples_and_caps(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, "train").otherwise("val").alias("split"))
    assert SP.sample_rows(rows, 50, ["id"]).distinct().count() == 50
    assert SP.sample_rows(rows.limit(7), 50, ["id"]).count() == 7
    got = Counter(r.split for r in SP.cap_sample(rows, 100, ["id"]).collect())
    assert got == {"train": 100, "val": 1000}


def test_median_of_a_hot_group(spark):
    rows = spark.range(30_001).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("g"),
        ((F.col("id") * 7919) % 1_000_003 - 1000).alias("v"),
    )
    expected = {}
    for r in rows.collect():
        expected.setdefault(r.g, []).append(r.v)
    got = {r.g: r.m for r in exact_median(rows, ["g"], "v", "m").collect()}
    for g, values in expected.items():
        values.sort()
        n = len(values)
        assert got[g] == (values[(n - 1) // 2] + values[n // 2]) / 2


def test_running_values_cross_buckets(spark):
    data = [("a", 1, "P"), ("a", 5, None), ("a", 11, None), ("a", 12, "Q"), ("a", 25, None), (None, 3, "R"), (None, 30, None)]
    rows = spark.createDataFrame(data, "k string, t int, v string")
    bucket = F.floor(F.col("t") / 10)
    carried = carry_forward(rows, ["k"], bucket, ["t"], F.col("v"), "before")
    assert {(r.k, r.t): r.before for r in carried.collect()} == {
        ("a", 1): None, ("a", 5): "P", ("a", 11): "P", ("a", 12): "P", ("a", 25): "Q", (None, 3): None, (None, 30): "R",
    }
    placed = running_position(rows, ["k"], bucket, ["t"], "i")
    assert {(r.k, r.t): r.i for r in placed.collect()} == {
        ("a", 1): 0, ("a", 5): 1, ("a", 11): 2, ("a", 12): 3, ("a", 25): 4, (None, 3): 0, (None, 30): 1,
    }


def test_different_rows_with_one_key(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    split = SP.split_by_hash(rows, ["k"])
    assert Counter(r.split for r in split.collect()) == {"train": 800, "val": 100, "test": 100}
    assert split.select("v").distinct().count() == 1000


def test_sample_of_a_wide_computed_table(spark):
    wide = spark.range(500).select(*[F.coalesce((F.col("id") * i).cast("double"), F.lit(0.0)).alias(f"c{i}") for i in range(1, 24)])
    assert SP.sample_rows(wide, 50, ["c1"]).count() == 50


@pytest.mark.parametrize("bits", [52, 20, 0])
def test_cuts_narrow_to_the_bound_whatever_the_hash_shares(spark, monkeypatch, bits):
    """A million rows whose hashes agree in all but ``bits`` digits, some rows copies: sizes are exact, windows stay small."""
    n, seen = 1_000_000, []
    monkeypatch.setattr(order, "row_hash", lambda seed, *key: F.col("h"))
    rows = spark.range(n, numPartitions=8).select(F.least("id", F.lit(n - 1000)).alias("id"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << bits)))
    narrow = order._in_spots

    def counted(frame, lead, names, spots):
        seen.append(max((s.rows for s in spots if not s.alike), default=0))
        return narrow(frame, lead, names, spots)

    monkeypatch.setattr(order, "_in_spots", counted)
    got = place(rows, lambda m: [m * 3 / 10, m - 500], key=["id"], bound=2000)
    sizes = {r.slot: r["count"] for r in got.groupBy("slot").count().collect()}
    assert sizes == {0: 300_000, 1: n - 500 - 300_000, 2: 500}
    assert seen[-1] <= 2000  # the rows that reach a window


def test_cut_among_copies_only(spark):
    rows = spark.range(50_000).select(F.lit("same").alias("x"))
    got = place(rows, lambda m: [m / 2], bound=100)
    assert {r.slot: r["count"] for r in got.groupBy("slot").count().collect()} == {0: 25_000, 1: 25_000}


def test_medians_by_bisection_equal_medians_by_ranges(spark):
    rows = spark.range(20_000).selectExpr(
        "if(id % 7 = 0, null, concat('g', id % 5)) as g", "date_add(date'2020-01-01', cast(id % 2 as int)) as d",
        "case when id % 11 = 0 then null when id % 5 = 1 then 3 else (xxhash64(id) div 1000003) * (id % 3 - 1) end as v",
    )
    one = {(r.g, r.d): r.m for r in exact_median(rows, ["g", "d"], "v", "m").collect()}
    two = {(r.g, r.d): r.m for r in exact_median(rows, ["g", "d"], "v", "m", few=0).collect()}
    assert len(one) == 12 and one == two
    wide = spark.createDataFrame([(-(2**63),), (2**63 - 1,), (5,)], "v bigint")
    assert exact_median(wide, [], "v", "m").first().m == 5.0
    assert exact_median(wide.limit(0), [], "v", "m").collect() == []


def test_no_row_is_shuffled_for_medians_of_few_groups(spark):
    """Only counts cross an exchange: the result is a local table, and flags are joined by broadcast."""
    rows = spark.range(1000).selectExpr("id % 3 as g", "id as v")
    medians = exact_median(rows, ["g"], "v", "m")
    plan = rows.join(medians, "g")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_hashes_over_arrow_batches_are_row_hashes(spark):
    texts = ["", "a", None, "é€𝄞", *("x" * n for n in (47, 48, 51, 52, 55, 56, 63, 64, 119, 120, 121, 300))]
    rows = spark.createDataFrame([(t, i % 3 or None) for i, t in enumerate(texts * 3)], "a string, b int").repartition(5)
    seeds = ["42", "42x", "7", "a longer seed"]
    found = rows.select("a", "b", row_hashes(seeds, "a", "b").alias("all"), *(row_hash(s, "a", "b").alias(s) for s in seeds))
    assert all(r["all"][s] == r[s] for r in found.collect() for s in seeds)


def test_split_by_a_written_hash(spark):
    rows = spark.range(500).withColumn("twice", F.col("id") % 250)
    want = SP.split_by_hash(rows, ["twice"]).collect()
    with_hash = rows.withColumn("own", row_hash(42, "twice"))
    assert sorted(SP.split_by_hash(with_hash, ["twice"], hashed="own").collect()) == sorted(want)
    empty = SP.split_by_hash(with_hash.limit(0), ["twice"], hashed="own")
    assert empty.columns == ["id", "twice", "split"] and empty.isEmpty()

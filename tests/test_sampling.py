"""Exact splits, bucketed ranks, per-cell samples, resampling."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from modlens.functions import md5_hex
from modlens.operators import sampling as smp


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.integers(0, 5), st.integers(1, 500), min_size=1, max_size=4))
def test_split_quotas_are_exact(spark, counts):
    rows = smp.split_quotas(spark.createDataFrame(list(counts.items()), "c int, n bigint"), "c").collect()
    q = {r["c"]: (r["n"], r["held"], r["test"]) for r in rows}
    n = sum(counts.values())
    held = (n + 4) // 5
    test = (held + 1) // 2
    assert sum(h for _, h, _ in q.values()) == held
    assert sum(t for _, _, t in q.values()) == test
    for c, (nc, h, t) in q.items():
        assert nc == counts[c] and 0 <= t <= h <= nc


def _labelled(spark, n, ratio):
    return spark.range(n).select(F.col("id").alias("k"),
                                 (F.col("id") % ratio == 0).cast("int").alias("label"))


def test_split_small_sizes_and_one_label(spark):
    for n in (1, 2, 9, 10, 101):
        for ratio in (10, 1):  # 9:1 labels, and one label only
            df = _labelled(spark, n, ratio)
            out = smp.stratified_split(df, "k", "label").collect()
            assert len(out) == n and len({r["k"] for r in out}) == n
            counts = {}
            for r in out:
                counts[r["split"]] = counts.get(r["split"], 0) + 1
            held = (n + 4) // 5
            assert counts.get("val", 0) + counts.get("test", 0) == held
            assert counts.get("test", 0) == (held + 1) // 2


def test_split_invariant_under_repartition(spark):
    df = _labelled(spark, 3000, 7)
    a = {r["k"]: r["split"] for r in smp.stratified_split(df, "k", "label").collect()}
    b = {r["k"]: r["split"] for r in smp.stratified_split(df.repartition(13), "k", "label", digits=4).collect()}
    assert a == b


def test_bucketed_rank_equals_window(spark):
    df = _labelled(spark, 5000, 3)
    h = md5_hex(F.col("k"), 42)
    fast = smp.bucketed_rank(df, h, "k", ["label"], "r", digits=2)
    w = Window.partitionBy("label").orderBy(h, F.col("k"))
    naive = df.withColumn("r", F.row_number().over(w).cast("bigint"))
    assert fast.exceptAll(naive).count() == 0 and fast.count() == 5000


def test_two_level_offsets_equal_window(spark):
    df = _labelled(spark, 4000, 3)
    h = md5_hex(F.col("k"), 7)
    w = Window.partitionBy("label").orderBy(h, F.col("k"))
    naive = df.withColumn("r", F.row_number().over(w).cast("bigint"))
    for d in (4, 5):
        fast = smp.bucketed_rank(df, h, "k", ["label"], "r", digits=d)
        assert fast.exceptAll(naive).count() == 0 and fast.count() == 4000
    pos = smp.shuffle_order(df.select("k"), "k", epoch=2)  # size unknown: 2^20 buckets
    assert sorted(r["pos"] for r in pos.collect()) == list(range(1, 4001))


def test_bucket_digits_scale_with_rows():
    assert smp.bucket_digits(10_000) == 3
    assert smp.bucket_digits(4_000_000_000) == 3
    assert smp.bucket_digits(10 ** 12) == 5       # ~1M rows per bucket
    assert smp.bucket_digits(10 ** 18) == 8
    assert smp.bucket_digits(None) == 5


def test_sorted_rank_is_dense_and_ordered(spark):
    df = spark.range(3000).select((F.col("id") % 17).alias("n"), F.col("id").cast("string").alias("t"))
    ranked = smp.sorted_rank(df, [F.col("n").desc(), F.col("t")], "r").collect()
    ranks = sorted(r["r"] for r in ranked)
    assert ranks == list(range(1, 3001))
    order = sorted(ranked, key=lambda r: r["r"])
    keys = [(-r["n"], r["t"]) for r in order]
    assert keys == sorted(keys)


def test_sample_per_group_bounded_and_deterministic(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 4).alias("g"))
    df = df.where(~((F.col("g") == 3) & (F.col("k") > 40)))  # group 3 holds fewer than n
    a = smp.sample_per_group(df, ["g"], 20, "k")
    counts = {r["g"]: r["count"] for r in a.groupBy("g").count().collect()}
    assert counts[0] == counts[1] == counts[2] == 20 and counts[3] == 10
    b = smp.sample_per_group(df.repartition(7), ["g"], 20, "k")
    assert a.exceptAll(b).count() == 0


def test_class_weights(spark):
    df = _labelled(spark, 10, 10)  # one positive, nine negatives
    w = {r["k"]: r["weight"] for r in smp.class_weights(df).collect()}
    assert w[0] == 1.0 and abs(w[1] - 1 / 9) < 1e-15


def test_balanced_resample_balances_classes(spark):
    df = _labelled(spark, 4000, 10)
    out = smp.balanced_resample(df, "k", "label")
    per = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert abs(per[0] - 2000) < 200 and abs(per[1] - 2000) < 200
    again = smp.balanced_resample(df.repartition(5), "k", "label")
    assert out.exceptAll(again).count() == 0


def test_rare_class_copies_are_chunked_and_complete(spark):
    df = _labelled(spark, 1000, 1000)          # key 0 is the only positive: rate 500
    plain = smp.balanced_resample(df, "k", "label", copy_chunk=1 << 16)
    chunked = smp.balanced_resample(df, "k", "label", copy_chunk=8)
    assert "Exchange" in chunked._jdf.queryExecution().executedPlan().toString()
    assert plain.exceptAll(chunked).count() == 0 and chunked.exceptAll(plain).count() == 0
    copies = [r["copy"] for r in chunked.where(F.col("k") == 0).collect()]
    assert len(set(copies)) == len(copies) and abs(len(copies) - 500) < 5 * 500 ** 0.5


def test_one_poisson_rule_for_every_rate(spark):
    """Mean and variance are the rate, below and above one draw's rate."""
    for rare in (500, 50):
        df = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 1000 < 1000 // rare).cast("int").alias("label"))
        n = df.where("label = 1").count()
        rate = 20_000 / (2 * n)
        k = [r["count"] for r in smp.balanced_resample(df, "k", "label").where("label = 1").groupBy("k").count().collect()]
        mean = sum(k) / n
        var = sum((x - mean) ** 2 for x in k) / n
        assert abs(mean - rate) < 5 * (rate / n) ** 0.5 and 0.4 * rate < var < 2 * rate


def test_null_class_raises_and_types_are_fixed(spark):
    df = _labelled(spark, 50, 5).withColumn("label", F.when(F.col("k") != 3, F.col("label")))
    for f in (smp.class_weights, lambda d: smp.balanced_resample(d, "k"), lambda d: smp.stratified_split(d, "k")):
        with pytest.raises(ValueError):
            f(df)
    for classes in (3, 64, 65, 100):
        many = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % classes).alias("label"))
        assert smp.class_weights(many).dtypes == [("k", "bigint"), ("label", "bigint"), ("weight", "double")]
        assert smp.balanced_resample(many, "k").dtypes[-1] == ("copy", "bigint")


def test_split_moves_no_rows(spark):
    """The split is a comparison with cut points: no exchange, sort or window carries the text."""
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("label"), F.lit("a text").alias("text"))
    out = smp.stratified_split(df, "k", "label")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "hashpartitioning" not in plan
    assert "BroadcastHashJoin" in plan


def test_batches_fixed_size(spark):
    df = spark.range(130).select(F.col("id").alias("k"))
    b = {r["batch_id"]: r["count"] for r in smp.batches(df, "k", 64).groupBy("batch_id").count().collect()}
    assert b == {0: 64, 1: 64, 2: 2}


def test_many_classes_use_the_join_path(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 100).alias("label"))
    out = smp.stratified_split(df, "k", "label")
    assert out.columns == ["k", "label", "split"]
    per = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert per == {"train": 1600, "val": 200, "test": 200}
    w = smp.class_weights(df)
    assert {round(r["weight"], 12) for r in w.collect()} == {0.05}

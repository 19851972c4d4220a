"""Exact draws, epoch shards, alignment by position, merged sketches, splits in few reads."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from modlens.operators import aggregate as agg
from modlens.operators import evaluate as ev
from modlens.operators import sampling as smp
from modlens.session import scratch_path


def labelled(spark, counts, extra=True):
    rows = [(100 * lab + i, lab, f"t{i}") for lab, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k bigint, label int, text string")
    return df.withColumn("n", F.lit(1)).withColumn("copy_", F.lit(2)).withColumn("id", F.lit(3)) if extra else df


@pytest.mark.parametrize("counts, n", [({0: 90, 1: 10}, None), ({0: 90, 1: 10}, 7), ({0: 50, 1: 1, 2: 30}, 5000), ({4: 3}, 1), ({0: 5}, 0)])
def test_exactly_n_draws(spark, counts, n):
    rows = smp.exact_resample(labelled(spark, counts), "k", n_draws=n).collect()
    assert len(rows) == (sum(counts.values()) if n is None else n)
    seen = Counter(r["k"] for r in rows)
    assert all(sorted(r["copy"] for r in rows if r["k"] == k) == list(range(1, c + 1)) for k, c in seen.items())


def test_classes_are_drawn_alike_and_rows_within_them(spark):
    rows = smp.exact_resample(labelled(spark, {0: 90, 1: 10, 2: 1}), "k", n_draws=30_000).collect()
    per = Counter(r["label"] for r in rows)
    assert all(abs(per[c] - 10_000) < 500 for c in (0, 1, 2))
    ones = Counter(r["k"] for r in rows if r["label"] == 1)
    assert len(ones) == 10 and all(abs(v - 1000) < 200 for v in ones.values())


def test_draws_do_not_depend_on_partitions_and_change_with_the_seed(spark):
    df = labelled(spark, {0: 60, 1: 20}, extra=False)
    draw = lambda d, **kw: sorted(tuple(r) for r in smp.exact_resample(d, "k", **kw).collect())
    assert draw(df) == draw(df.repartition(11)) == draw(df, digits=4)
    assert draw(df) != draw(df, seed=7)


def test_no_rows_no_draws_and_null_labels(spark):
    empty = spark.createDataFrame([], "k bigint, label int")
    assert smp.exact_resample(empty, "k").collect() == []
    assert smp.exact_resample(empty, "k", n_draws=5).collect() == []
    with pytest.raises(ValueError):
        smp.exact_resample(spark.createDataFrame([(1, None), (2, 0)], "k bigint, label int"), "k")


def test_shards_hold_batches_in_order(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").withColumn("text", F.concat(F.lit("t"), "k"))
    path = scratch_path(spark, "shards")
    manifest = smp.write_epoch_shards(df, "k", path, 64, epoch=3, batches_per_shard=4).orderBy("shard").collect()
    assert [tuple(r) for r in manifest] == [(0, 0, 3, 256, 1, 256), (1, 4, 7, 256, 257, 512), (2, 8, 11, 256, 513, 768),
                                            (3, 12, 15, 232, 769, 1000)]
    schema = "k bigint, text string, pos bigint, batch_id bigint, shard bigint"
    rows = smp.read_epoch_shards(spark, path, schema).collect()
    want = {r["k"]: (r["pos"], r["batch_id"]) for r in smp.batches(df, "k", 64, epoch=3).collect()}
    assert {r["k"]: (r["pos"], r["batch_id"]) for r in rows} == want
    first = {r["shard"]: r["first_pos"] for r in manifest}
    assert all(r["pos"] == first[r["shard"]] + r["_file_pos"] for r in rows)
    some = smp.read_epoch_shards(spark, path, schema, 1, 2)
    assert "PartitionFilters: [isnotnull(shard" in some._jdf.queryExecution().executedPlan().toString()
    assert {r["shard"] for r in some.collect()} == {1, 2}


def test_shards_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k bigint")
    assert smp.write_epoch_shards(empty, "k", scratch_path(spark, "no-shards"), 8).collect() == []


def two_tables(spark, n, m):
    a, b = scratch_path(spark, "left"), scratch_path(spark, "right")
    spark.range(n).select(F.col("id").alias("a")).repartitionByRange(5, "a").sortWithinPartitions("a").write.parquet(a)
    spark.range(m).select((F.col("id") * 2).alias("b")).repartitionByRange(3, "b").sortWithinPartitions("b").write.parquet(b)
    return spark.read.parquet(a), spark.read.parquet(b)


def test_alignment_by_position(spark):
    rows = ev.align_by_position(*two_tables(spark, 100, 100)).orderBy("pos").collect()
    assert [(r["pos"], r["a"], r["b"]) for r in rows] == [(i, i, 2 * i) for i in range(100)]
    assert ev.align_by_position(*two_tables(spark, 0, 0)).collect() == []


def test_tables_that_cannot_be_aligned_raise(spark):
    with pytest.raises(ValueError, match="10 rows"):
        ev.align_by_position(*two_tables(spark, 10, 9))
    a, _ = two_tables(spark, 3, 3)
    with pytest.raises(ValueError, match="both"):
        ev.align_by_position(a, a)


def test_sketches_merge_loads_without_rereading(spark):
    path = scratch_path(spark, "sketches")
    for load in range(3):  # loads overlap: 0-1999, 1000-2999, 2000-3999
        df = spark.range(load * 1000, load * 1000 + 2000).select(F.when(F.col("id") % 10 != 0, F.col("id")).alias("v"),
                                                                 F.lit(load).alias("load"))
        agg.write_profile_sketches(df, path, "v", by=["load"])
    stored = spark.read.parquet(path)
    row = agg.merge_profile_sketches(stored).first()
    assert (row["n"], row["n_null"]) == (6000, 600)
    assert abs(row["distinct_estimate"] - 3600) <= agg.SKETCH_BOUND * 3600
    per = {r["load"]: r["n"] for r in agg.merge_profile_sketches(stored, ["load"]).collect()}
    assert per == {0: 2000, 1: 2000, 2: 2000}


def test_a_split_reads_keys_twice_and_starts_few_jobs(spark):
    df = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    sc = spark.sparkContext
    sc.setJobGroup("split", "split")
    out = smp.stratified_split(df, "k", on=df.mapInArrow(seen, df.schema))
    jobs = len(sc.statusTracker().getJobIdsForGroup("split"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert read.value == 2 * 2000
    assert jobs <= 20  # an adaptive plan runs each exchange as a job
    plain = {r["k"]: r["split"] for r in smp.stratified_split(df, "k").collect()}
    assert {r["k"]: r["split"] for r in out.collect()} == plain
    assert {r["k"]: r["split"] for r in smp.stratified_split(df, "k", keep_keys=True, digits=2).collect()} == plain

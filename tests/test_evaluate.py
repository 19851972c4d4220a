"""Metrics, confusion matrices, batch means, loss."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modlens.operators import evaluate as ev
from modlens.operators import sampling as smp


def _frame(spark, pairs):
    return spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(pairs)],
                                 "k long, label int, pred int")


def _metrics(spark, pairs):
    return ev.binary_metrics(_frame(spark, pairs)).first().asDict()


def test_zero_over_zero_is_zero(spark):
    m = _metrics(spark, [(0, 0), (0, 0)])
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 1.0)
    m = _metrics(spark, [(1, 1), (1, 1)])
    assert (m["precision"], m["recall"], m["f1"]) == (1.0, 1.0, 1.0)


def test_empty_input(spark):
    m = ev.binary_metrics(_frame(spark, [])).collect()
    assert len(m) == 1 and m[0]["n"] == 0 and m[0]["f1"] == 0.0


def test_dense_confusion_matrix_with_missing_class(spark):
    cm = ev.confusion_matrix_long(_frame(spark, [(0, 0), (0, 0), (0, 1)]))
    got = {(r["label"], r["pred"]): r["n"] for r in cm.collect()}
    assert got == {(0, 0): 2, (0, 1): 1, (1, 0): 0, (1, 1): 0}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=40))
def test_metric_bounds(spark, pairs):
    m = _metrics(spark, pairs)
    for k in ("accuracy", "precision", "recall", "f1"):
        assert 0.0 <= m[k] <= 1.0
    if m["precision"] > 0 and m["recall"] > 0:
        lo, hi = sorted((m["precision"], m["recall"]))
        assert lo - 1e-12 <= m["f1"] <= hi + 1e-12
    assert m["tp"] + m["fp"] + m["fn"] + m["tn"] == m["n"] == len(pairs)


def test_batch_mean_differs_from_global(spark):
    # 7 rows in batches of 3, positives only in the last batch
    df = spark.createDataFrame([(i, 1 if i == 6 else 0, 1 if i >= 5 else 0, i // 3) for i in range(7)],
                               "k long, label int, pred int, batch_id long")
    bm = ev.epoch_batch_mean(df).first()
    g = ev.binary_metrics(df).first()
    assert math.isclose(bm["accuracy"], g["accuracy"])
    assert bm["n_batches"] == 3 and bm["n"] == 7
    assert not math.isclose(bm["precision"], g["precision"])


def test_batch_accuracy_equals_global_on_real_batches(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"),
                                 (F.col("id") % 4 == 0).cast("int").alias("pred"))
    b = smp.batches(df, "k", 64)
    assert math.isclose(ev.epoch_batch_mean(b).first()["accuracy"], ev.binary_metrics(df).first()["accuracy"])


def test_bce_nonnegative_and_matches_formula(spark):
    df = spark.createDataFrame([(1, 2.0), (0, -1.0), (1, -30.0), (0, 40.0)], "label int, z double")
    got = ev.bce_loss(df, "label", "z").first()["loss"]
    sp = lambda x: max(x, 0) + math.log1p(math.exp(-abs(x)))
    want = (sp(-2.0) + sp(-1.0) + sp(30.0) + sp(40.0)) / 4
    assert got >= 0 and math.isclose(got, want, rel_tol=1e-12)


def test_disagreement_cells(spark):
    df = spark.createDataFrame([(0, 0, 0, 1), (1, 1, 1, 0), (2, 0, 1, 0), (3, 1, 0, 1), (4, 1, 1, 1)],
                               "k long, label int, a int, b int")
    got = {r["k"]: r["cell"] for r in ev.disagreements(df, "label", "a", "b", "a", "b").collect()}
    assert got == {0: "TN_a", 1: "TP_a", 2: "TN_b", 3: "TP_b"}


def test_align_predictions_validates(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1)], "k long, label int")
    preds = spark.createDataFrame([(1, 0), (3, 1)], "k long, pred int")
    try:
        ev.align_predictions(labels, preds, "k", validate=True)
    except ValueError:
        pass
    else:
        raise AssertionError("key mismatch not detected")

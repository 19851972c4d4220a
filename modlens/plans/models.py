"""Model lifecycle queries (training, scoring, checkpoints, epoch logs).

Training is iterative, so keys that return losses and scores of a text model have no SQL oracle; what must
hold of them is in ``model_checks.py``, with SQL. ``tests/test_models.py`` checks the models (better than the base rate, same seed gives the same
model, reload gives the same predictions, early stopping stops where the rule says).
Every call fits: no model is kept between calls.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.operators import evaluate as ev
from modlens.operators import ml
from modlens.operators import sampling as smp
from modlens.operators.partitioning import spread
from modlens.plans import inputs as I
from modlens.session import scratch_path
from modlens.sources import files
from modlens.sources.tables import table

MODEL_QUERIES: dict = {}

# Training settings of the demonstration models.
TEXT_FEATURES = 1 << 16
TEXT_REG = 0.05
TEXT_MIN_DOC_FREQ = 3
EPOCH_FEATURES = 1 << 12
MAX_EPOCHS = 20
PATIENCE = 3
MIN_DELTA = 1e-4
POS_WEIGHT = 1.0
HEAD_REG = 0.01


def _register(name):
    def deco(fn):
        MODEL_QUERIES[name] = fn
        return fn
    return deco


def split_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    # few input files would leave the passes of a fit to one core
    return smp.stratified_split(spread(I.labeled(spark, sf_dir), "doc_id"), "doc_id", "label", seed=I.SEED,
                                on=I.labeled_ids(spark, sf_dir, with_label=True))


def _fit(spark, sf_dir):
    """The text model fitted on the training part, and the split documents."""
    data = split_labeled(spark, sf_dir)
    model = ml.fit_text_classifier(data.where(F.col("split") == "train"), "text", "label",
                                   pos_weight=POS_WEIGHT, reg=TEXT_REG, num_features=TEXT_FEATURES,
                                   min_doc_freq=TEXT_MIN_DOC_FREQ)
    return model, data


@_register("ml_fit_text")
def ml_fit_text(spark, sf_dir):
    """Per split: rows, model log-loss and the constant base-rate log-loss."""
    model, data = _fit(spark, sf_dir)
    scored = ml.score(model, data, "doc_id", "label", carry=["split"])
    base = data.where(F.col("split") == "train").agg(F.avg("label").alias("p")).first()["p"]
    z_base = math.log(base / (1 - base)) if base and 0 < base < 1 else 0.0
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(ev.bce_with_logits("label", "logit")).alias("logloss"),
        F.avg(ev.bce_with_logits("label", F.lit(z_base))).alias("base_logloss"),
    )


@_register("ml_score")
def ml_score(spark, sf_dir):
    """Fit, then score the test part."""
    model, data = _fit(spark, sf_dir)
    return ml.score(model, data.where(F.col("split") == "test"), "doc_id", "label")


@_register("ml_test_metrics")
def ml_test_metrics(spark, sf_dir):
    """Test pass: BCE loss, global accuracy / precision / recall / F1, and the same as logged per
    batch (weighted by batch size)."""
    model, data = _fit(spark, sf_dir)
    path = scratch_path(spark, "test_scores")
    ml.score(model, data.where(F.col("split") == "test"), "doc_id", "label").write.parquet(path)
    s = spark.read.parquet(path)
    a = s.agg(F.avg(ev.bce_with_logits("label", "logit")).alias("loss"),
              *ev.confusion_aggs("label", "pred")).select("n", "loss", *ev.metric_columns())
    batched = smp.batches(s, "doc_id", I.BATCH_SIZE, epoch=0, seed=I.SEED)
    m = ev.epoch_batch_mean(batched, "batch_id", "label", "pred").drop("n")
    # one row each
    return a.withColumn("_1", F.lit(1)).join(
        m.toDF(*[c if c == "n_batches" else f"batch_{c}" for c in m.columns]).withColumn("_1", F.lit(1)), "_1").drop("_1")


def _train(spark, sf_dir, on_epoch=None):
    """Epoch training on class-balanced draws of the training part."""
    data = split_labeled(spark, sf_dir)
    train = smp.balanced_resample(data.where(F.col("split") == "train"), "doc_id", "label", seed=I.SEED)
    path = scratch_path(spark, "best_epoch")
    model, log = ml.train_epochs(train, data.where(F.col("split") == "val"), path, "text", "label",
                                 num_features=EPOCH_FEATURES, max_epochs=MAX_EPOCHS,
                                 patience=PATIENCE, min_delta=MIN_DELTA, on_epoch=on_epoch)
    return model, log, data, path


@_register("ml_checkpoint_reload")
def ml_checkpoint_reload(spark, sf_dir):
    """Train by epochs, keep the best by validation loss, and score the test part with the kept model
    read back twice."""
    model, _, data, path = _train(spark, sf_dir)
    test = data.where(F.col("split") == "test")
    a = ml.score(model, test, "doc_id", "label").select("doc_id", "label", "pred")
    b = ml.score(ml.best_model(spark, path), test, "doc_id", "label").select("doc_id", F.col("pred").alias("again"))
    return a.join(b, "doc_id").select("doc_id", "label", (F.col("pred") == F.col("again")).alias("same"))


def rule_holds(log) -> bool:
    """Whether the early-stopping rule, replayed over a log's validation losses, gives its logged state."""
    least, wait, holds = math.inf, 0, True
    for r in log:
        improved = r.val_loss < least - MIN_DELTA
        least, wait = (r.val_loss, 0) if improved else (least, wait + 1)
        holds = holds and (r.improved, r.wait, r.stopped) == (improved, wait, wait >= PATIENCE)
    return holds


INTERRUPTED_AFTER, RESUMED_TO = 2, 4


@_register("ml_resumed_training")
def ml_resumed_training(spark, sf_dir):
    """A run stopped after two epochs and resumed, beside one that never stopped. Per test document whether both
    kept models agree, and about the logs: the same epochs and losses, the early-stopping rule replayed
    over the losses gives the logged state, and the kept epoch has the least validation loss."""
    data = split_labeled(spark, sf_dir).persist()
    train, val = (data.where(F.col("split") == s) for s in ("train", "val"))
    args = ("text", "label", EPOCH_FEATURES)
    whole_path, path = scratch_path(spark, "whole_run"), scratch_path(spark, "stopped_run")
    whole, log = ml.train_epochs(train, val, whole_path, *args, RESUMED_TO, PATIENCE, MIN_DELTA)
    ml.train_epochs(train, val, path, *args, INTERRUPTED_AFTER, PATIENCE, MIN_DELTA)
    again, resumed = ml.train_epochs(train, val, path, *args, RESUMED_TO, PATIENCE, MIN_DELTA, resume=True)
    near = lambda a, b: math.isclose(a, b, rel_tol=1e-6)  # noqa: E731  (sums of partitions come in any order)
    same = len(log) == len(resumed) and all(
        (a.epoch, a.improved, a.wait, a.stopped) == (b.epoch, b.improved, b.wait, b.stopped)
        and near(a.train_loss, b.train_loss) and near(a.val_loss, b.val_loss) for a, b in zip(log, resumed))
    rule = rule_holds(resumed)
    best = min(r.val_loss for r in resumed) == resumed[-1].best_val_loss
    test = data.where(F.col("split") == "test")
    a = ml.score(whole, test, "doc_id").select("doc_id", "label", F.col("logit").alias("_a"))
    b = ml.score(again, test, "doc_id").select("doc_id", F.col("logit").alias("_b"))
    return a.join(b, "doc_id").select("doc_id", "label", (F.abs(F.col("_a") - F.col("_b")) < 1e-4).alias("same_model"),
                                      F.lit(same).alias("same_log"), F.lit(rule).alias("rule_holds"),
                                      F.lit(best).alias("best_is_least"))


@_register("ml_score_external")
def ml_score_external(spark, sf_dir):
    """The fixed linear head as a model file, applied to all embeddings batch by batch."""
    import numpy as np

    from modlens.plans.catalog import LINEAR_HEAD_BIAS, linear_head_weights

    def load(model: bytes):
        """A predictor from the demonstration file: a float64 array of weights, then the bias."""
        w = np.frombuffer(model)

        def predict(vectors):
            products = vectors.astype(np.float64) * w[:-1]
            return np.add.accumulate(products, axis=1)[:, -1] + w[-1]
        return predict

    model = np.array([*linear_head_weights(), LINEAR_HEAD_BIAS]).tobytes()
    path = ml.write_model_bytes(spark, model, scratch_path(spark, "external_model"))
    scored = ml.score_external(table(spark, sf_dir, "embeddings"), path, load, ["embedding"], ["vec_id"])
    return scored.select("vec_id", F.round("logit", 6).alias("z"), "pred")


@_register("ml_train_epochs")
def ml_train_epochs(spark, sf_dir):
    """One row per epoch run: train / val loss, best so far, early-stopping state."""
    _, log, _, _ = _train(spark, sf_dir)
    rows = [(r.epoch, float(r.train_loss), float(r.val_loss), float(r.best_val_loss),
             bool(r.improved), int(r.wait), bool(r.stopped)) for r in log]
    return spark.createDataFrame(rows, "epoch int, train_loss double, val_loss double, "
                                       "best_val_loss double, improved boolean, wait int, stopped boolean")


@_register("ml_epoch_log")
def ml_epoch_log(spark, sf_dir):
    """Metric rows appended to a Parquet log at the end of every epoch, read back."""
    path = scratch_path(spark, "epoch_log")
    run = "perceptron"

    def on_epoch(rec):
        files.append_metric_log(ml.epoch_log_frame(spark, run, [rec]), path)

    _train(spark, sf_dir, on_epoch)
    return spark.read.parquet(path)


@_register("ml_fit_embedding_head")
def ml_fit_embedding_head(spark, sf_dir):
    """Logistic head on the 64-d pooled vectors, label = class 0, both classes weighing the same; scored on the
    held-out splits. Fitted to its only optimum, so any other solver gives the same probabilities."""
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("label") == 0, 1).otherwise(0).alias("label"))
    data = smp.stratified_split(e, "vec_id", "label", seed=I.SEED)
    train = data.where(F.col("split") == "train")
    model = ml.fit_embedding_head(train, "embedding", "label", pos_weight=ml.balanced_pos_weight(train), reg=HEAD_REG,
                                  max_iter=500, tol=1e-12, standardize=False)
    scored = ml.score_embedding_head(model, data.where(F.col("split") != "train"), "vec_id", "embedding", "label")
    return scored.select("vec_id", "label", F.round("prob", 4).alias("prob"), "pred")

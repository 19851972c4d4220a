"""Model queries whose rows SQL can give: what must hold of any correct fit, whatever its weights.

A logistic fit with a free intercept predicts on average the share of positives it was fitted on; metrics
follow from the cells; a batch-averaged accuracy is the global one; an epoch log has every epoch
once, its early-stopping state follows from its losses, and the kept model, read back, scores what
the log says of the epoch with the least validation loss.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from modlens.operators import evaluate as ev
from modlens.operators import ml
from modlens.operators import sampling as smp
from modlens.plans import inputs as I
from modlens.plans.models import _fit, _train, rule_holds
from modlens.session import scratch_path
from modlens.sources import files

CHECK_QUERIES: dict = {}

#: Two sums of the same numbers in different orders, or through a sigmoid and back, differ by less.
NEAR = 1e-6


def _register(name):
    def deco(fn):
        CHECK_QUERIES[name] = fn
        return fn
    return deco


def _near(a, b):
    return F.abs(a - b) <= NEAR


@_register("ml_text_checks")
def ml_text_checks(spark, sf_dir):
    """Fit, score every split, and evaluate it globally and batch by batch. Per split: rows, positives,
    batches, and whether predictions and probabilities follow the logit, the metrics follow the cells, and the
    batch-averaged accuracy is the global one. Of the fitted part also the mean probability and whether the
    model beats the constant of its base rate there, as an optimum must; on held-out rows a correct fit
    may lose to it, which ``ml_fit_text`` shows."""
    model, data = _fit(spark, sf_dir)
    path = scratch_path(spark, "scores")
    ml.score(model, data, "doc_id", "label", carry=["split"]).write.parquet(path)
    s = spark.read.parquet(path)
    base = s.where("split = 'train'").agg(F.avg("label")).first()[0]
    z_base = math.log(base / (1 - base)) if base and 0 < base < 1 else 0.0
    z = F.col("logit")
    whole = s.groupBy("split").agg(
        *ev.confusion_aggs("label", "pred"), F.avg("prob").alias("mean_prob"),
        (F.avg(ev.bce_with_logits("label", "logit"))
         < F.avg(ev.bce_with_logits("label", F.lit(z_base)))).alias("beats_base"),
        F.bool_and((F.col("pred") == (z > 0).cast("int")) & _near(F.col("prob"), 1 / (1 + F.exp(-z)))).alias("pred_follows_logit"))
    whole = whole.select("*", *ev.metric_columns())
    parts = [ev.epoch_batch_mean(smp.batches(s.where(F.col("split") == p), "doc_id", I.BATCH_SIZE, epoch=0, seed=I.SEED))
             .select(F.lit(p).alias("split"), "n_batches", F.col("accuracy").alias("_batch"))
             for p in ("train", "val", "test")]
    # three rows each
    both = whole.join(parts[0].unionByName(parts[1]).unionByName(parts[2]), "split")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return both.select(
        "split", "n", (F.col("tp") + F.col("fn")).alias("positives"), "n_batches",
        F.when(F.col("split") == "train", F.round("mean_prob", 3)).alias("mean_prob"),
        F.when(F.col("split") == "train", F.col("beats_base")).alias("beats_base"), "pred_follows_logit",
        ((F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") == F.col("n")) & _near(F.col("f1"), f1)).alias("metrics_follow_cells"),
        _near(F.col("accuracy"), F.col("_batch")).alias("accuracy_is_batch_mean"))


@_register("ml_epoch_checks")
def ml_epoch_checks(spark, sf_dir):
    """Epoch training with its Parquet log. Per logged (split, metric): rows of the split, and whether every epoch
    was logged once, the early-stopping state follows from the losses, and what is logged for the best epoch
    is what the kept model, read back, scores (validation only)."""
    path = scratch_path(spark, "epoch_log")
    model, log, data, _ = _train(
        spark, sf_dir, lambda rec: files.append_metric_log(ml.epoch_log_frame(spark, "perceptron", [rec]), path))
    best = min(log, key=lambda r: r.val_loss).epoch
    logged = spark.read.parquet(path).groupBy("split", "metric").agg(
        F.sort_array(F.collect_list("epoch")).alias("_epochs"),  # one run's epochs
        F.max(F.when(F.col("epoch") == best, F.col("value"))).alias("_logged"))
    kept = (ml.score(model, data.where(F.col("split") == "val"), "doc_id", "label")
            .agg(F.avg(ev.bce_with_logits("label", "logit")).alias("loss"), *ev.confusion_aggs("label", "pred"))
            .select("loss", *ev.metric_columns()))
    scored = kept.unpivot([], kept.columns, "metric", "_scored").withColumn("split", F.lit("val"))
    sizes = data.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    every = F.col("_epochs") == F.sequence(F.lit(0), F.lit(len(log) - 1))
    return (logged.join(scored, ["split", "metric"], "left").join(sizes, "split")
            .select("split", "metric", "n", every.alias("every_epoch"), F.lit(rule_holds(log)).alias("rule_holds"),
                    _near(F.col("_logged"), F.col("_scored")).alias("logged_is_scored")))

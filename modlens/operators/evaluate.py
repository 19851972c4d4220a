"""Evaluation: confusion matrix, precision/recall/F1, agreement, BCE loss,
batch-averaged epoch metrics, confusion / disagreement cells, key alignment.

All metrics come from one aggregate pass (four conditional counts); 0/0 is 0.
Positive class is 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.functions.columns import softplus
from modlens.operators.sampling import per_class

METRICS = ("acc", "precision", "recall", "f1")
_METRIC_COLUMN = {"acc": "accuracy", "precision": "precision", "recall": "recall", "f1": "f1"}


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def confusion_aggs(label: str = "label", pred: str = "pred") -> list[Column]:
    """Aggregate expressions n, tp, fp, fn, tn (bigint)."""
    y, p = F.col(label), F.col(pred)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y != 1) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p != 1)).alias("fn"),
        F.count_if((y != 1) & (p != 1)).alias("tn"),
    ]


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred",
                     by: Sequence[str] = ()) -> DataFrame:
    """n, tp, fp, fn, tn (bigint) in one aggregate, optionally per group."""
    return df.groupBy(*by).agg(*confusion_aggs(label, pred))


def metric_columns(metrics: Sequence[str] = METRICS) -> list[Column]:
    """Metric columns over tp/fp/fn/tn/n columns. Unknown names are ignored."""
    tp, fp, fn, tn, n = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n"))
    out = []
    if "acc" in metrics:
        out.append(_ratio(tp + tn, n).alias("accuracy"))
    if "precision" in metrics:
        out.append(_ratio(tp, tp + fp).alias("precision"))
    if "recall" in metrics:
        out.append(_ratio(tp, tp + fn).alias("recall"))
    if "f1" in metrics:
        out.append(_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return out


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                   by: Sequence[str] = (), metrics: Sequence[str] = METRICS) -> DataFrame:
    """Confusion counts plus accuracy / precision / recall / F1 (0/0 -> 0)."""
    cm = confusion_counts(df, label, pred, by)
    return cm.select(*by, "n", "tp", "fp", "fn", "tn", *metric_columns(metrics))


def confusion_matrix_long(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Dense 2x2 matrix as (label, pred, n) rows; empty cells are 0."""
    cm = confusion_counts(df, label, pred)
    return cm.select(F.inline(F.array(
        F.struct(F.lit(0).alias("label"), F.lit(0).alias("pred"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("label"), F.lit(1).alias("pred"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("label"), F.lit(0).alias("pred"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("label"), F.lit(1).alias("pred"), F.col("tp").alias("n")),
    )))


def agreement(df: DataFrame, pred_a: str, pred_b: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows where two classifiers agree."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(pred_a) == F.col(pred_b)).cast("double")).alias("agreement"),
    )


def bce_with_logits(label: str | Column, logit: str | Column, pos_weight: float = 1.0) -> Column:
    """Per-row binary cross-entropy on a logit with a positive-class weight."""
    y = (F.col(label) if isinstance(label, str) else label).cast("double")
    z = F.col(logit) if isinstance(logit, str) else logit
    return F.lit(float(pos_weight)) * y * softplus(-z) + (F.lit(1.0) - y) * softplus(z)


def bce_loss(df: DataFrame, label: str = "label", logit: str = "z", pos_weight: float = 1.0,
             by: Sequence[str] = ()) -> DataFrame:
    """Mean BCE. The batch-size-weighted mean of batch means equals this global mean."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(bce_with_logits(label, logit, pos_weight)).alias("loss"),
    )


def epoch_batch_mean(df: DataFrame, batch_col: str = "batch_id", label: str = "label",
                     pred: str = "pred", metrics: Sequence[str] = METRICS) -> DataFrame:
    """Epoch metric as logged per batch: sum(batch metric * batch size) / sum(batch size).

    Accuracy equals the global value; precision, recall and F1 do not.
    Batches are few (rows / batch size), so the second aggregate is small.
    """
    per_batch = binary_metrics(df, label, pred, by=[batch_col], metrics=metrics)
    names = [_METRIC_COLUMN[m] for m in metrics if m in _METRIC_COLUMN]
    return per_batch.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n").alias("n"),
        *[(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(m) for m in names],
    )


def confusion_cell(label: str | Column, pred: str | Column) -> Column:
    """TN / FP / FN / TP name of a (label, pred) pair, in one derived column."""
    y = F.col(label) if isinstance(label, str) else label
    p = F.col(pred) if isinstance(pred, str) else pred
    return (F.when((y == 0) & (p == 0), "TN").when((y == 0) & (p == 1), "FP")
            .when((y == 1) & (p == 0), "FN").when((y == 1) & (p == 1), "TP"))


def with_confusion_cell(df: DataFrame, label: str = "label", pred: str = "pred",
                        cell_col: str = "cell") -> DataFrame:
    return df.withColumn(cell_col, confusion_cell(label, pred))


def disagreement_cell(label: str, pred_a: str, pred_b: str, name_a: str = "a",
                      name_b: str = "b") -> Column:
    """Where exactly one classifier is right: '<right>_<TN|TP>' (the right one's
    outcome); NULL when both are right or both wrong."""
    y, a, b = F.col(label), F.col(pred_a), F.col(pred_b)
    a_ok, b_ok = a == y, b == y
    return (F.when((y == 0) & a_ok & ~b_ok, f"TN_{name_a}")
            .when((y == 1) & a_ok & ~b_ok, f"TP_{name_a}")
            .when((y == 0) & ~a_ok & b_ok, f"TN_{name_b}")
            .when((y == 1) & ~a_ok & b_ok, f"TP_{name_b}"))


def disagreements(df: DataFrame, label: str, pred_a: str, pred_b: str, name_a: str = "a",
                  name_b: str = "b", cell_col: str = "cell") -> DataFrame:
    """Rows where one classifier is right and the other wrong, with their cell."""
    return (df.where(F.col(pred_a) != F.col(pred_b))
            .withColumn(cell_col, disagreement_cell(label, pred_a, pred_b, name_a, name_b))
            .where(F.col(cell_col).isNotNull()))


def align_predictions(labels: DataFrame, preds: DataFrame, key: str,
                      validate: bool = True) -> DataFrame:
    """Align labels and predictions on a key (never by position).

    With ``validate`` (the default) one aggregate job per side checks the key is unique and
    both sides have the same key count; a mismatch raises.
    """
    if validate:
        for name, side in (("labels", labels), ("preds", preds)):
            r = side.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d")).first()
            if r["n"] != r["d"]:
                raise ValueError(f"{name}: key {key!r} is not unique ({r['n']} rows, {r['d']} keys)")
        missing = (labels.select(key, F.lit(1).alias("_l"))
                   .join(preds.select(key, F.lit(1).alias("_p")), key, "full_outer")
                   .where(F.col("_l").isNull() | F.col("_p").isNull()).limit(1).count())
        if missing:
            raise ValueError("labels and predictions do not cover the same keys")
    return labels.join(preds, key, "inner")


def with_position(df: DataFrame, pos_col: str = "pos") -> DataFrame:
    """0-based position of each row of a Parquet table in file order: files by path, rows as they stand.

    ``df`` is a plain read, as positions come from the scan's metadata. Files are counted, their counts
    summed in path order (one row per file), and a row's place in its file is added: no row moves.
    """
    at = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = at.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (at.join(per_class(files), "_file")
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_row")).alias(pos_col)))


def align_by_position(left: DataFrame, right: DataFrame, pos_col: str = "pos") -> DataFrame:
    """Rows of two Parquet tables without a common key side by side, by position (``with_position``). Tables of
    different lengths raise, as a shifted pair of columns would go unnoticed; so do columns of one name."""
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"both tables have {sorted(both)}")
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows can't be aligned with {m}")
    return with_position(left, pos_col).join(with_position(right, pos_col), pos_col)

"""Dataset preparation: projections (P1-P16), split view (S8/F1) and the four
dataset cards (annotation cleaning X3, tweets X4, scored comments X5,
adversarial set X6). Each is DataFrame -> DataFrame; the output path of a
prepared table is an argument of the writer, never fixed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from modlens.functions.columns import (
    fill_cast,
    flag_eq,
    flag_gt,
    lower_columns,
    numeric_guard,
    sanitize_label,
    sanitize_numeric_label,
    split_words,
)
from modlens.operators.aggregate import (
    check_category_names,
    annotator_rollup,
    discover_categories,
    onehot_columns,
)
from modlens.operators.sampling import stratified_split


def split_view(df: DataFrame, split: str | None = None, columns: Sequence[str] = ("text", "label"),
               split_col: str = "split") -> DataFrame:
    """Optional split filter, then the listed columns (pushed into the scan;
    with a table partitioned by split it prunes partitions)."""
    out = df.where(F.col(split_col) == F.lit(split)) if split else df
    return out.select(*columns)


def rename_class_label(df: DataFrame, class_col: str = "class", text_from: str | None = None,
                       positive_class: int = 0) -> DataFrame:
    """``label = 1 if class == positive_class else 0`` (NULL -> 0); optional text rename."""
    out = df.withColumnRenamed(text_from, "text") if text_from else df
    return out.withColumn("label", flag_eq(F.col(class_col), positive_class))


def replace_values(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    """Exact value replacement in one column."""
    return df.replace(dict(mapping), subset=[col])


def lowercase_columns(df: DataFrame) -> DataFrame:
    """Lower-case column names; a collision raises instead of silently merging."""
    return df.toDF(*lower_columns(df.columns))


def sanitize_label_column(df: DataFrame, col: str = "label", strict: bool = False) -> DataFrame:
    """Label kept if 0 or 1, else 0. A string column is parsed first by default;
    ``strict`` keeps only typed numbers (every string -> 0)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, NumericType):
        c = sanitize_numeric_label(F.col(col))
    elif strict:
        c = F.lit(0)
    else:
        c = sanitize_label(F.col(col))
    return df.withColumn(col, c.cast("int"))


def clean_annotations(df: DataFrame, key: str, categories: Sequence[str] | None = None,
                      strict_label: bool = False) -> DataFrame:
    """Annotation export -> clean table.

    label sanitised; categories lower-cased, split on whitespace, NULL -> [];
    one int column per category (count in the row, 0 when absent, every row
    kept); ``categories`` dropped; column names lower-cased; toxicity parsed as
    a number with NaN / text / NULL -> 0.
    """
    cols = {c.lower(): c for c in df.columns}
    label_c, cat_c, tox_c = cols["label"], cols["categories"], cols["toxicity"]
    d = sanitize_label_column(df, label_c, strict=strict_label)
    d = d.withColumn("_cats", split_words(F.col(cat_c), lower=True))
    base_cols = [c for c in d.columns if c not in (cat_c, "_cats")]
    cats = list(categories) if categories is not None else discover_categories(d, "_cats")
    check_category_names(cats, base_cols)
    # one list per row: the one-hot is a per-row count (every row kept, 0 when absent)
    wide = d.select(*[F.col(f"`{c}`") for c in base_cols], *onehot_columns("_cats", cats))
    out = lowercase_columns(wide)
    return out.withColumn(tox_c.lower(), numeric_guard(F.col(tox_c.lower())))


def prepare_tweets(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Tweets card: ``tweet`` -> ``text``, ``label = class == 0``, and the split the
    evaluation expects (stratified 80/10/10)."""
    out = rename_class_label(df, "class", text_from="tweet" if "tweet" in df.columns else None)
    return stratified_split(out, key, "label", seed=seed)


def prepare_scored_comments(df: DataFrame, key: str, order_col: str, score_col: str,
                            threshold: float = 0.5, seed: int = 42) -> DataFrame:
    """Scored-comments card: many annotator rows per item -> one row per item
    (numeric mean, first text), label = mean score > threshold (strict, NaN -> 0),
    stratified 80/10/10 split by label."""
    rolled = annotator_rollup(df, key, order_col)
    labeled = rolled.withColumn("label", flag_gt(F.col(score_col), threshold))
    return stratified_split(labeled, key, "label", seed=seed, keep_keys=True)


def prepare_adversarial(df: DataFrame, columns: Sequence[str] = ("acl.id", "text", "label", "type",
                                                                 "level", "split"),
                        positive: str = "hate") -> DataFrame:
    """Adversarial card: keep columns, ``label = label == positive``, split 'dev' -> 'val'."""
    out = df.select(*[F.col(f"`{c}`") for c in columns])
    out = out.withColumn("label", flag_eq(F.col("label"), positive))
    return replace_values(out, "split", {"dev": "val"})


__all__ = [
    "clean_annotations", "fill_cast", "lowercase_columns", "prepare_adversarial",
    "prepare_scored_comments", "prepare_tweets", "rename_class_label", "replace_values",
    "sanitize_label_column", "split_view",
]

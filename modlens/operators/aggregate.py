"""Aggregations: profiles, value counts, shares, annotator roll-up, multi-label
one-hot, category frequency, histogram and density of a score.

Everything is a partial-then-final aggregate; the driver only ever receives a
few scalars (min / max / stddev, a bounded category list).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from modlens.functions.columns import split_words

#: A discovered category becomes a column: more than this many want the long form, or ``categories=``.
MAX_DISCOVERED = 1000


def profile_counts(df: DataFrame, id_col: str, approx: bool = False) -> DataFrame:
    """Row count and distinct-id count, NULL counted as one value.

    Strings are counted by their 128-bit digest, so texts don't cross the shuffle;
    ``approx`` counts with a HyperLogLog sketch instead (no distinct shuffle at all).
    """
    c = F.col(id_col)
    if isinstance(df.schema[id_col].dataType, StringType):
        c = F.unhex(F.md5(c.cast("binary")))
    distinct = F.approx_count_distinct(c) if approx else F.count_distinct(c)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (distinct + F.coalesce(F.max(F.col(id_col).isNull().cast("int")), F.lit(0))).cast("bigint").alias("n_distinct"),
    )


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    """Counts per value, NULL excluded, ordered by count desc then value."""
    out = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        out = out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return out.orderBy(F.col("n").desc(), F.col(col))


def class_share(df: DataFrame, label: str = "label", by: str = "split",
                overall: str = "all") -> DataFrame:
    """Normalised value counts per group and overall (grouping sets).

    The share window runs on the aggregated rows (groups x classes), never on rows.
    """
    # grouping sets ((by, label), (label)): one scan, one aggregate
    agg = (df.where(F.col(label).isNotNull())
           .groupingSets([(F.col(by), F.col(label)), (F.col(label),)], by, label)
           .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")))
    both = agg.select(
        F.when(F.col("_g") == 2, F.lit(overall)).otherwise(F.col(by).cast("string")).alias(by),
        label, "n")
    return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def annotator_rollup(df: DataFrame, key: str, order_col: str,
                     columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: numeric columns averaged (NaN and NULL skipped), other
    columns take their first non-NULL value by ``order_col``. NULL keys dropped.

    The aggregate list is built from the schema, so the plan is one
    partial/final hash aggregate on the key.
    """
    cols = [c for c in (columns or df.columns) if c not in (key, order_col)]
    aggs = []
    for f in df.schema.fields:
        if f.name not in cols:
            continue
        c = F.col(f.name)
        if isinstance(f.dataType, NumericType):
            aggs.append(F.avg(F.when(~F.isnan(c), c)).alias(f.name))
        else:
            aggs.append(F.min_by(c, F.when(c.isNotNull(), F.col(order_col))).alias(f.name))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def multilabel_long(df: DataFrame, key: str, list_col: str, value_col: str = "category") -> DataFrame:
    """(key, value, n): how often each value appears in a row's list (repeats count)."""
    return (df.select(key, F.explode(F.col(list_col)).alias(value_col))
            .groupBy(key, value_col).agg(F.count(F.lit(1)).alias("n")))


def discover_categories(df: DataFrame, list_col: str, limit: int = MAX_DISCOVERED) -> list[str]:
    """Distinct list values (one job), for a wide table whose categories the caller doesn't know.
    Above ``limit`` it raises and never truncates: ``multilabel_long`` has no bound, and a given
    ``categories`` list isn't checked against it."""
    rows = (df.select(F.explode(F.col(list_col)).alias("v")).distinct()
            .limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"more than {limit} distinct categories in {list_col!r}")
    return sorted(r["v"] for r in rows if r["v"] is not None)


def onehot_columns(list_col: str, categories: Sequence[str], binary: bool = False) -> list:
    """One int column per category: how often it appears in the row's list."""
    def equals(value):
        return lambda x: x == F.lit(value)

    cols = []
    for c in categories:
        n = F.size(F.filter(F.col(list_col), equals(c)))
        if binary:
            n = F.least(n, F.lit(1))
        cols.append(n.cast("int").alias(c))
    return cols


def check_category_names(cats: Sequence[str], reserved: Sequence[str]) -> None:
    clash = {c.lower() for c in cats} & {r.lower() for r in reserved}
    if clash:
        raise ValueError(f"category names collide with columns: {sorted(clash)}")


def multilabel_onehot(df: DataFrame, key: str, list_col: str, categories: Sequence[str] | None = None,
                      binary: bool = False, reserved: Sequence[str] = (),
                      unique_key: bool = True) -> DataFrame:
    """Wide one-hot: one int column per category, value = count in the row (or
    0/1 with ``binary``). Only keys with at least one listed category appear;
    ``join_categories`` / ``onehot_columns`` give every row. A category named
    like a reserved (base) column raises.

    With a unique key (one list per row) the counts are per-row array
    expressions: map-only, no explode, no shuffle. Otherwise lists of the same
    key are summed: explode, then a pivot with the explicit category list.
    """
    cats = list(categories) if categories is not None else discover_categories(df, list_col)
    check_category_names(cats, reserved)
    if unique_key:
        listed = F.filter(F.col(list_col), lambda x: x.isin(cats)) if cats else F.array()
        return df.where(F.size(listed) > 0).select(key, *onehot_columns(list_col, cats, binary))
    long = multilabel_long(df, key, list_col, "_cat").where(F.col("_cat").isin(cats))
    wide = long.groupBy(key).pivot("_cat", cats).agg(F.sum("n"))
    vals = [F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in cats]
    if binary:
        vals = [F.least(v, F.lit(1)) for v in vals]
    return wide.select(key, *[v.cast("int").alias(c) for v, c in zip(vals, cats)])


def join_categories(base: DataFrame, onehot: DataFrame, key: str) -> DataFrame:
    """Left join one-hot counts back to every base row; unmatched -> 0
    (for lists held by several rows of a key; a per-row list needs no join)."""
    cats = [c for c in onehot.columns if c != key]
    out = base.join(onehot, key, "left")
    return out.select(*[F.col(f"`{c}`") for c in base.columns],
                      *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("int").alias(c) for c in cats])


def category_counts(df: DataFrame, col: str, lower: bool = False, null_as: str | None = None,
                    value_col: str = "category") -> DataFrame:
    """Frequency of whitespace-separated categories over all rows.

    ``null_as='nan'`` counts a missing value as that category (as stringifying
    a missing value does); the default drops it. No lower-casing by default.
    """
    c = F.col(col).cast("string")
    if null_as is not None:
        c = F.coalesce(c, F.lit(null_as))
    return (df.select(F.explode(split_words(c, lower=lower)).alias(value_col))
            .groupBy(value_col).agg(F.count(F.lit(1)).alias("n")))


def _score_stats(df: DataFrame, col: str) -> tuple[int, float | None, float | None, float | None]:
    x = F.col(col)
    r = (df.where(x.isNotNull() & ~F.isnan(x))
         .agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"),
              F.stddev_samp(x).alias("sd")).first())
    return r["n"], r["lo"], r["hi"], r["sd"]


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max]; the max falls in the last bin.
    NaN and NULL are dropped; if min = max the range is [x - 0.5, x + 0.5].
    Returns (bin, lo, hi, n) for every bin, empty bins included."""
    spark = df.sparkSession
    n, lo, hi, _ = _score_stats(df, col)
    if n == 0:
        return spark.range(bins).select(F.col("id").cast("int").alias("bin"),
                                        F.lit(None).cast("double").alias("lo"),
                                        F.lit(None).cast("double").alias("hi"),
                                        F.lit(0).cast("bigint").alias("n"))
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    x = F.col(col)
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = (df.where(x.isNotNull() & ~F.isnan(x)).select(b.alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def kde_grid(df: DataFrame, col: str, grid_points: int = 50, fine_bins: int = 2000,
             cut: float = 0.0) -> DataFrame:
    """Gaussian kernel density on a grid, Scott bandwidth sd * n^(-1/5).

    Binned form: values are first counted into ``fine_bins`` equal bins (a
    partial aggregate; at most ``fine_bins`` rows survive), then each bin
    centre contributes to all grid points through an array ``transform``.
    The error versus the exact sum is bounded by half a fine-bin width in x.
    Grid spans [min - cut*bw, max + cut*bw]. Returns (grid, x, density).
    """
    n, lo, hi, sd = _score_stats(df, col)
    spark = df.sparkSession
    if n < 2 or not sd:
        return spark.createDataFrame([], "grid int, x double, density double")
    bw = sd * n ** (-0.2)
    g_lo, g_hi = lo - cut * bw, hi + cut * bw
    step = (g_hi - g_lo) / (grid_points - 1)
    width = (hi - lo) / fine_bins
    x = F.col(col)
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(fine_bins - 1))
    binned = (df.where(x.isNotNull() & ~F.isnan(x)).select(b.alias("b"))
              .groupBy("b").agg(F.count(F.lit(1)).alias("m"))
              .select((F.lit(lo) + (F.col("b") + F.lit(0.5)) * F.lit(width)).alias("c"), "m"))
    grid = F.array(*[F.lit(g_lo + i * step) for i in range(grid_points)])
    norm = 1.0 / (n * bw * math.sqrt(2.0 * math.pi))
    contrib = F.transform(grid, lambda g: F.col("m") * F.exp(
        F.lit(-0.5) * F.pow((g - F.col("c")) / F.lit(bw), F.lit(2.0))))
    return (binned.select(F.posexplode(contrib).alias("grid", "v"))
            .groupBy("grid").agg((F.sum("v") * F.lit(norm)).alias("density"))
            .select(F.col("grid").cast("int").alias("grid"),
                    (F.lit(g_lo) + F.col("grid") * F.lit(step)).alias("x"), "density"))


def kde_exact(df: DataFrame, col: str, grid_points: int = 50) -> DataFrame:
    """Gaussian kernel density on the same grid as ``kde_grid``, summed over every value: one pass with
    one partial sum per grid point, nothing but those sums shuffled. Returns (grid, x, density)."""
    n, lo, hi, sd = _score_stats(df, col)
    spark = df.sparkSession
    if n < 2 or not sd:
        return spark.createDataFrame([], "grid int, x double, density double")
    bw = sd * n ** (-0.2)
    step = (hi - lo) / (grid_points - 1)
    x = F.col(col)
    points = [lo + i * step for i in range(grid_points)]
    sums = df.where(x.isNotNull() & ~F.isnan(x)).agg(*[
        F.sum(F.exp(F.lit(-0.5) * F.pow((F.lit(g) - x) / F.lit(bw), F.lit(2.0)))).alias(f"g{i}")
        for i, g in enumerate(points)])
    norm = 1.0 / (n * bw * math.sqrt(2.0 * math.pi))
    rows = F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(g).alias("x"), (F.col(f"g{i}") * F.lit(norm)).alias("density"))
                     for i, g in enumerate(points)])
    return sums.select(F.inline(rows))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value, n) for several small categorical columns: the long form of
    ``dict(zip(*np.unique(x, return_counts=True)))`` per column.

    One scan: each row yields one (variable, value) pair per column through a
    generator, and a single partial/final aggregate counts them.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("bigint").alias("value"))
                      for c in columns])
    return (df.select(F.inline(pairs)).groupBy("variable", "value")
            .agg(F.count(F.lit(1)).alias("n")))


#: log2 of a distinct-count sketch's registers: about 0.8 % standard error.
SKETCH_BITS = 14
#: Five standard errors: what a merged estimate stays within of the exact number.
SKETCH_BOUND = 0.041


def write_profile_sketches(df: DataFrame, path: str, column: str, by: Sequence[str], bits: int = SKETCH_BITS) -> None:
    """Append one row per group: row count, NULL count and a distinct-count sketch of ``column`` (at most
    2^bits bytes). A later load appends its own rows; nothing stored is read again."""
    c = F.col(f"`{column}`")
    (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(c.isNull()).alias("n_null"),
                         F.hll_sketch_agg(c, bits).alias("sketch"))
     .write.mode("append").parquet(path))


def merge_profile_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(groups, n, n_null, distinct_estimate) over any coarser grouping of stored sketch rows. Counts are exact; NULL
    is not among the distinct values. The rows that are merged are groups, never the data."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_estimate"))

"""Deterministic, partition-independent sampling.

Every random choice is keyed: ``u = md5(key:seed)`` (or ``md5(seed:epoch:key)``
for reshuffles). The same rows come out whatever the partitioning, and plain
SQL reproduces them.

Exact ranks over huge groups (two labels -> two groups) are never computed
with one window partition per group. ``bucketed_rank`` splits each group into
16^d md5 buckets, counts rows per bucket (a small aggregate), turns counts into
offsets, and ranks inside each (group, bucket) only. A group holding a third
of all rows is still spread over 16^d tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.functions.columns import md5_hex, md5_uniform
from modlens.session import checkpoint_root

DEFAULT_SEED = 42
#: Per-class tables of up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_CLASSES = 10_000
MIN_DIGITS, MAX_DIGITS = 3, 8
UNKNOWN_SIZE_DIGITS = 5   # 2^20 buckets: about 1M rows each at 10^12 rows
COARSE_DIGITS = 2


def bucket_digits(n_rows: int | None, rows_per_bucket: int = 1 << 20) -> int:
    """Hex digits of the md5 bucket so that a bucket holds about ``rows_per_bucket``
    rows: 3 (4096 buckets) up to ~4 billion rows, one more per 16x beyond.
    Unknown size: 5 digits (2^20 buckets)."""
    if n_rows is None:
        return UNKNOWN_SIZE_DIGITS
    need = math.ceil(math.log(max(n_rows / rows_per_bucket, 1), 16))
    return max(MIN_DIGITS, min(MAX_DIGITS, need))


def _bucket_offsets(counts: DataFrame, g: list[str], digits: int) -> DataFrame:
    """(group, _b, _off): rows in earlier buckets of the same group.

    Prefix sums in two levels so no window holds more than 16^(digits-2)
    count rows: coarse buckets (first two hex digits, at most 256 per group)
    get offsets in one small window per group; fine buckets get offsets inside
    their coarse bucket, one window partition per (group, coarse bucket).
    """
    before = Window.unboundedPreceding, -1
    if digits <= MIN_DIGITS:
        w = Window.partitionBy(*g).orderBy("_b").rowsBetween(*before)
        return counts.select(*g, "_b", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    fine = counts.withColumn("_c", F.substring("_b", 1, COARSE_DIGITS))
    coarse = fine.groupBy(*g, "_c").agg(F.sum("_n").alias("_cn"))
    w_c = Window.partitionBy(*g).orderBy("_c").rowsBetween(*before)
    coarse_off = coarse.select(*g, "_c", F.coalesce(F.sum("_cn").over(w_c), F.lit(0)).alias("_coff"))
    w_f = Window.partitionBy(*g, "_c").orderBy("_b").rowsBetween(*before)
    fine_off = fine.select(*g, "_c", "_b", F.coalesce(F.sum("_n").over(w_f), F.lit(0)).alias("_foff"))
    return (fine_off.join(coarse_off, [*g, "_c"], "inner")
            .select(*g, "_b", (F.col("_coff") + F.col("_foff")).alias("_off")))


def bucketed_rank(df: DataFrame, order_hash: Column, key: str, group_cols: Sequence[str] = (),
                  rank_col: str = "rank", digits: int = MIN_DIGITS) -> DataFrame:
    """1-based rank inside ``group_cols`` by (order_hash, key), exact and skew-free.

    Equals ``row_number() over (partition by group order by order_hash, key)``.
    """
    g = list(group_cols)
    h = df.withColumn("_h", order_hash).withColumn("_b", F.substring("_h", 1, digits))
    counts = h.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _bucket_offsets(counts, g, digits)
    w = Window.partitionBy(*g, "_b").orderBy("_h", key)
    return (h.join(offsets, [*g, "_b"], "inner")
            .withColumn(rank_col, (F.col("_off") + F.row_number().over(w)).cast("bigint"))
            .select(*[F.col(f"`{c}`") for c in df.columns], rank_col))


def sorted_rank(df: DataFrame, order_cols: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """1-based global rank by a total order of arbitrary (skewed) keys.

    Range-partitioned sort, then partition offset + position inside the
    partition (the DataFrame form of zipWithIndex). The sorted frame is cut
    with a reliable ``checkpoint()`` so the offsets and the positions come
    from the same materialised partitions, also after an executor loss.
    Offsets are one number per partition, so the driver holds only those.
    """
    ordered = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    ordered = ordered.checkpoint(eager=True)
    pid = F.shiftright(F.col("_mid"), 33)
    sizes = {r["p"]: r["c"] for r in
             ordered.groupBy(pid.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    # partition ids are 0..P-1, so the offsets are an array indexed by id (O(1) per row)
    offsets, acc = [], 0
    for p in range(max(sizes) + 1 if sizes else 0):
        offsets.append(acc)
        acc += sizes.get(p, 0)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    off = (F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets]), (pid + 1).cast("int"))
           if offsets else F.lit(0))
    return ordered.withColumn(rank_col, (off + local + 1).cast("bigint")).drop("_mid")


def split_quotas(counts: DataFrame, label: str, test_size: float = 0.2, test_share: float = 0.5) -> DataFrame:
    """(label, n, held, test) for a two-step stratified split, from (label, n).

    Held-out total is ceil(test_size * N), the test part ceil(test_share * held-out), both shared by
    largest remainder (ties: smaller label). The windows run over one row per class.
    """
    num, den = _as_fraction(test_size)
    tnum, tden = _as_fraction(test_share)

    def share(df: DataFrame, of: str, total: Column, out: str) -> DataFrame:
        everything = Window.partitionBy()
        whole = df.withColumn("_s", F.sum(of).over(everything)).withColumn("_t", total)
        base = whole.withColumn("_b", F.when(F.col("_s") > 0, F.expr(f"({of} * _t) div _s")).otherwise(0))
        rem = base.withColumn("_r", F.when(F.col("_s") > 0, F.expr(f"({of} * _t) % _s")).otherwise(0))
        nth = F.row_number().over(Window.orderBy(F.desc("_r"), F.col(label)))
        left = F.col("_t") - F.sum("_b").over(everything)
        return (rem.withColumn(out, (F.col("_b") + F.when(nth <= left, 1).otherwise(0)).cast("bigint"))
                .drop("_s", "_t", "_b", "_r"))

    up = lambda a, b: F.floor((F.col("_s") * F.lit(a) + F.lit(b - 1)) / F.lit(b)).cast("bigint")
    return share(share(counts, "n", up(num, den), "held"), "held", up(tnum, tden), "test")


def _as_fraction(x: float) -> tuple[int, int]:
    from fractions import Fraction
    f = Fraction(x).limit_denominator(10_000)
    return f.numerator, f.denominator


def per_class(table: DataFrame) -> DataFrame:
    """A table with one row per class, broadcast behind a check of its size; a larger one is joined
    by shuffle. Only the plan differs."""
    few = len(table.limit(BROADCAST_CLASSES + 1).select(F.lit(1)).collect()) <= BROADCAST_CLASSES
    return F.broadcast(table) if few else table


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n), computed once: cut by a checkpoint, as several plans read it."""
    checkpoint_root(df.sparkSession)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    if not counts.where(F.col(label).isNull()).isEmpty():
        raise ValueError(f"NULL {label!r} has no class")
    return counts


def stratified_split(df: DataFrame, key: str, label: str = "label", seed: int = DEFAULT_SEED,
                     test_size: float = 0.2, test_share: float = 0.5,
                     split_col: str = "split", digits: int | None = None, on: DataFrame | None = None,
                     keep_keys: bool = False) -> DataFrame:
    """Exact stratified train/val/test split (80/10/10 by default), disjoint and complete.

    Within each label, rows are ranked by md5(key:seed); the first n-h go to train, the next h-t to
    val, the last t to test, with integer quotas. ``key`` is unique.

    Rows are never ranked or moved for it. A label needs two cut points, the (hash, key) at ranks
    n-h and n-t: rows are counted per (label, hash bucket), and only the key and hash of the two
    buckets that hold a cut are ranked. The split itself is a comparison with the label's cuts.

    So keys and labels are read twice before the result reads ``df``. ``on`` is a cheaper frame with the
    same keys and labels to read them from (``df`` may be a join with texts); ``keep_keys`` writes them to
    the checkpoint folder first, for a ``df`` that is costly to evaluate.
    """
    h = md5_hex(F.col(key), seed)
    checkpoint_root(df.sparkSession)
    narrow = (df if on is None else on).select(F.col(label), F.col(key).alias("_k"), h.alias("_h"))
    if keep_keys:
        narrow = narrow.checkpoint()
    # Read 1: counts per hash bucket, from which class counts, quotas and offsets follow.
    fine = F.substring("_h", 1, digits or UNKNOWN_SIZE_DIGITS)
    sums = narrow.groupBy(label, fine.alias("_b")).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    total, no_class = sums.agg(F.sum("_n"), F.count_if(F.col(label).isNull())).first()
    if no_class:
        raise ValueError(f"NULL {label!r} has no class")
    d = digits or min(bucket_digits(total), UNKNOWN_SIZE_DIGITS)
    bucket = F.substring("_h", 1, d)
    sums = sums.groupBy(label, F.substring("_b", 1, d).alias("_b")).agg(F.sum("_n").alias("_n"))
    quotas = split_quotas(sums.groupBy(label).agg(F.sum("_n").alias("n")), label, test_size, test_share)
    ranks = quotas.select(F.col(label), F.explode(F.array(
        F.struct(F.lit("train").alias("cut"), (F.col("n") - F.col("held")).alias("at")),
        F.struct(F.lit("val").alias("cut"), (F.col("n") - F.col("test")).alias("at")))).alias("c")).select(label, "c.*")
    offsets = sums.join(_bucket_offsets(sums, [label], d), [label, "_b"])
    edges = (offsets.join(ranks, label)
             .where((F.col("_off") < F.col("at")) & (F.col("at") <= F.col("_off") + F.col("_n")))
             .select(label, "_b", "cut", (F.col("at") - F.col("_off")).alias("nth")).checkpoint())
    # Read 2: the rows of the buckets that hold a cut.
    order = Window.partitionBy(label, "_b", "cut").orderBy("_h", "_k")
    found = (narrow.withColumn("_b", bucket).join(per_class(edges), [label, "_b"])
             .withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == F.col("nth")))
    cuts = found.groupBy(label).agg(*[
        F.max(F.when(F.col("cut") == c, F.struct("_h", "_k"))).alias(f"_{c}") for c in ("train", "val")]).checkpoint()
    own = F.struct(h.alias("_h"), F.col(key).alias("_k"))
    part = (F.when(own <= F.col("_train"), "train").when(own <= F.col("_val"), "val").otherwise("test"))
    return (df.join(per_class(cuts), label, "left")
            .select(*[F.col(f"`{c}`") for c in df.columns], part.alias(split_col)))


def sample_per_group(df: DataFrame, group_cols: Sequence[str], n: int, key: str,
                     seed: int = DEFAULT_SEED, rank_col: str | None = None) -> DataFrame:
    """Up to ``n`` rows per group, the smallest md5(key:seed) first (fewer if the
    group is smaller). Catalyst plans a partial group limit before the shuffle,
    so each task sends at most n rows per group."""
    w = Window.partitionBy(*group_cols).orderBy(md5_hex(F.col(key), seed), F.col(key))
    rc = rank_col or "_rn"
    out = df.withColumn(rc, F.row_number().over(w)).where(F.col(rc) <= n)
    return out if rank_col else out.drop(rc)


def renumber(sample: DataFrame, order_cols: Sequence[Column], id_col: str = "row_id") -> DataFrame:
    """0..n-1 over an already bounded sample (reset_index). Only for small frames."""
    w = Window.orderBy(*order_cols)
    return sample.withColumn(id_col, (F.row_number().over(w) - 1).cast("bigint"))


def class_weights(df: DataFrame, label: str = "label", weight_col: str = "weight") -> DataFrame:
    """Per-row weight 1 / (rows of its class), after the row's own columns."""
    w = _class_counts(df, label).select(label, (F.lit(1.0) / F.col("n")).alias(weight_col))
    return df.join(per_class(w), label).select(*[F.col(f"`{c}`") for c in df.columns], weight_col)


#: A draw's rate is at most RATE_STEP, so terms beyond this are below 1e-30.
POISSON_TERMS = 64


def poisson_cdf(rate: Column) -> Column:
    """Array of CDF(0..POISSON_TERMS-1) of Poisson(rate), terms summed in order."""
    logs = [0.0]
    for j in range(1, POISSON_TERMS):
        logs.append(logs[-1] + math.log(j))
    terms = F.transform(F.array(*[F.lit(x) for x in logs]),
                        lambda lf, j: F.exp(-rate + j * F.log(rate) - lf))
    return F.transform(F.sequence(F.lit(1), F.lit(POISSON_TERMS)), lambda j: F.aggregate(
        F.slice(terms, F.lit(1), j), F.lit(0.0), lambda s, x: s + x))


#: A draw at a higher rate is the sum of independent draws at equal rates of at most this.
RATE_STEP = 8
COPY_CHUNK = 1 << 12


def balanced_resample(df: DataFrame, key: str, label: str = "label", n_draws: int | None = None,
                      seed: int = DEFAULT_SEED, copy_col: str = "copy",
                      copy_chunk: int = COPY_CHUNK) -> DataFrame:
    """Class-balanced resample with replacement (weight 1/class count, N draws).

    Each row is repeated k ~ Poisson(N / (K * n_c)) times; the total is N in expectation. One rule
    for every rate: a rate r is m = ceil(r / 8) independent Poisson(r / m) draws, each by inverse CDF
    from md5(key:seed) (draw 0) or md5(key:seed:draw). A row of a very rare class owes many draws;
    they are dealt out in chunks of ``copy_chunk`` draws, so no task makes one row's copies alone.
    ``copy`` (bigint) numbers a row's copies by draw: draw * 2^16 + 1, 2, ...
    """
    counts = _class_counts(df, label)
    n, k_classes = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n = n_draws if n_draws is not None else (n or 0)
    rate = F.lit(float(n)) / (F.lit(float(k_classes or 1)) * F.col("n"))
    classes = (counts.withColumn("_draws", F.greatest(F.lit(1), F.ceil(rate / RATE_STEP)).cast("bigint"))
               .select(label, "_draws", poisson_cdf(rate / F.col("_draws")).alias("_cdf")).checkpoint())
    chunks = F.floor((F.col("_draws") - 1) / F.lit(copy_chunk)).cast("bigint")
    heavy = classes.where(F.col("_draws") > copy_chunk)
    dealt = df.join(per_class(classes), label).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks)))
    if not heavy.isEmpty():
        dealt = dealt.repartition(key, "_c")
    first = F.col("_c") * copy_chunk
    draw = F.explode(F.sequence(first, F.least(first + (copy_chunk - 1), F.col("_draws") - 1)))
    u = F.when(F.col("_d") == 0, md5_uniform(F.col(key), seed)).otherwise(md5_uniform(F.col(key), seed, F.col("_d")))
    drawn = (dealt.withColumn("_d", draw).withColumn("_u", u)
             .withColumn("_k", F.expr("cast(size(filter(_cdf, p -> p <= _u)) as bigint)")).where("_k > 0"))
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_k")))
    return (drawn.withColumn("_n", copy)
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_d") * (1 << 16) + F.col("_n")).alias(copy_col)))


def exact_resample(df: DataFrame, key: str, label: str = "label", n_draws: int | None = None,
                   seed: int = DEFAULT_SEED, copy_col: str = "copy", digits: int | None = None) -> DataFrame:
    """Class-balanced resample with replacement of exactly ``n_draws`` rows (all rows' number by default).

    Draw d = 0, 1, ... takes the class at floor(K u) of the K labels in order, u = md5(seed:d:class), and in it
    the row of rank floor(n_c v), v = md5(seed:d:row), by md5(key:seed): weight 1 / class count, as
    independent draws. ``key`` is unique; ``copy`` numbers a row's draws from 1. No rows or no draws
    give none; a NULL label raises.

    Draws are a range, dealt over the cluster and counted per (class, rank). Rows are ranked without
    their other columns, inside md5 buckets (``bucketed_rank``). Both meet on (class, rank), where a key is
    one row, so a class that holds most rows, or a class of one row that owes N / K draws, is no hot
    key; the drawn rows then meet ``df`` on its key. ``balanced_resample`` moves no rows, but draws N in
    expectation only.
    """
    counts = _class_counts(df, label)
    n, k_classes = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = (n or 0) if n_draws is None else n_draws
    numbered = counts.select(label, "n", (F.row_number().over(Window.orderBy(label)) - 1).cast("bigint").alias("_c"))
    pick = lambda what, many: F.least(
        F.floor(md5_uniform(F.lit(seed), F.col("id"), F.lit(what)) * many).cast("bigint"), many - 1)
    spark = df.sparkSession
    parts = max(1, min(total >> 16, 1 << 17), spark.sparkContext.defaultParallelism if total > 1 << 12 else 1)
    draws = (spark.range(0, total if n else 0, 1, parts)
             .withColumn("_c", pick("class", F.lit(k_classes or 1).cast("bigint")))
             .join(per_class(numbered), "_c").withColumn("_rank", pick("row", F.col("n")) + 1)
             .groupBy(label, "_rank").agg(F.count(F.lit(1)).alias("_k")))
    narrow = df.select(label, F.col(key).alias("_key"))
    ranked = bucketed_rank(narrow, md5_hex(F.col("_key"), seed), "_key", (label,), "_rank", digits or bucket_digits(n))
    drawn = ranked.join(draws, [label, "_rank"]).select("_key", "_k")
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_k")))
    return (df.join(drawn, F.col(key) == F.col("_key"))
            .select(*[F.col(f"`{c}`") for c in df.columns], copies.alias(copy_col)))


def write_epoch_shards(df: DataFrame, key: str, path: str, batch_size: int, epoch: int = 0, seed: int = DEFAULT_SEED,
                       batches_per_shard: int = 1 << 10, digits: int | None = None, n_rows: int | None = None) -> DataFrame:
    """An epoch's batches as Parquet files in training order, and their manifest.

    Rows get their batch and place (``batches``), are partitioned by shard (``batches_per_shard``
    consecutive batches) and sorted inside it, so each shard is a folder ``shard=i`` of one file whose rows
    stand in order: a reader streams the batches of any shard without a sort, and workers take shards
    of their own. The manifest (shard, first_batch, last_batch, n_rows, first_pos, last_pos), one row a shard, is
    written beside them, last, so a folder with a manifest is complete. An empty table writes an empty
    manifest.
    """
    numbered = batches(df, key, batch_size, epoch, seed, digits=digits, n_rows=n_rows)
    shard = F.floor(F.col("batch_id") / F.lit(batches_per_shard)).cast("bigint")
    (numbered.withColumn("shard", shard).repartition("shard").sortWithinPartitions("shard", "pos")
     .write.mode("overwrite").partitionBy("shard").parquet(f"{path}/shards"))
    spark = df.sparkSession
    schema = numbered.withColumn("shard", shard).schema
    manifest = (spark.read.schema(schema).parquet(f"{path}/shards").groupBy("shard")
                .agg(F.min("batch_id").alias("first_batch"), F.max("batch_id").alias("last_batch"),
                     F.count(F.lit(1)).alias("n_rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def read_epoch_shards(spark, path: str, schema, first_shard: int = 0, last_shard: int | None = None) -> DataFrame:
    """Rows of a range of shards (pruned by folder) as they stand in the files; ``_file_pos`` is a row's place
    in its file. ``schema`` is that of the rows written."""
    whole = spark.read.schema(schema).parquet(f"{path}/shards")
    some = F.col("shard") >= first_shard
    if last_shard is not None:
        some = some & (F.col("shard") <= last_shard)
    return whole.where(some).withColumn("_file_pos", F.col("_metadata.row_index"))


def shuffle_order(df: DataFrame, key: str, epoch: int = 0, seed: int = DEFAULT_SEED,
                  pos_col: str = "pos", digits: int | None = None,
                  n_rows: int | None = None) -> DataFrame:
    """Reshuffle for an epoch: 1-based position by md5(seed:epoch:key), exact and
    partition-independent (bucketed rank; no single-partition sort). Buckets
    are sized from ``n_rows`` when the caller knows it, else 2^20 buckets."""
    d = digits or bucket_digits(n_rows)
    return bucketed_rank(df, md5_hex(seed, epoch, F.col(key)), key, (), pos_col, d)


def batches(df: DataFrame, key: str, batch_size: int, epoch: int = 0, seed: int = DEFAULT_SEED,
            batch_col: str = "batch_id", pos_col: str = "pos", digits: int | None = None,
            n_rows: int | None = None) -> DataFrame:
    """Fixed-size batches in shuffled order; the last batch may be short."""
    ordered = shuffle_order(df, key, epoch, seed, pos_col, digits, n_rows)
    return ordered.withColumn(batch_col, F.floor((F.col(pos_col) - 1) / F.lit(batch_size)).cast("bigint"))

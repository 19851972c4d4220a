"""Mixing sources to target weights by Pareto order sampling (DataFrame operations only).

Targets. Sources share ``share`` times all words by weight; a source takes at most
``max_copies`` times its own words, and what it can't take goes to the others by weight. With
sources ordered by cap over weight, the water level is the largest of
``(total - caps before) / (weights from here on)``, so no iteration is needed.

Sampling. A source with ratio r = target / size takes floor(r) whole copies of every document
for certain. The rest, f = r - floor(r), is the inclusion probability of one more copy: it
differs by source. Documents are ordered by their random odds over their inclusion odds,
``u / (1 - u) / (f / (1 - f))``, with u a hash of the id, and the first ones are taken until the
source's remaining words are met (the sample's size is fixed in words; the last document is
taken if that comes nearer). The miss is at most half a document per source.

Scale. Within a source the Pareto order is the order of u, so the cut is found from word sums
in 4096 buckets of u, then in 4096 finer ones of the one bucket it falls in, then exactly among
the distinct (k, id, size) of that finer bucket (2^-24 of a source, rows with one id aside). Only sums
are shuffled; the decision is a comparison with one cut per source. Where the cut falls among rows with
equal k, id and size, as many of them are taken as are needed, by a second hash of a row number: their
count in 4096 buckets says which bucket is cut, and only its rows are ordered.

Nulls and ties: a null text has size 0 and takes 0; a null source is a source of its own, last in
order; equal hashes are ordered by id and size; repeated rows are each decided; a row with a null id hashes as ''; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.llm.common import stored

WORD = r"[^\x20\x09-\x0D]++"
WEIGHTS = (3, 1, 2)
SHARE, MAX_COPIES, SEED = 1.5, 2, 42
BITS, STEP = 52, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def order_key(key: Column, seed: int) -> Column:
    """The first 52 bits of an md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, max_copies: int) -> DataFrame:
    """Per source: size, target, certain copies, and the words and probability that remain.

    The windows run over one row per source."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    weighed = (sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                  (F.row_number().over(place) - 1) % len(weights) + 1))
               .withColumn("cap", max_copies * F.col("source_size")))
    everything = Window.partitionBy()
    levelled = (weighed
                .withColumn("total", F.lit(share) * F.sum("source_size").over(everything))
                .withColumn("before", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
                .withColumn("rest", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
                .withColumn("level", F.max((F.col("total") - F.col("before")) / F.col("rest")).over(everything)))
    return (levelled
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")))
            .withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                        .otherwise(0).cast("bigint"))
            .withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
            .withColumn("f", F.when(F.col("source_size") > 0, F.col("need") / F.col("source_size")).otherwise(0.0))
            .select("source", "source_size", "target", "copies", "need", "f"))


def boundary(sums: DataFrame, cuts: DataFrame, low: str, bucket: str) -> DataFrame:
    """cuts with the one bucket per source in which the needed words are reached, and the
    words before it. Sums hold at most 4096 rows per source."""
    order = Window.partitionBy("source").orderBy("b")
    run = (sums.withColumn("end", F.sum("s").over(order)).withColumn("begin", F.col("end") - F.col("s"))
           .withColumnRenamed("source", "of"))
    hit = (F.col("of").eqNullSafe(F.col("source")) & (F.col(low) + F.col("begin") < F.col("need"))
           & (F.col("need") <= F.col(low) + F.col("end")))
    return (cuts.join(run, hit, "left")
            .select(*cuts.columns, F.col("b").alias(bucket), (F.col(low) + F.col("begin")).alias(bucket + "_low")))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES,
        seed: int = SEED) -> DataFrame:
    """(id, source, size, source_size, target, copies, pareto_rank, taken), one row per input row."""
    key = order_key(F.col(id_col), seed)
    sized = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               word_count(F.col(text_col)).alias("size"), key.alias("k"),
                               F.monotonically_increasing_id().alias("row")), "mix-sizes")
    first = F.shiftright("k", BITS - STEP)
    second = F.shiftright("k", BITS - 2 * STEP).bitwiseAND((1 << STEP) - 1)
    sums = stored(sized.groupBy("source", first.alias("b")).agg(F.sum("size").alias("s")), "mix-sums")
    plan = targets(sums.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share, max_copies)
    cuts = boundary(sums, plan.withColumn("zero", F.lit(0).cast("bigint")), "zero", "b1")
    cuts = stored(cuts, "mix-cuts")

    edge = cuts.where("b1 is not null").select(F.col("source").alias("of"), "b1")
    inside = sized.join(edge, F.col("source").eqNullSafe(F.col("of")) & (first == F.col("b1"))).drop("of", "b1")
    finer = inside.groupBy("source", second.alias("b")).agg(F.sum("size").alias("s"))
    cuts = stored(boundary(finer, cuts, "b1_low", "b2"), "mix-finer-cuts")

    u = (F.col("k") + 0.5) / float(1 << BITS)
    rank = u / (1 - u) * ((1 - F.col("f")) / F.col("f"))
    own = F.struct("k", F.coalesce("id", F.lit(-1 << 63)).alias("id"), "size")
    edge = cuts.where("b2 is not null").select(F.col("source").alias("of"), "b1", "b2", "b2_low", "need")
    last = (sized.join(edge, F.col("source").eqNullSafe(F.col("of"))
                       & (first == F.col("b1")) & (second == F.col("b2")))
            .groupBy("source", "b2_low", "need", own.alias("own")).agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("source").orderBy("own")
    size = F.col("own.size")
    ran = F.sum(F.col("n") * size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # Rows of a group go one by one: the j-th is taken where that comes nearer than leaving it.
    room = F.col("need") - F.col("start")
    some = (F.when(size > 0, F.floor((2 * room - size) / (2 * size)) + 1)
            .otherwise(F.when(room >= 0, F.col("n")).otherwise(0)))
    chosen = (last.withColumn("start", F.col("b2_low") + ran - F.col("n") * size)
              .withColumn("m", F.least(F.col("n"), some)).where("m > 0")
              .groupBy(F.col("source").alias("of")).agg(F.max(F.struct("own", "m", "n")).alias("cut")))
    chosen = stored(chosen.select("of", F.col("cut.own").alias("cut"), F.col("cut.m").alias("m"),
                                  F.col("cut.n").alias("n")), "mix-last-groups")

    salt = F.xxhash64("row").bitwiseAND((1 << STEP) - 1)
    tied = (sized.join(F.broadcast(chosen.where("m < n")), F.col("source").eqNullSafe(F.col("of")) & (own == F.col("cut")))
            .select("of", "m", "row", salt.alias("b")))
    run = F.sum("c").over(Window.partitionBy("of").orderBy("b"))
    part = (tied.groupBy("of", "m", "b").agg(F.count(F.lit(1)).alias("c")).withColumn("end", run)
            .where("end - c < m and m <= end")
            .select(F.col("of").alias("in"), F.col("b").alias("cb"), (F.col("m") - F.col("end") + F.col("c")).alias("left")))
    rows = (tied.join(F.broadcast(part), F.col("of").eqNullSafe(F.col("in")) & (F.col("b") == F.col("cb")))
            .withColumn("nth", F.row_number().over(Window.partitionBy("of").orderBy("row"))).where(F.col("nth") == F.col("left"))
            .select("in", F.struct("b", "row").alias("upto")))
    chosen = chosen.join(rows, F.col("of").eqNullSafe(F.col("in")), "left").select("of", "cut", "upto")
    cuts = stored(cuts.join(chosen, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix-last-cuts")

    u = (F.col("k") + 0.5) / float(1 << BITS)
    rank = u / (1 - u) * ((1 - F.col("f")) / F.col("f"))
    at = cuts.select(F.col("source").alias("of"), "source_size", "target", "copies", "f", "b1", "b2", "cut", "upto")
    whole = F.shiftright("k", BITS - 2 * STEP) < F.col("b1") * (1 << STEP) + F.col("b2")
    upto = (F.shiftright("k", BITS - 2 * STEP) == F.col("b1") * (1 << STEP) + F.col("b2")) & (
        (own < F.col("cut")) | (own == F.col("cut")) & (
            F.col("upto").isNull() | (F.struct(salt.alias("b"), "row") <= F.col("upto"))))
    more = F.coalesce(whole | upto, F.lit(False)).cast("bigint")
    return (sized.join(at, F.col("source").eqNullSafe(F.col("of")), "left")
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
                    "copies", F.when(F.col("f") > 0, rank).alias("pareto_rank"),
                    (F.col("size") * (F.col("copies") + more)).alias("taken")))

"""N-gram Jaccard join: near-duplicate texts by exact set similarity of word shingles.

Two texts link when ``100 * |A & B| >= threshold * |A | B|`` over their distinct word
5-gram hashes (64 bit). The join is exact and never enumerates a group's pairs blindly:

1. Order. A fixed-size sketch (2^23 buckets) of frequent shingles gives one global order,
   frequent buckets last, so that a passage in thousands of texts leaves the prefixes.
   Any order keeps the join exact; the sketch only saves work.
2. Prefix. A text of n shingles posts its first n - ceil(0.75 n) + 1: linked texts share
   one. Postings are aggregated per shingle (partial sums before the shuffle); a shingle
   of one text ends there.
3. Pivots. Each shared shingle's texts are compared with its most typical text only, the one
   with the fewest rarer shingles: a group of thousands of near copies costs one pair per
   text, not all pairs. The links found give classes.
4. Tiles. Shingles that still touch two or more classes are joined within size bands
   (ratio 4/3), between classes only, with a positional bound, so no link between classes
   is missed; pairs inside a class add nothing to it.
5. Bound, then verify. A parity bitmap per text (width by its size band) bounds the overlap
   from above by bit counts; survivors are intersected exactly as sorted arrays, which a
   filtered pass over the texts emits for just the texts that need it.

Equal shingle sets share a ``set_id`` (64-bit digest) and are one node, so exact copies cost
nothing. Nulls: a null or empty text, or one without words, has no shingles and no links; a
row without an id is returned unlinked with a null component. Repeated rows are each returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import connected, cut, key_filter, mix64, passes, schema_with, stored, text_words

WORDS, THRESHOLD = 5, 75
SKETCH_BITS = 23
MULT = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64)) for i in range(64)]


def row_sets(col, words: int):
    """(row, sorted distinct shingle hashes) of every text of an Arrow column."""
    for first, _, _, _, h, counts in text_words(col):
        grams = None
        if len(h) >= words:
            m = len(h) - words + 1
            grams = np.zeros(m, np.uint64)
            for j in range(words):
                grams += h[j:j + m] * MULT[j]
            grams = mix64(grams)
        at = 0
        for i, n in enumerate(counts.tolist()):
            if n >= words:
                g = np.sort(grams[at:at + n - words + 1])
                yield first + i, g[np.concatenate(([True], g[1:] != g[:-1]))]
            elif n:
                short = np.array([n], np.uint64)
                for j in range(n):
                    short += h[at + j:at + j + 1] * MULT[words + j]
                yield first + i, mix64(short)
            else:
                yield first + i, np.empty(0, np.uint64)
            at += n


def width(n: int) -> int:
    """Bits of the bitmap of a set of n: the next power of two, 64 to 8192."""
    return 1 << min(max((n - 1).bit_length(), 6), 13)


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity bitmap: a bit flips for each element that hashes to it, so the bit count of
    two bitmaps' XOR never exceeds the size of the symmetric difference."""
    w = width(len(hashes))
    bits = np.bincount((hashes & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def bitmap_distance(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference; the wider bitmap is folded to the narrower."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count((x ^ y).view(np.uint64)).sum())


def frequent_buckets(texts: DataFrame, words: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """Class of every hash bucket: 0, or 1 + log2 of its count where it stands out.

    A task passes on the buckets that hold more than chance gives them; what stands out of their
    sums, at most a quarter of 2^bits rows whatever the input, reaches the driver."""
    def count(batches):
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            for _, g in row_sets(batch.column(0), words):
                np.add.at(total, (g >> np.uint64(64 - bits)).astype(np.int64), 1)
        mean = total.mean()
        hot = np.flatnonzero(total >= 1 + mean + 2 * mean ** 0.5)
        yield pa.RecordBatch.from_arrays([pa.array(hot.astype(np.int32)), pa.array(total[hot].astype(np.int64))], ["b", "n"])

    sums = cut(texts.select("text").mapInArrow(count, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")))
    noise = (sums.agg(F.sum("n")).first()[0] or 0) / (1 << bits)
    rows = sums.where(F.col("n") >= 16 + 4 * noise).toArrow()
    out = np.zeros(1 << bits, np.uint8)
    out[rows.column("b").to_numpy()] = 1 + np.log2(np.maximum(rows.column("n").to_numpy(), 1)).astype(np.uint8)
    return out


def signatures(texts: DataFrame, words: int, threshold: int, order: np.ndarray) -> DataFrame:
    """(id, n, set_id, sig, prefix): one narrow row per text; prefix in the global order."""
    classes = texts.sparkSession.sparkContext.broadcast(order)
    shift = np.uint64(65 - len(order).bit_length())

    def sign(batches):
        cls = classes.value
        for batch in batches:
            ids = batch.column(0)
            ns = np.zeros(len(ids), np.int64)
            sets, sigs, prefixes = ([None] * len(ids) for _ in range(3))
            for i, g in row_sets(batch.column(1), words):
                n = ns[i] = len(g)
                if n and ids[i].is_valid:
                    sets[i] = xxhash.xxh3_64_intdigest(g.tobytes()) - (1 << 63)
                    sigs[i] = bitmap(g)
                    c = cls[g >> shift]
                    if c.any():
                        g = g[np.argsort(c, kind="stable")]
                    # 48 bits say which postings to bring together; sets are compared on all 64
                    prefixes[i] = (g[:n + (-threshold * n) // 100 + 1] >> np.uint64(16)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(ns), pa.array(sets, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64()))], ["id", "n", "set_id", "sig", "prefix"])

    return texts.select("id", "text").mapInArrow(
        sign, "id bigint, n bigint, set_id bigint, sig binary, prefix array<bigint>")


def with_set_ids(docs: DataFrame, column: str, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """docs and each text's ``set_id``, null for a text without words."""
    names = [*docs.columns, column]

    def work(batches):
        for batch in batches:
            got = [xxhash.xxh3_64_intdigest(g.tobytes()) - (1 << 63) if len(g) else None
                   for _, g in row_sets(batch.column(text_col), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], names)

    return docs.mapInArrow(work, schema_with(docs, docs.columns, f"`{column}` bigint"))


def linked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets meet the threshold, exactly."""
    side = lambda s: sets.select(F.col("set_id").alias(s), F.col("n").alias(f"n{s}"),
                                 F.col("sig").alias(f"sig{s}"), F.col("rep").alias(f"rep{s}"))
    sized = (pairs.join(side("a"), "a").join(side("b"), "b")
             .where((100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb"))))

    def bound(batches):
        for batch in batches:
            x = batch.to_pydict()
            keep = [(100 + threshold) * (na + nb - bitmap_distance(p, q)) >= 2 * threshold * (na + nb)
                    for na, nb, p, q in zip(x["na"], x["nb"], x["siga"], x["sigb"])]
            yield (batch.select(["a", "b", "repa", "repb"]).filter(pa.array(keep, pa.bool_())))

    left = stored(sized.select("a", "b", "na", "nb", "siga", "sigb", "repa", "repb")
                  .mapInArrow(bound, "a bigint, b bigint, repa bigint, repb bigint"), "jaccard-pairs")
    if left.isEmpty():
        return left.select("a", "b")
    need = texts.sparkSession.sparkContext.broadcast(key_filter(
        left.select(F.explode(F.array("repa", "repb")).alias("r")), F.col("r")))

    def arrays(batches):
        for batch in batches:
            batch = batch.filter(pa.array(
                passes(need.value, batch.column(0).fill_null(0).to_numpy(zero_copy_only=False))))
            got = [g.tobytes() for _, g in row_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_64_intdigest(g) - (1 << 63) for g in got], pa.int64()),
                 pa.array(got, pa.binary())], ["id", "set_id", "elements"])

    held = stored(texts.select("id", "text").mapInArrow(arrays, "id bigint, set_id bigint, elements binary")
                  .join(left.select(F.explode(F.array("repa", "repb")).alias("id")).distinct(), "id", "left_semi"),
                  "jaccard-sets")

    def intersect(batches):
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                z = np.sort(np.concatenate((x, y)))
                same = int((z[1:] == z[:-1]).sum())
                keep.append(100 * same >= threshold * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    arm = lambda s: held.select(F.col("set_id").alias(s), F.col("elements").alias(f"e{s}"))
    return (left.select("a", "b").join(arm("a"), "a").join(arm("b"), "b").select("a", "b", "ea", "eb")
            .mapInArrow(intersect, "a bigint, b bigint"))


def shared(signed: DataFrame, groups: DataFrame) -> DataFrame:
    """(h, s, n, pos, pivot): postings of the shingles in ``groups``, with the set in which fewest
    rarer shingles, for its size, come before."""
    keep = signed.sparkSession.sparkContext.broadcast(key_filter(groups, F.col("h")))

    def post(batches):
        for batch in batches:
            lists = batch.column(2)
            h = lists.flatten().to_numpy(zero_copy_only=False)
            size = np.diff(lists.offsets.to_numpy(zero_copy_only=False))
            at = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            ok = passes(keep.value, h) if len(h) else np.zeros(0, bool)
            take = pa.array(at[ok])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[ok]), batch.column(0).take(take), batch.column(1).take(take),
                 pa.array(pos[ok].astype(np.int64))], ["h", "s", "n", "pos"])

    rows = (signed.where(F.col("set_id").isNotNull()).select("set_id", "n", "prefix")
            .mapInArrow(post, "h bigint, s bigint, n bigint, pos bigint")
            .groupBy("h", "s").agg(F.first("n").alias("n"), F.first("pos").alias("pos")))
    rows = stored(rows, "jaccard-postings")
    typical = F.min(F.struct((F.col("pos") / F.col("n")).alias("before"), "s"))
    pivots = rows.groupBy("h").agg(typical.getField("s").alias("pivot"), F.count(F.lit(1)).alias("sets"))
    return rows.join(pivots.where("sets > 1").drop("sets"), "h")


def tiles(posts: DataFrame, threshold: int) -> DataFrame:
    """Candidate pairs of different classes that share a shingle, joined in size bands."""
    band = F.floor(F.log(F.col("n")) / float(np.log(100 / threshold))).cast("int")
    small = posts.select("h", band.alias("tile"), F.col("s").alias("a"), F.col("n").alias("na"),
                         F.col("pos").alias("pa"), F.col("c").alias("ca"))
    large = posts.select("h", F.explode(F.array(band, band - 1)).alias("tile"), F.col("s").alias("b"),
                         F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("c").alias("cb"))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # most that can still be shared
    pairs = small.join(large, ["h", "tile"]).where(
        (F.col("ca") != F.col("cb"))
        & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (100 * F.col("na") >= threshold * F.col("nb"))
        & ((100 + threshold) * rest >= threshold * (F.col("na") + F.col("nb"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       threshold: int = THRESHOLD, sets_too: bool = False) -> DataFrame:
    """(id, n_shingles, component_id), one row per input row. ``threshold`` in percent, 50 to 100.

    With ``sets_too`` also (set_id, component): ids with several texts can name several components alike."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(texts, words, threshold, frequent_buckets(texts, words)), "jaccard-signed")
    sets = stored(signed.where(F.col("set_id").isNotNull()).groupBy("set_id")
                  .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")),
                  "jaccard-nodes")
    groups = stored(signed.where(F.col("set_id").isNotNull())
                    .select(F.explode("prefix").alias("h"), F.col("set_id").alias("s"))
                    .groupBy("h").agg(F.count(F.lit(1)).alias("cnt"), F.min("s").alias("low"), F.max("s").alias("top"))
                    .where("low != top"), "jaccard-groups")
    larger = groups.where("cnt > 2")
    posts = stored(shared(signed, larger), "jaccard-posts")
    first = (groups.select(F.col("low").alias("a"), F.col("top").alias("b"))
             .unionByName(posts.where("s != pivot").select(F.least("pivot", "s").alias("a"),
                                                          F.greatest("pivot", "s").alias("b"))).distinct())
    links = cut(linked(first, sets, texts, words, threshold))
    classes = cut(connected(links, "a", "b"))
    labelled = (posts.join(classes.select(F.col("node").alias("s"), "component"), "s", "left")
                .withColumn("c", F.coalesce("component", "s")).drop("component"))
    mixed = labelled.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("h")
    second = tiles(labelled.join(mixed, "h", "left_semi"), threshold)
    more = cut(linked(second.join(first, ["a", "b"], "left_anti"), sets, texts, words, threshold))
    if not more.isEmpty():  # the classes that the second round joins: a graph of classes only
        known = classes.withColumnRenamed("component", "c")
        for side in ("a", "b"):
            more = (more.join(known.withColumnRenamed("node", side), side, "left")
                    .withColumn(side, F.coalesce("c", side)).drop("c"))
        joined = cut(connected(more, "a", "b")).withColumnRenamed("component", "c")
        classes = (classes.join(joined.withColumnRenamed("node", "component"), "component", "left")
                   .select("node", F.coalesce("c", "component").alias("component"))
                   .unionByName(joined.join(classes, "node", "left_anti").select("node", F.col("c").alias("component"))))
    member = (sets.select("set_id", "rep").join(classes.withColumnRenamed("node", "set_id"), "set_id", "left")
              .withColumn("component", F.coalesce("component", "set_id")))
    names = member.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = member.join(names, "component").select("set_id", "component_id", "component")
    return (signed.select("id", "n", "set_id").join(member, "set_id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component_id", "id").alias("component_id"),
                    *(["set_id", "component"] if sets_too else [])))

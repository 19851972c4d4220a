"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

Learning. Principal axes of a bounded sample (``SAMPLE`` vectors with the smallest id hashes) and a
rotation learned by iterative quantisation (alternating sign codes and an orthogonal Procrustes
step) give balanced binary codes of up to 64 bits. Only the index is fitted on the sample; every
vector is coded and searched.

Tables. A table's key is a substring of the code; vectors of one label that share a key in any table
are compared. Substrings are s = max(8, log2(vectors / 256)) bits, so buckets keep their size as
the input grows, and there are as many tables as give a pair at the threshold 97 % to meet
(1 - (1 - p^s)^tables, p = 1 - angle / pi): the disjoint substrings first, then fixed random ones.

Hamming. Only codes and ids are dealt to the tables. A bucket's codes are compared in tiles of at most ``TILE`` by
``TILE`` rows, so a bucket of any size is split over tasks. A vector stays in a tile where another one, not met in an
earlier table, is within the Hamming distance that all but ``MISS`` of pairs at the threshold keep to.

Rerank. Vectors that stay are fetched for their tiles and compared there by cosine in double precision; no pair
leaves a tile. A tile gives each vector its number of links that no earlier table has seen, and its smallest
partner in the tile's components. Vectors of equal direction (in single precision) are one row with a count.

Lengths. Vectors of different lengths have no cosine and never meet. The quantiser is learned for the sample's most
common length; vectors of another one are coded by the signs of ``bits`` fixed random projections, whose
bits differ with probability angle / pi as well, and searched in the same tables.

Nulls and ties: vectors that are null, zero, hold null or non-finite components, or have no label link with
nothing and are kept; a row without an id links with nothing; rows that repeat an id and a vector are one
vector, each returned; equal vectors of several ids are linked; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from modlens.llm.common import connected, cut, hash_sample, stored

COSINE = 0.93
SAMPLE, BITS, ROUNDS, TILE = 10_000, 64, 50, 1024
MEET, MISS = 0.97, 0.001


def rows_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of the usable rows as float64, their row numbers) of a list column, by length."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    out = []
    for i, x in enumerate(col):
        if x.is_valid:
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if len(v) and np.isfinite(v).all() and np.any(v):
                out.append((i, v))
    return [v for _, v in out], [i for i, _ in out]


class Quantiser:
    """Sign codes after centring, projection and rotation."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 1):
        self.mean = sample.mean(0)
        x = sample - self.mean
        values, axes = np.linalg.eigh(x.T @ x / max(len(x), 1))
        self.bits = min(bits, x.shape[1])
        axes = axes[:, np.argsort(values)[::-1][:self.bits]]
        z = x @ axes
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(self.bits, self.bits)))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(z @ turn >= 0, 1.0, -1.0).T @ z)
            turn = right.T @ left.T
        self.project = axes @ turn

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(rows, bits) of 0 and 1."""
        return ((unit - self.mean) @ self.project >= -1e-9).astype(np.uint8)  # equal directions, equal codes


class Signs:
    """Signs of fixed random projections, for lengths without a learned quantiser."""

    def __init__(self, size: int, bits: int, seed: int = 3):
        self.project = np.random.default_rng((seed, size)).normal(size=(size, bits))

    def codes(self, unit: np.ndarray) -> np.ndarray:
        return (unit @ self.project >= -1e-9).astype(np.uint8)


@lru_cache(maxsize=16)
def signs(size: int, bits: int) -> Signs:
    return Signs(size, bits)


def tables(bits: int, n: int, cosine: float, seed: int = 2) -> list[np.ndarray]:
    """The bit places of each table's substring."""
    s = min(max(8, math.ceil(math.log2(max(n, 1) / 256))), bits)
    p = (1 - math.acos(cosine) / math.pi) ** s
    count = max(bits // s, math.ceil(math.log(1 - MEET) / math.log1p(-p)))
    r = np.random.default_rng(seed)
    own = [np.arange(i * s, (i + 1) * s) for i in range(bits // s)]
    return [*own, *(np.sort(r.choice(bits, s, replace=False)) for _ in range(count - len(own)))]


def keys(code: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """(rows, tables) of substring values."""
    return np.stack([code[:, p].astype(np.int64) @ (1 << np.arange(len(p), dtype=np.int64)) for p in places], axis=1)


def radius(bits: int, cosine: float) -> int:
    """The Hamming distance that all but ``MISS`` of pairs at the threshold keep to: bits differ with
    probability angle / pi."""
    p, within = math.acos(cosine) / math.pi, 0.0
    for d in range(bits):
        within += math.comb(bits, d) * p ** d * (1 - p) ** (bits - d)
        if within >= 1 - MISS:
            return d
    return bits


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits as one bigint each."""
    out = np.zeros((len(bits), 8), np.uint8)
    b = np.packbits(bits, axis=1)
    out[:, :b.shape[1]] = b
    return out.view(np.int64).ravel()


def unpacked(code: np.ndarray, bits: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(code, np.int64).view(np.uint8).reshape(len(code), 8), axis=1)[:, :bits]


def unseen(own: np.ndarray, table: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of rows share no key of an earlier table."""
    new = np.ones(len(a), bool)
    for t in range(table):
        new &= own[a, t] != own[b, t]
    return new


def within_radius(code: np.ndarray, own: np.ndarray, table: int, side: np.ndarray, most: int) -> np.ndarray:
    """Rows of a tile that have another one, not met in an earlier table, within a Hamming distance."""
    bits = code.view(np.uint64)  # of a signed number the magnitude's bits would be counted
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= most
    if side.any():
        near &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    new = unseen(own, table, a, b)
    out = np.zeros(len(code), bool)
    out[a[new]] = out[b[new]] = True
    return out


def tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of every tile of two rows or more; its key is the first ``width`` columns, by which rows come sorted."""
    held, last = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:width] != last:
                if len(held) > 1:
                    yield last, held
                held, last = [], row[:width]
            held.append(row[width:])
    if len(held) > 1:
        yield last, held


def tile_links(unit: np.ndarray, copies: np.ndarray, own: np.ndarray, table: int, side: np.ndarray,
               cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links per row not seen in an earlier table, smallest row of its component) of one tile."""
    near = unit @ unit.T >= cosine
    if side.any():  # two chunks of a bucket: only pairs across
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    new = unseen(own, table, a, b)
    links = np.bincount(a[new], weights=copies[b[new]], minlength=len(unit)).astype(np.int64)
    low = np.arange(len(unit))
    while len(a):
        step = low.copy()
        np.minimum.at(step, a, low[b])
        step = step[step]
        if (step == low).all():
            break
        low = step
    return links, low


def learn(vectors: DataFrame, id_col: str, vec_col: str, sample: int = SAMPLE) -> tuple[Quantiser, int] | None:
    """The quantiser and the vectors' length; None where no vector is usable."""
    def usable(batches):
        for batch in batches:
            got, at = rows_of(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())),
                 pa.array([(v / np.linalg.norm(v)).tobytes() for v in got], pa.binary())], ["h", "v"])

    chosen = hash_sample(vectors.select(F.col(id_col).alias("h"), F.col(vec_col).alias("v")), "h", sample)
    rows = chosen.mapInArrow(usable, "h bigint, v binary").collect()
    if not rows:
        return None
    got = [np.frombuffer(r["v"]) for r in sorted(rows, key=lambda r: (r["h"] is None, r["h"], bytes(r["v"])))]
    sizes = [len(v) for v in got]
    size = max(sorted(set(sizes)), key=sizes.count)
    return Quantiser(np.stack([v for v in got if len(v) == size])), size


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row."""
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).alias("v"))
    learned = learn(base, "id", "v")
    if learned is None:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    model = spark.sparkContext.broadcast(learned)

    element = base.schema["v"].dataType.elementType
    kind = np.float32 if isinstance(element, FloatType) else np.float64  # as given, so nothing is rounded

    def coded(batches):
        quantiser, size = model.value
        for batch in batches:
            got, at = rows_of(batch.column(2))
            by_size: dict[int, list] = {}
            for v, i in zip(got, at):
                if batch.column(0)[i].is_valid and batch.column(1)[i].is_valid:
                    by_size.setdefault(len(v), []).append((v, i))
            for n, pairs in by_size.items():
                take = pa.array([i for _, i in pairs], pa.int64())
                unit = np.stack([v / np.linalg.norm(v) for v, _ in pairs])
                coder = quantiser if n == size else signs(n, quantiser.bits)
                labels = [f"{n}:{x}" for x in batch.column(1).take(take).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(labels, pa.string()),
                     pa.array([xxhash.xxh3_128_digest((u.astype(np.float32) + 0).tobytes()) for u in unit], pa.binary()),
                     pa.array([v.astype(kind).tobytes() for v, _ in pairs], pa.binary()),
                     pa.array(packed(coder.codes(unit)))], ["id", "label", "same", "v", "code"])

    all_coded = stored(base.mapInArrow(coded, "id bigint, label string, same binary, v binary, code bigint"), "vectors")
    node = F.xxhash64("same").alias("h")
    nodes = stored(all_coded.groupBy("label", "same").agg(
        F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.first("code").alias("code")), "vector-nodes")
    bits = learned[0].bits
    places = tables(bits, nodes.count(), cosine)
    most = radius(bits, cosine)

    def post(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = keys(unpacked(batch.column(4).to_numpy(), bits), places)
            for t in range(len(places)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(n, t, np.int32)), pa.array(own[:, t]), *batch.columns[1:]],
                    ["label", "t", "k", "rep", "h", "copies", "code"])

    posts = nodes.select("label", "rep", node, "copies", "code").mapInArrow(
        post, "label string, t int, k bigint, rep bigint, h bigint, copies bigint, code bigint")
    # Only buckets of more than a tile have chunks; written first, so that their size decides how they are joined.
    large = stored(posts.groupBy("label", "t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile)
                   .withColumn("chunks", F.ceil(F.col("n") / tile).cast("int")).drop("n"), "vector-buckets")
    group = ["label", "t", "k", "i", "j"]
    placed = (posts.join(large, ["label", "t", "k"], "left")
              .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
              .withColumn("c", F.pmod("h", F.col("chunks")).cast("int"))
              .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
              .withColumn("i", F.least("c", "o")).withColumn("j", F.greatest("c", "o"))
              .select(*group, "c", "rep", "h", "copies", "code"))
    fields = "label string, t int, k bigint, i int, j int, c int, rep bigint, h bigint, copies bigint, code bigint"
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.split()[1]])
                        for f in fields.split(", ")])

    def parts(key, rows):
        """(codes, own keys of earlier tables, side) of a tile; a tile of two chunks compares across them only."""
        code = np.array([r[4] for r in rows], np.int64)
        own = keys(unpacked(code, bits), places[:key[1]]) if key[1] else np.empty((len(code), 0), np.int64)
        side = np.array([key[3] != key[4] and r[0] == key[4] for r in rows])
        return code, own, side

    def screen(batches):
        out: list[tuple] = []
        for key, rows in tiles(batches, 5):
            code, own, side = parts(key, rows)
            out.extend(key + rows[i] for i in np.flatnonzero(within_radius(code, own, key[1], side, most)))
            if len(out) >= 1 << 13:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    def rerank(batches):
        done: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done)], ["rep", "links", "low"])

        for key, rows in tiles(batches, 5):
            rows.sort(key=lambda r: r[1:3])
            _, own, side = parts(key, rows)
            unit = np.stack([np.frombuffer(r[5], kind) for r in rows]).astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1)[:, None]
            links, low = tile_links(unit, np.array([r[3] for r in rows]), own, key[1], side, cosine)
            rep = np.array([r[1] for r in rows])
            some = (links > 0) | (low != np.arange(len(low)))
            done.append((rep[some], links[some], rep[low][some]))
            if len(done) >= 1 << 10:
                yield batch()
                done = []
        if done:
            yield batch()

    near = placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(screen, fields)
    original = all_coded.groupBy("label", F.col("id").alias("rep"), node).agg(F.min("v").alias("v"))
    met = near.join(original, ["label", "rep", "h"]).select(*near.columns, "v")
    found = stored(met.repartition(*group).sortWithinPartitions(*group)
                   .mapInArrow(rerank, "rep bigint, links bigint, low bigint"), "vector-links")
    degrees = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = cut(connected(found.where("rep != low").select(F.col("rep").alias("u"), F.col("low").alias("v"))))
    known = (nodes.select("label", "same", "rep", "copies").join(degrees, "rep", "left")
             .join(classes.withColumnRenamed("node", "rep"), "rep", "left")
             .select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                     F.coalesce("component", "rep").alias("component")))
    joined = all_coded.select("id", "label", "same").join(known, ["label", "same"])
    per_row = joined.groupBy("id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    return (base.select("id").join(per_row, "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))

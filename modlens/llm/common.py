"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from modlens.session import checkpoint_root, scratch_path

#: Text is worked on in slices of about this many bytes, whatever the batch size.
SLICE_BYTES = 1 << 18
#: Arrow batches sent to Python workers hold at most about this much (Spark's own default is 64 MB).
BATCH_BYTES = "4m"
#: Environment of Python workers: arrays of 4 MB and more, and 8 MB of smaller ones, are returned to the system
#: when freed.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 22),
                 "MALLOC_TRIM_THRESHOLD_": str(1 << 23)}
#: Bits of the fixed-size membership filters (4 MB each, however many keys they hold).
FILTER_BITS = 25


def workers_find_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver did, so a local session may be started from any
    folder; clusters get it with ``--py-files``. Their batches are bounded in bytes, as texts are, and
    workers give freed memory back: idle ones stay beside the next stage's."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of ``sf_dir``."""
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage with
    files that every executor sees, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def schema_with(df: DataFrame, others: list[str], added: str) -> StructType:
    """The schema of the columns ``others`` followed by the fields of a DDL string."""
    return StructType([df.schema[c] for c in others] + StructType.fromDDL(added).fields)


def hash_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """At most ``size`` rows, those with the smallest hashes of ``key``: a fixed choice for given rows.
    About twice as many pass a threshold on the hash first, so a task's share stays small."""
    share = min(1.0, 2 * size / max(df.count(), 1))
    h = F.xxhash64(F.col(key))
    near = df.where(F.pmod(h, F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return near.orderBy(F.pmod(h, F.lit(1 << 30)), h, key).limit(size)


def cut(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offs.astype(np.int64)


def slices(offs: np.ndarray, size: int = SLICE_BYTES):
    """Row ranges [a, b) of about ``size`` bytes each, at least one row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + size, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Powers:
    """p^i and p^-i modulo 2^64, grown on demand."""

    P = 0x9E3779B97F4A7C15
    INV = pow(P, -1, 1 << 64)

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            grow = lambda p: np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, p, np.uint64))))
            self.up, self.down = grow(self.P), grow(self.INV)
        return self.up[:n], self.down[:n]


POWERS = Powers()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, all at once from prefix sums."""
    up, down = POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts per row) of the words ``[^\\x20\\x09-\\x0D]+``; offs begin at 0."""
    solid = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = solid
    before[offs] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = solid
    after[offs] = False
    ends = np.flatnonzero(solid & ~after[1:]) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


def long_text_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of one long text's words, hashed in pieces so that memory stays bounded."""
    out, a = [], 0
    while a < len(data):
        b = min(a + SLICE_BYTES, len(data))
        if b < len(data):
            gaps = np.flatnonzero(SPACE[data[a:b]])
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:  # one word longer than a slice: up to its end
                while b < len(data) and not SPACE[data[b]]:
                    b += 1
        piece = LOWER[data[a:b]]
        s, e, _ = words(piece, np.array([0, len(piece)]))
        out.append((s + a, e + a, span_hashes(piece, s, e)))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out))


def text_words(col: pa.Array):
    """For each slice of rows: (first row, bytes, word starts, word ends, word hashes, words per row).

    Words are ``[^\\x20\\x09-\\x0D]+``, hashed with A-Z lowered; starts and ends are places in bytes."""
    raw, offs = utf8(col)
    for a, b in slices(offs):
        data = raw[offs[a]:offs[b]]
        if b == a + 1 and len(data) > SLICE_BYTES:
            s, e, h = long_text_words(data)
            yield a, data, s, e, h, np.array([len(h)])
        else:
            low = LOWER[data]
            s, e, n = words(low, offs[a:b + 1] - offs[a])
            yield a, data, s, e, span_hashes(low, s, e), n


def key_filter(df: DataFrame, key: Column, bits: int = FILTER_BITS) -> np.ndarray:
    """Fixed-size bit filter of a bigint key, built with Spark's bitmap aggregates: at most
    2^(bits-15) rows of 4 KB reach the driver, however many keys there are. It may let
    extra keys through, never fewer; what follows joins exactly."""
    pos = key.bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = (df.select(pos.alias("p"))
            .groupBy(F.bitmap_bucket_number("p").alias("b"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        at = (r["b"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def passes(filt: np.ndarray, keys: np.ndarray, bits: int = FILTER_BITS) -> np.ndarray:
    p = keys & np.int64((1 << bits) - 1)
    return (filt[p >> 3] >> (p & 7).astype(np.uint8)) & 1 != 0


def parted(df: DataFrame, key: str, keys: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose bigint key may be among ``keys``, the rest): only the first have to meet them in a
    join, so most texts aren't shuffled. Only the key crosses to Python."""
    shared = df.sparkSession.sparkContext.broadcast(key_filter(keys, F.col(column)))

    def flag(ids: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, ids.to_numpy(np.int64)))

    may = F.pandas_udf(flag, "boolean")(F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0)))
    marked = df.withColumn("__may", may)
    return marked.where("__may").drop("__may"), marked.where(~F.col("__may")).drop("__may")


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): smallest node reachable, by alternating large and small stars.

    Each round is two aggregates and joins on the edges; nothing reaches the driver but a
    count and a checksum. Hub nodes are pre-aggregated (min of neighbours), and their edge
    lists are joined on a plain shuffle that adaptive execution may split."""
    e = (edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
         .where(F.col("u") != F.col("v")).distinct())
    e = cut(e)
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        large = cut(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = cut(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)

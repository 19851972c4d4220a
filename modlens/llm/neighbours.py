"""Approximate nearest neighbours by inner product: inverted lists scanned by adaptive dimension sampling.

Index. Largest inner product becomes least distance by one more dimension, sqrt(M^2 - |x|^2) with M the
largest norm; queries are scaled to norm M. Lists are the cells of k-means centres learned on a bounded
sample (``SAMPLE`` vectors of one length with the smallest hashes of their bytes), about ``LIST_ROWS`` vectors
each and at most ``MAX_LISTS``. Every vector is put in a list. How many lists a query probes is measured on
the same sample: the fewest, nearest first, that hold ``REACH`` of the exact neighbours of its first
``TRIALS`` vectors. Vectors of other lengths than the ``LENGTHS`` most frequent ones are one list a length.

Scan. Vectors are turned by a random rotation and kept as blocks of ``BLOCK`` columns. With t the query's
k-th best product so far, a candidate matters only if its squared distance is at most
r2 = |q|^2 + |x|^2 - 2 t. After d of D columns the hypothesis "distance <= r" is rejected, and the candidate
abandoned, where the partial squared distance times D / d exceeds (1 + EPSILON / sqrt(d))^2 r2; after all
columns the test is exact up to rounding, which it allows for. A first round scans each query's nearest
list and gives t; the second scans its other lists with it. What survives is scored anew: products of the
original components, summed in double precision in the order of the components.

Size. Equal vectors are one node with its k + 1 smallest ids (a limit that ties need, found with partial
limits before the shuffle), so a vector that holds a third of all rows is compared once. Lists are split into
chunks of ``CHUNK`` nodes and their probes into chunks of ``PROBES``; a task streams probes past one chunk. Only
the sample, the centres and counts reach the driver. A probe is a row: rows grow with queries times
probed lists, products with queries times the lists' vectors, as unstructured vectors demand of any index.

Nulls and ties: vectors that are null, empty, zero, or hold null or non-finite components, and rows without
an id, take no part. Vectors of different lengths have no inner product and are never compared. Ties go to
the smaller id; rows that repeat an id are rows of their own (a query leaves out itself, not its copies).
An empty table gives none. Only the id and vector columns are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.llm.common import stored, workers_find_package

K, EVERY = 20, 20
SAMPLE, SAMPLE_BYTES, LENGTHS = 16_384, 1 << 26, 4
LIST_ROWS, MAX_LISTS, ROUNDS = 1024, 1024, 12
REACH, TRIALS = 0.97, 256
BLOCK, EPSILON = 16, 2.1
CHUNK, PROBES, SEED_ROWS, QUERIES = 4096, 16_384, 64, 64


def usable(col: pa.Array) -> tuple[list[np.ndarray], list[int]]:
    """(values, row numbers) of the vectors that take part, as float64; -0 counts as 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offs = col.offsets.to_numpy()
    flat = col.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    fine = np.isfinite(flat)
    fine[np.asarray(col.values.is_null())] = False
    bad = np.concatenate(([0], np.cumsum(~fine)))
    some = np.concatenate(([0], np.cumsum(flat != 0)))
    ok = (bad[offs[1:]] == bad[offs[:-1]]) & (some[offs[1:]] > some[offs[:-1]]) & np.asarray(col.is_valid())
    at = np.flatnonzero(ok)
    return [flat[offs[i]:offs[i + 1]] for i in at], at.tolist()


@lru_cache(maxsize=2)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means; begins with rows spread over the sample, an empty cell stays where it was."""
    c = x[np.linspace(0, len(x) - 1, count).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        n = np.bincount(own, minlength=count)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, most: int, rows: int = 4096) -> np.ndarray:
    """The ``most`` nearest centres of each row, nearest first."""
    half = (c * c).sum(1) / 2
    out = [np.argsort(half - x[a:a + rows] @ c.T, axis=1, kind="stable")[:, :most] if most > 1
           else np.argmin(half - x[a:a + rows] @ c.T, axis=1)[:, None] for a in range(0, max(len(x), 1), rows)]
    return np.concatenate(out)


class Index:
    """Centres of one vector length and the number of lists a query probes."""

    def __init__(self, sample: np.ndarray, rows: int, largest: float, k: int = K, list_rows: int = LIST_ROWS,
                 reach: float = REACH):
        self.largest = max(largest, float(np.linalg.norm(sample, axis=1).max()))
        lists = max(1, min(MAX_LISTS, math.ceil(rows / list_rows), len(sample) // 8))
        lifted = self.lift(sample)
        self.centres = centres(lifted, lists) if lists > 1 else lifted.mean(0, keepdims=True)
        self.probes = 1
        if lists > 1 and len(sample) > 1:
            own = nearest(lifted, self.centres, 1)[:, 0]
            trials = sample[:TRIALS]
            order = np.argsort(nearest(self.aim(trials), self.centres, lists), axis=1)  # place of each list
            near = trials @ sample.T
            near[np.arange(len(trials)), np.arange(len(trials))] = -np.inf
            k = min(k, len(sample) - 1)
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            needed = np.sort(np.take_along_axis(order, own[best], axis=1).ravel())
            self.probes = int(needed[min(math.ceil(reach * len(needed)), len(needed)) - 1]) + 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        spare = np.maximum(self.largest ** 2 - (x * x).sum(1), 0)
        return np.column_stack((x, np.sqrt(spare)))

    def aim(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((q * (self.largest / np.linalg.norm(q, axis=1))[:, None], np.zeros(len(q))))

    def list_of(self, x: np.ndarray) -> np.ndarray:
        return nearest(self.lift(x), self.centres, 1)[:, 0]

    def probed(self, q: np.ndarray) -> np.ndarray:
        return nearest(self.aim(q), self.centres, max(self.probes, 1))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, components added in order."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


class Chunk:
    """Some nodes of one list: original vectors, rotated column blocks, ids."""

    def __init__(self, rep: np.ndarray, x: np.ndarray, block: int = BLOCK):
        self.rep, self.x = rep, x
        self.turn = rotation(x.shape[1])
        turned = x @ self.turn
        self.ends = [*range(block, x.shape[1], block), x.shape[1]]
        self.blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip([0, *self.ends], self.ends)]
        self.norm = (x * x).sum(1)
        self.tested = np.zeros(len(self.ends), np.int64)  # candidates that reached each test

    def survivors(self, q: np.ndarray, t: np.ndarray, a: int, b: int, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of nodes [a, b) that no test rejects."""
        turned = q @ self.turn
        norm = (q * q).sum(1)
        size = q.shape[1]
        with np.errstate(invalid="ignore", over="ignore"):
            scale = norm[:, None] + self.norm[None, a:b]
            limit = scale - 2 * t[:, None] + 1e-9 * (scale + 2 * np.abs(np.where(np.isfinite(t), t, 0))[:, None])
            i = j = part = None
            for f, (d, x) in enumerate(zip(self.ends, self.blocks)):
                own = turned[:, d - x.shape[1]:d]
                factor = (1 + epsilon / math.sqrt(d)) ** 2 * d / size if d < size else 1.0
                if f == 0:
                    self.tested[f] += limit.size
                    part = (own * own).sum(1)[:, None] + (x[a:b] * x[a:b]).sum(1)[None, :] - 2 * own @ x[a:b].T
                    i, j = np.nonzero(~(part > factor * limit))
                    part = part[i, j]
                else:
                    self.tested[f] += len(i)
                    apart = own[i] - x[a + j]
                    part = part + np.einsum("ij,ij->i", apart, apart)
                    keep = ~(part > factor * limit[i, j])
                    i, j, part = i[keep], j[keep], part[keep]
                if not len(i):
                    break
        return i, a + j

    def search(self, q: np.ndarray, t: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, ...]:
        """(query, rep, score) of each query's k best nodes here, at least those that reach t."""
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        t = t.copy()
        step, a = max(SEED_ROWS, k), 0
        while a < len(self.x):
            b = min(a + step, len(self.x))
            i, j = self.survivors(q, t, a, b, epsilon)
            if len(i):
                i, rep, score = (np.concatenate(z) for z in zip(best, (i, self.rep[j], products(q[i], self.x[j]))))
                order = np.lexsort((rep, -score, i))
                i, rep, score = i[order], rep[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                full = place == k - 1
                t[i[full]] = np.maximum(t[i[full]], score[full])
                best = tuple(z[place < k] for z in (i, rep, score))
            a, step = b, 512
        return best


def found_rows(node: list, hits: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.concatenate([h[0] for h in hits]), pa.int64()),
                                       pa.array(np.concatenate([h[1] for h in hits]), pa.float64())], ["q", "rep", "score"])


def scan(k: int, epsilon: float):
    """mapInArrow over rows sorted by (dim, list, c, p, kind): a chunk's nodes, then the probes that visit it."""
    def work(batches):
        group, nodes, probes, chunk = None, [], [], None
        hits: list[tuple] = []
        names: list = []

        def flush():
            nonlocal chunk, nodes, probes
            if probes:
                if chunk is None and nodes:
                    chunk = Chunk(np.array([r for r, _ in nodes], np.int64), np.stack([np.frombuffer(v) for _, v in nodes]))
                if chunk is not None:
                    q = np.stack([np.frombuffer(v) for _, v, _ in probes])
                    i, rep, score = chunk.search(q, np.array([t for _, _, t in probes]), k, epsilon)
                    name = np.array([n for n, _, _ in probes], np.int64)
                    names.append(name[i])
                    hits.append((rep, score))
                probes = []

        for batch in batches:
            hits.clear()
            names.clear()
            for d, li, c, p, is_probe, rep, v, t in zip(*(x.to_pylist() for x in batch.columns)):
                if (d, li, c, p) != group:
                    flush()
                    group, nodes, chunk = (d, li, c, p), [], None
                if is_probe:
                    probes.append((rep, v, t))
                    if len(probes) == QUERIES:
                        flush()
                else:
                    nodes.append((rep, v))
            if names:
                yield found_rows(np.concatenate(names), hits)
        hits.clear()
        names.clear()
        flush()
        if names:
            yield found_rows(np.concatenate(names), hits)
    return work


def best_nodes(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best nodes; a task sends at most k rows of a query."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).drop("at")


def own_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, dim, same, v, norm) of the rows that take part: float64 bytes and their 128-bit digest."""
    def work(batches):
        for batch in batches:
            got, at = usable(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array([len(v) for v in got], pa.int32()),
                 pa.array([xxhash.xxh3_128_digest(v.tobytes()) for v in got], pa.binary()),
                 pa.array([v.tobytes() for v in got], pa.binary()),
                 pa.array([float(np.sqrt(v @ v)) for v in got], pa.float64())], ["id", "dim", "same", "v", "norm"])

    rows = (vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vec_col}`").alias("v"))
            .where(F.col("id").isNotNull()))
    return rows.mapInArrow(work, "id bigint, dim int, same binary, v binary, norm double")


def learn(nodes: DataFrame, k: int, list_rows: int, reach: float) -> dict[int, Index]:
    """An index for each of the most frequent lengths."""
    lengths = (nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("largest"))
               .orderBy(F.desc("n"), "dim").limit(LENGTHS).collect())
    out = {}
    for r in lengths:
        most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * r["dim"])))
        h = F.pmod(F.xxhash64("same"), F.lit(1 << 30))
        near = (nodes.where((F.col("dim") == r["dim"]) & (h < int(min(1.0, 1.5 * most / r["n"]) * (1 << 30))))
                .select(h.alias("h"), "same", "v").orderBy("h", "same").limit(most).collect())
        if near:
            out[r["dim"]] = Index(np.stack([np.frombuffer(x["v"]) for x in near]), r["n"], r["largest"], k, list_rows, reach)
    return out


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", queries: Column | None = None,
                       k: int = K, list_rows: int = LIST_ROWS, reach: float = REACH, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each query, by default of the rows whose id is
    divisible by ``EVERY``. ``queries`` is a condition on a column ``id``."""
    spark = vectors.sparkSession
    workers_find_package(spark)
    asked = F.col("id") % EVERY == 0 if queries is None else queries
    rows = stored(own_vectors(vectors, id_col, vec_col), "ann-vectors")
    by = Window.partitionBy("dim", "same").orderBy("id")
    nodes = (rows.withColumn("at", F.row_number().over(by)).where(F.col("at") <= k + 1).groupBy("dim", "same")
             .agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"), F.first("norm").alias("norm")))
    nodes = stored(nodes.withColumn("rep", F.col("ids")[0]), "ann-nodes")
    model = spark.sparkContext.broadcast(learn(nodes, k, list_rows, reach))

    def place(batches):
        for batch in batches:
            dims, out = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int32)
            held = batch.column(2).to_pylist()
            for d in np.unique(dims):
                if d in model.value:
                    at = np.flatnonzero(dims == d)
                    out[at] = model.value[d].list_of(np.stack([np.frombuffer(held[i]) for i in at]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), *batch.columns[1:]], ["dim", "list", "rep", "v"])

    listed = stored(nodes.select("dim", "rep", "v").mapInArrow(place, "dim int, list int, rep bigint, v binary"), "ann-lists")
    asking = stored(rows.where(asked).groupBy("dim", "same").agg(F.count(F.lit(1)).alias("times"), F.first("v").alias("v"))
                    .join(nodes.select("dim", "same", "rep"), ["dim", "same"])
                    .select("dim", "same", "times", F.col("rep").alias("q"), "v"), "ann-queries")

    def visit(batches):
        for batch in batches:
            dims, held = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for s in range(0, len(at), 1024):
                    part = at[s:s + 1024]
                    lists = (model.value[d].probed(np.stack([np.frombuffer(held[i]) for i in part]))
                             if d in model.value else np.zeros((len(part), 1), np.int64))
                    n = lists.shape[1]
                    take = pa.array(np.repeat(part, n))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part) * n, d, np.int32)), pa.array(lists.ravel().astype(np.int32)),
                         pa.array(np.tile(np.arange(n, dtype=np.int32), len(part))), batch.column(1).take(take)],
                        ["dim", "list", "turn", "q"])

    probes = stored(asking.select("dim", "q", "v").mapInArrow(visit, "dim int, list int, turn int, q bigint"), "ann-probes")
    sizes = listed.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("cs"))

    def searched(some: DataFrame, bounds: DataFrame | None) -> DataFrame:
        own = asking.select("q", "v") if bounds is None else asking.select("q", "v").join(bounds, "q", "left")
        t = F.lit(float("-inf")) if bounds is None else F.coalesce("t", F.lit(float("-inf")))
        counts = some.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("ps")).join(sizes, ["dim", "list"])
        left = (listed.join(counts, ["dim", "list"])
                .withColumn("c", F.pmod(F.xxhash64("rep"), F.col("cs")).cast("int"))
                .withColumn("p", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)))
                .select("dim", "list", "c", "p", F.lit(False).alias("probe"), "rep", "v", F.lit(0.0).alias("t")))
        right = (some.join(own.withColumn("t", t), "q").join(counts, ["dim", "list"])
                 .withColumn("p", F.pmod(F.xxhash64("q"), F.col("ps")).cast("int"))
                 .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cs") - 1)))
                 .select("dim", "list", "c", "p", F.lit(True).alias("probe"), F.col("q").alias("rep"), "v", "t"))
        group = ["dim", "list", "c", "p"]
        tiles = left.unionByName(right).repartition(*group).sortWithinPartitions(*group, "probe", "rep")
        return stored(tiles.mapInArrow(scan(k + 1, epsilon), "q bigint, rep bigint, score double"), "ann-found")

    first = searched(probes.where("turn = 0"), None)
    bounds = (best_nodes(first, k + 1).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("t"))
              .where(F.col("n") > k).select("q", "t"))
    rest = searched(probes.where("turn > 0"), bounds)
    best = best_nodes(first.unionByName(rest), k + 1)
    entries = (best.join(nodes.select("rep", "ids"), "rep")
               .select("q", F.col("score"), (F.col("rep") == F.col("q")).alias("own"), F.explode("ids").alias("id")))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id", F.desc("own"))
    entries = entries.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    answers = entries.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score", "own"))).alias("near"))
    answers = stored(asking.select("dim", "same", "times", "q").join(answers, "q"), "ann-answers")
    # A vector that many queries share is one key; such keys are few by count, so their answers are broadcast.
    total = asking.agg(F.sum("times")).first()[0] or 0
    hot, cold = (answers.where(c).select("dim", "same", "near") for c in
                 (F.col("times") * 4096 > total, F.col("times") * 4096 <= total))
    each = rows.where(asked).select("id", "dim", "same")
    both = (each.join(F.broadcast(hot), ["dim", "same"])
            .unionByName(each.join(F.broadcast(hot.select("dim", "same")), ["dim", "same"], "left_anti").join(cold, ["dim", "same"])))
    at = F.array_position(F.transform("near", lambda x: x["own"] & (x["id"] == F.col("id"))), True)
    without = F.when(at > 0, F.concat(F.slice("near", F.lit(1), (at - 1).cast("int")),
                                      F.slice("near", (at + 1).cast("int"), F.lit(k + 1)))).otherwise(F.col("near"))
    return (both.select(F.col("id").alias("query_id"), F.posexplode(F.slice(without, 1, k)).alias("rank", "x"))
            .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col),
                    F.col("x.score").alias("score")))

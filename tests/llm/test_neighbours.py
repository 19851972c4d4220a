import numpy as np
import pytest
from pyspark.sql import functions as F

from modlens.llm.common import documents
from modlens.llm.neighbours import Chunk, Index, nearest_neighbours, products, usable

SCHEMA = "vec_id bigint, embedding array<double>"


def good(k, v):
    return k is not None and v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v)


def brute(rows, k=20, every=20):
    held = [(key, v) for key, v in rows if good(key, v)]
    out = []
    for size in {len(v) for _, v in held}:
        ids = np.array([key for key, v in held if len(v) == size])
        x = np.array([v for _, v in held if len(v) == size], float)
        for a in np.flatnonzero(ids % every == 0):
            score = products(np.repeat(x[a:a + 1], len(x), 0), x)
            order = [b for b in np.lexsort((ids, -score)) if b != a][:k]
            out += [(int(ids[a]), i, int(ids[b]), float(score[b])) for i, b in enumerate(order, 1)]
    return sorted(out)


def result(df, **kw):
    return sorted(tuple(r) for r in nearest_neighbours(df, **kw).collect())


def test_one_list_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=24) * rng.choice([0.1, 1, 9])).tolist()) for i in range(300)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_lists(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(9, 24))
    rows = [(i, (centre[i % 9] + 0.3 * rng.normal(size=24)).tolist()) for i in range(400)]
    got, want = result(spark.createDataFrame(rows, SCHEMA), list_rows=40, reach=1.0), brute(rows)
    same = {(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}
    assert len(got) == len(want) and len(same) >= 0.99 * len(want)


def test_edge_cases(spark):
    v = [1.0, 2.0, 0.0, -1.0]
    rows = [(0, v), (0, v), (20, v), (40, [x * 2 for x in v]), (60, None), (80, [0.0] * 4), (100, [None, 1.0, 1.0, 1.0]),
            (120, [float("nan")] * 4), (140, [float("inf"), 0.0, 0.0, 0.0]), (160, []), (180, [1.0, 1.0]), (None, v),
            (200, [3.0]), (7, [-0.0, 0.0, 0.0, 1.0]), (8, [0.0, 0.0, 0.0, 1.0]), (9, [1.0, 0.5]), (11, [1e200, 1e200])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = result(df.withColumn("q", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("id", F.lit(3)))
    assert got == brute(rows)
    assert [r[:3] for r in got if r[0] == 200] == []


def test_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    common = rng.normal(size=16).round(2).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=16).round(2).tolist()) for i in range(600)]
    rows += [(600 + i, common) for i in range(30)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert result(spark.createDataFrame(rows, SCHEMA), k=3) == brute(rows, k=3)


def test_empty_and_unusable_tables(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(0, None), (20, [0.0])], SCHEMA)) == []


def test_queries_by_condition(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)]
    got = result(spark.createDataFrame(rows, SCHEMA), queries=F.col("id") < 3, k=2)
    assert [r[:3] for r in got] == [(1, 1, 29), (1, 2, 28), (2, 1, 29), (2, 2, 28)]


@pytest.mark.parametrize("list_rows", [1024, 64])
def test_recall_on_the_given_vectors(spark, list_rows):
    vectors = documents(spark, "/root/testdata/sf0.1", "embeddings")
    rows = vectors.select("vec_id", "embedding").collect()
    want = {r[:1] + r[2:3] for r in brute([(r[0], r[1]) for r in rows])}
    got = {r[:1] + r[2:3] for r in result(vectors, list_rows=list_rows)}
    assert len(got) == len(want) and len(got & want) >= 0.95 * len(want)


def test_most_candidates_are_abandoned_early_and_none_wrongly():
    rng = np.random.default_rng(8)
    centre = rng.normal(size=(40, 96))
    x = centre[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 96))
    q = x[:50]
    exact = np.sort(q @ x.T, axis=1)[:, ::-1]
    chunk = Chunk(np.arange(4000), x)
    i, _, score = chunk.search(q, exact[:, 20] - 1e-9, 21)
    assert np.allclose([score[i == a] for a in range(50)], exact[:, :21])
    assert chunk.tested[-1] < 0.1 * chunk.tested[0]


def test_probes_are_measured_on_the_sample():
    rng = np.random.default_rng(9)
    flat = Index(rng.normal(size=(2000, 32)), 8000, 1.0)
    tight = Index(rng.normal(size=(8, 32))[rng.integers(0, 8, 2000)] + 0.01 * rng.normal(size=(2000, 32)), 8000, 1.0)
    assert len(flat.centres) == len(tight.centres) == 8
    assert tight.probes < flat.probes <= 8


def test_usable_rows():
    import pyarrow as pa
    col = pa.array([[1.0, -0.0], None, [], [0.0, -0.0], [None, 1.0], [float("nan")], [2.0]], pa.list_(pa.float32()))
    got, at = usable(col.slice(0))
    assert at == [0, 6] and got[0].tolist() == [1.0, 0.0] and not np.signbit(got[0][1])
    assert usable(col.slice(5))[1] == [1]

import numpy as np
import pytest

from modlens.llm.common import documents
from modlens.llm.embeddings import MISS, near_duplicates, packed, radius, tables, tile_links, unpacked, within_radius

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    ok = [i for i, (k, v, lab) in enumerate(rows) if k is not None and v is not None and lab is not None and None not in v
          and np.isfinite(v).all() and np.any(v)]
    unit = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    near = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in ok}
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp = min(rows[j][0] for j in seen) if k is not None else None
        out.append((k, len(near.get(i, [])), comp, k == comp))
    return sorted(out, key=str)


def result(df, **kw):
    return sorted((tuple(r) for r in near_duplicates(df, **kw).select("vec_id", "n_links", "component_id", "kept").collect()),
                  key=str)


@pytest.mark.parametrize("tile", [1024, 8])
def test_against_brute_force(spark, tile):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 1.0)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 12) // 2))
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]  # exact copies
    assert result(spark.createDataFrame(rows, SCHEMA), tile=tile) == brute(rows)


def test_edge_cases(spark):
    v = [1.0] + [0.5] * 15
    rows = [(1, None, 0), (2, [0.0] * 16, 0), (3, [None] + [1.0] * 15, 0), (4, [float("nan")] + [1.0] * 15, 0),
            (5, [float("inf")] + [1.0] * 15, 0), (6, v, None), (7, v, 0), (8, v, 0), (8, v, 0), (9, [1.0, 2.0], 0),
            (None, v, 0), (10, v, 1), (11, [x * 3 for x in v], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = result(df.withColumn("id", df.vec_id).withColumn("copies", df.label))
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True),
                          (6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False), (8, 1, 7, False), (9, 0, 9, True),
                          (None, 0, None, True), (10, 1, 10, True), (11, 1, 10, False)], key=str)


def test_empty_and_unusable_tables(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(1, None, 0)], SCHEMA)) == [(1, 0, 1, True)]


def test_recall_on_the_given_vectors(spark):
    vectors = documents(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    want = dict(zip([r[0] for r in rows], near.sum(1).tolist()))
    got = {r["vec_id"]: r["n_links"] for r in near_duplicates(vectors).collect()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_more_vectors_get_longer_keys_and_more_tables():
    few, many = tables(64, 1000, 0.93), tables(64, 1 << 28, 0.93)
    assert len(few[0]) == 8 and len(few) == 8
    assert len(many[0]) == 20 and len(many) > len(few)


def test_tile_components():
    unit = np.eye(4)[[0, 0, 1, 1]]
    links, low = tile_links(unit, np.ones(4, int), np.zeros((4, 0), int), 0, np.zeros(4, int), 0.9)
    assert links.tolist() == [1, 1, 1, 1] and low.tolist() == [0, 0, 2, 2]


def test_vectors_of_every_length_link(spark):
    """Also those whose length has no learned quantiser; lengths never meet."""
    rng = np.random.default_rng(15)
    rows = []
    for size, n in ((16, 60), (8, 30), (3, 20), (1, 4)):
        centre = rng.normal(size=(4, size))
        rows += [(len(rows) + i, (centre[i % 4] + 0.05 * rng.normal(size=size)).astype(np.float32).tolist(), i % 2) for i in range(n)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_a_repeated_row_without_other_links_has_none(spark):
    rows = [(1, [1.0, 0.0, 2.0], 0), (1, [1.0, 0.0, 2.0], 0), (2, [0.0, 1.0, 0.0], 0)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == [(1, 0, 1, True), (1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("bits", [12, 16])
def test_recall_with_longer_keys(spark, monkeypatch, bits):
    """The keys of larger tables, measured on the given vectors."""
    from modlens.llm import embeddings as e

    made = e.tables
    monkeypatch.setattr(e, "tables", lambda b, n, cosine: made(b, 256 << bits, cosine))
    vectors = documents(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in vectors.collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    lab = np.array([r[2] for r in rows])
    links = ((x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])).sum() - len(rows)
    assert near_duplicates(vectors).groupBy().sum("n_links").first()[0] >= 0.9 * links


def test_codes_are_packed_and_unpacked():
    rng = np.random.default_rng(2)
    for bits in (1, 3, 8, 17, 64):
        b = rng.integers(0, 2, (50, bits)).astype(np.uint8)
        assert (unpacked(packed(b), bits) == b).all()


def test_radius_holds_all_but_few_pairs_at_the_threshold():
    """Measured with random hyperplanes, whose bits differ independently."""
    rng = np.random.default_rng(8)
    p = np.arccos(0.93) / np.pi
    for bits in (4, 16, 64):
        apart = (rng.random((200_000, bits)) < p).sum(1)
        assert (apart <= radius(bits, 0.93)).mean() >= 1 - 1.5 * MISS
    assert radius(64, 0.93) < 20 and radius(2, 0.93) == 2 and radius(64, 1.0) == 0


def test_screen_against_every_pair():
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (60, 64)).astype(np.uint8)
    bits[30:50] = bits[:20] ^ (rng.random((20, 64)) < 0.12)
    code, own, side = packed(bits), rng.integers(0, 3, (60, 2)), np.zeros(60, bool)
    side[:10] = True
    for s in (side, np.zeros(60, bool)):
        for table in (0, 1, 2):
            want = [any(i != j and (bits[i] != bits[j]).sum() <= 16 and (own[i, :table] != own[j, :table]).all()
                        and (not s.any() or s[i] != s[j]) for j in range(60)) for i in range(60)]
            assert within_radius(code, own, table, s, 16).tolist() == want and any(want) and not all(want)


def test_a_dense_group_of_different_vectors_is_whole(spark):
    """One group holds a third of all vectors, in buckets of many tiles; ids with several vectors besides."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.03 * rng.normal(size=16)).astype(np.float32).tolist(), 0) for i in range(150)]
    rows += [(150 + i, rng.normal(size=16).astype(np.float32).tolist(), i % 2) for i in range(300)]
    assert result(spark.createDataFrame(rows, SCHEMA), tile=16) == brute(rows)


@pytest.mark.parametrize("step, links", [(1e-12, 1), (-1e-12, 0)])
def test_double_vectors_are_compared_unrounded(spark, monkeypatch, step, links):
    """With one table of one bucket and every distance allowed, only the cosine decides."""
    from modlens.llm import embeddings as e

    monkeypatch.setattr(e, "tables", lambda bits, n, cosine: [np.arange(0)])
    monkeypatch.setattr(e, "radius", lambda bits, cosine: bits)
    b = [0.93 + step, float(np.sqrt(1 - (0.93 + step) ** 2)), 0.0]
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0], 0), (2, b, 0)], "vec_id bigint, embedding array<double>, label int")
    assert [r[1] for r in result(df)] == [links, links]

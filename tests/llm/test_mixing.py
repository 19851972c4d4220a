import re

import pytest

from modlens.llm.mixing import mix


def water(sizes, weights, share, most):
    """Targets by repeated resharing."""
    left, out, free = share * sum(sizes.values()), {}, dict(weights)
    while free:
        level = left / sum(free.values())
        full = [s for s in free if most * sizes[s] <= level * free[s]]
        if not full:
            return out | {s: level * w for s, w in free.items()}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            del free[s]
    return out


def check(rows, got):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in order}
    want = water(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s in order:
        biggest = max(size(r[1]) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= biggest / 2 + 1e-6
    return want


def test_targets_and_totals(docs_frame):
    rows = [(i, "w " * (i * 7 % 40), "en", f"s{i % 7}" if i % 11 else None) for i in range(600)]
    rows += [(1000 + i, "x " * 30, "en", "s0") for i in range(500)]
    df = docs_frame(rows, extra=True)
    got = mix(df).collect()
    assert len(got) == len(rows)
    check(rows, got)
    again = mix(df.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_pareto_order_is_by_odds(docs_frame):
    rows = [(i, "w w", "en", "a" if i % 4 else "b") for i in range(400)]
    got = mix(docs_frame(rows)).collect()
    for s in "ab":
        own = [r for r in got if r["source"] == s and r["pareto_rank"] is not None]
        more = [r["pareto_rank"] for r in own if r["taken"] > r["copies"] * r["size"]]
        rest = [r["pareto_rank"] for r in own if r["taken"] == r["copies"] * r["size"]]
        assert not more or not rest or max(more) <= min(rest)


def test_edge_cases(docs_frame, long_text):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y z", "en", None), (None, "x", "en", "b"), (5, "p q", "en", "b"),
            (5, "p q", "en", "b"), (6, long_text, "en", "c"), (7, " ", "en", "empty")]
    got = mix(docs_frame(rows)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["taken"] for r in got if r["doc_id"] in (1, 2, 7)} == {1: 0, 2: 0, 7: 0}
    assert mix(docs_frame([])).collect() == []


def test_rows_with_one_id_are_each_decided(docs_frame):
    rows = [(7, "w " * 10, "en", "a")] * 300 + [(None, "w " * 6, "en", "b")] * 200 + [(i, "v " * 9, "en", "c") for i in range(100)]
    rows += [(1000 + i, "x y z", "en", "ab"[i % 2]) for i in range(60)]
    got = mix(docs_frame(rows)).collect()
    assert len(got) == len(rows)
    check(rows, got)

import random

from modlens.llm.jaccard import bitmap, bitmap_distance, jaccard_components, width

import numpy as np


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                    same = len(sets[i] & sets[j])
                    if 100 * same >= 75 * (len(sets[i]) + len(sets[j]) - same) and label[i] != label[j]:
                        label[i] = label[j] = min(label[i], label[j])
                        changed = True
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), None if r[0] is None else min(ids) if sets[i] else r[0]))
    return sorted(out, key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()), key=str)


def mutated(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_against_brute_force_with_a_large_near_copy_group(docs_frame):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    other = [f"v{rng.randrange(500)}" for _ in range(60)]
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, mutated(rng, base, rng.randrange(5))) for i in range(60)]
    rows += [(100 + i, mutated(rng, other, rng.randrange(3))) for i in range(20)]
    rows += [(200 + i, " ".join(passage + [f"own{i}_{j}" for j in range(rng.randrange(4, 60))])) for i in range(30)]
    rows += [(300 + i, " ".join(base[:rng.randrange(50, 80)])) for i in range(15)]
    rows += [(400 + i, "a b c") for i in range(3)] + [(410, "A  B\tc"), (411, "a b"), (412, "c a b")]
    rng.shuffle(rows)
    assert result(docs_frame(rows)) == brute(rows)


def test_edge_cases(docs_frame, long_text):
    rows = [(5, None), (4, ""), (3, " \n\t "), (2, long_text), (1, long_text.upper()), (9, "same five words are here"),
            (8, "same five words are here"), (8, "same five words are here"), (None, "same five words are here")]
    got = result(docs_frame(rows, extra=True))
    n = [r for r in got if r[0] == 2][0][1]
    assert got == sorted([(5, 0, 5), (4, 0, 4), (3, 0, 3), (2, n, 1), (1, n, 1), (9, 1, 8), (8, 1, 8), (8, 1, 8),
                          (None, 1, None)], key=str)


def test_empty_table(docs_frame):
    assert result(docs_frame([])) == []


def test_bitmap_bounds_the_symmetric_difference():
    rng = np.random.default_rng(3)
    for n, m in ((5, 7), (100, 90), (700, 300)):
        pool = rng.integers(0, 1 << 62, n + m).astype(np.uint64)
        a, b = pool[:n], pool[n // 2:]
        true = len(set(a.tolist()) ^ set(b.tolist()))
        assert bitmap_distance(bitmap(a), bitmap(b)) <= true
        assert width(n) >= 64

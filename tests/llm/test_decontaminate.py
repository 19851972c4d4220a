import random

import numpy as np
import pytest

from modlens.llm.decontaminate import EDITS, WINDOW, Benchmark, align, candidates, contaminated, fold, search, without_contaminated

ITEM = ("Which of these old stone bridges was built first over the wide river near the northern market town, and by whom "
        "was its central arch repaired after the great flood of that unlucky winter?")


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, ITEM), (2, None), (3, ""), (4, "too short"), (5, "A completely different question about the colour of several seas at noon.")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def pairs(df):
    return sorted(((r[0], r[1]) for r in df.select("doc_id", "item_id").collect()), key=str)


def edited(text, n, seed=1):
    r, out = random.Random(seed), list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        out[i:i + 1] = r.choice([[], ["q"], [out[i], "z"]])
    return "".join(out)


def test_finds_copies_and_leaves_clean_texts(docs_frame, items):
    filler = "Some ordinary words about nothing in particular stand here and go on for a while. "
    rows = [(1, filler + ITEM + " " + filler), (2, filler * 3), (3, filler + edited(ITEM, 5) + filler), (4, filler + ITEM[:110]),
            (5, filler + ITEM.upper().replace(" ", " *** ")), (6, filler + ITEM[:50] + filler),
            (7, "é" * 50 + "\n" + ITEM[60:] + "\n")]
    found = contaminated(docs_frame(rows, extra=True), items)
    assert pairs(found) == [(1, 1), (3, 1), (4, 1), (5, 1), (7, 1)]
    r = found.where("doc_id = 1").first()
    assert rows[0][1][r["start"]:r["end"]].strip(" ?") == ITEM.strip(" ?") and r["edits"] == 0
    clean = without_contaminated(docs_frame(rows), items)
    assert sorted(x["doc_id"] for x in clean.collect()) == [2, 6]


def test_edge_cases(docs_frame, items, spark, long_text):
    half = len(long_text) // 2
    rows = [(1, None), (2, ""), (3, long_text[:half] + " " + ITEM + " " + long_text[half:]), (4, ITEM), (4, ITEM), (None, ITEM)]
    assert sorted(pairs(contaminated(docs_frame(rows), items)), key=str) == [(3, 1), (4, 1), (4, 1), (None, 1)]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated(docs_frame(rows), none).collect() == []
    assert without_contaminated(docs_frame(rows), none).count() == len(rows)
    assert contaminated(docs_frame([]), items).collect() == []
    # a copy whose halves stand in two rows is in neither
    assert pairs(contaminated(docs_frame([(1, ITEM[:60]), (2, ITEM[60:120])]), items)) == []


def distance(window, text):
    """Fewest edits of the window against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for c in window:
        new = np.empty_like(row)
        new[0] = row[0] + 1
        for j in range(1, len(text) + 1):
            new[j] = min(row[j - 1] + (text[j - 1] != c), row[j] + 1, new[j - 1] + 1)
        row = new
    return row.min()


def test_alignment_equals_a_full_one():
    b = Benchmark([(1, ITEM.encode())])
    window = bytes(b.text[:WINDOW])
    for n in range(0, 12, 2):
        text = ("before it " + edited(ITEM, n, seed=n) + " after it").encode()
        x, _ = fold(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        got = {u: e for _, u, e, _, _ in align(b, x, candidates(b, x)[0])} if candidates(b, x)[0] else {}
        want = distance(window, bytes(x[x > 0]))
        if want <= WINDOW * EDITS // 100:
            assert got[0] == want
        else:
            assert 0 not in got


def test_a_copy_with_edits_is_found_at_every_offset(docs_frame, spark):
    """80 bytes with three edits, cut from any place of an item."""
    items = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    rows = [(i, "Well then. " + edited(ITEM[i:i + 82], 3, seed=i) + " And so on.") for i in range(len(ITEM) - 82)]
    assert {p[0] for p in pairs(contaminated(docs_frame(rows), items))} == {i for i, _ in rows}


def test_short_items_and_items_without_an_id(docs_frame, spark):
    items = spark.createDataFrame([(None, ITEM), (2, "Who built it?"), (3, "你知道这是什么"), (4, "the"), (5, "  ?! "), (6, "Who built it?")],
                                  "item_id bigint, text string")
    rows = [(10, "First: " + ITEM), (11, "I ask: who BUILT it, then"), (12, "whoever who built its"), (13, "the"), (14, "the end"),
            (15, " The! "), (16, "x 你知道这是什么 y"), (17, "?!"), (18, ""), (19, None), (20, "who built it")]
    want = sorted([(10, None), (11, 2), (11, 6), (13, 4), (15, 4), (16, 3), (20, 2), (20, 6)], key=str)
    assert pairs(contaminated(docs_frame(rows), items)) == want
    kept = {r["doc_id"] for r in without_contaminated(docs_frame(rows), items).collect()}
    assert kept == {12, 14, 17, 18, 19}


def test_candidate_search_against_brute_force():
    """Every pair that a full alignment finds within its budget is found."""
    r = random.Random(9)
    b = Benchmark([(1, ITEM.encode())])
    item = fold(np.frombuffer(ITEM.encode(), np.uint8), np.array([0, len(ITEM.encode())]))[0].tobytes().rstrip(b"\0")
    for seed in range(60):
        at, size = r.randrange(0, len(ITEM) - 90), r.randrange(60, 100)
        text = "Some words before it " + edited(ITEM[at:at + size], r.randrange(0, 14), seed) + " and more after"
        raw = np.frombuffer(text.encode(), np.uint8)
        found = bool(list(search(b, raw, np.array([0, len(raw)]))))
        x = fold(raw, np.array([0, len(raw)]))[0].tobytes().rstrip(b"\0")
        want = any(distance(item[u:u + WINDOW], x) <= WINDOW * EDITS // 100 for u in range(len(item) - WINDOW + 1))
        assert found == want, seed

import random

from modlens.llm.spans import without_repeated_runs


def run(df):
    return {(r["doc_id"], i): r for i, r in enumerate(without_repeated_runs(df).orderBy("doc_id", "text").collect())}


def sentence(r, n):
    return " ".join(f"w{r.randrange(10 ** 6)}" for _ in range(n)).capitalize() + "."


def test_repeats_go_and_first_places_stay(docs_frame):
    r = random.Random(1)
    passage = " ".join(sentence(r, 9) for _ in range(7))
    own = [" ".join(sentence(r, 8) for _ in range(4)) for _ in range(4)]
    rows = [(10, own[0] + " " + passage + " " + own[1]), (20, own[2] + " " + passage), (30, own[3])]
    got = {k[0]: v for k, v in run(docs_frame(rows, extra=True)).items()}
    assert got[10]["text"] == rows[0][1] and got[30]["text"] == rows[2][1]
    assert got[20]["text"].strip() == own[2] and got[20]["n_removed"] == 7
    s, e = map(int, got[20]["removed"].split(":"))
    assert rows[1][1][s:e] == passage


def test_a_passage_without_full_stops_inside_other_sentences(docs_frame):
    r = random.Random(2)
    passage = " ".join(f"p{r.randrange(10 ** 6)}" for _ in range(80))
    rows = [(i, sentence(r, 30)[:-1] + " " + passage + " " + sentence(r, 30)) for i in range(3)]
    got = {k[0]: v for k, v in run(docs_frame(rows)).items()}
    middle = " ".join(passage.split()[20:60])
    assert middle in got[0]["text"] and middle not in got[1]["text"] and middle not in got[2]["text"]


def test_brute_force_on_sentences(docs_frame):
    """Short sentences only, so sentences are what split() gives."""
    r = random.Random(3)
    pool = [sentence(r, r.randrange(3, 9)) for _ in range(12)]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for i in range(25)]
    first, runs = {}, {}
    for d, t in rows:
        s = [x.strip() + "." for x in t.split(".") if x.strip()]
        for i in range(len(s) - 2):
            key = " ".join(s[i:i + 3]).lower()
            if len(key.split()) >= 8:
                first.setdefault(key, (d, i))
                runs.setdefault(d, []).append((i, key))
    want = {d: {j for i, key in runs.get(d, []) if first[key] != (d, i) for j in range(i, i + 3)} for d, _ in rows}
    got = {k[0]: v["n_removed"] for k, v in run(docs_frame(rows)).items()}
    assert got == {d: len(x) for d, x in want.items()}


def test_edge_cases(docs_frame, long_text):
    p = "one two three four. five six seven eight. nine ten eleven twelve."
    rows = [(1, None), (2, ""), (3, p), (3, p), (4, " \n" + p), (None, p), (5, "é. ü? ö!"), (6, long_text), (8, p + " " + p)]
    got = list(run(docs_frame(rows)).values())
    text = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in got if r["doc_id"] != 6), key=str)
    assert text == sorted([(1, None, 0), (2, "", 0), (3, p, 0), (3, p, 0), (4, " \n", 3), (None, p, 0), (5, "é. ü? ö!", 0),
                           (8, "", 6)], key=str)
    assert [r["n_removed"] > 0 for r in got if r["doc_id"] == 6] == [True]
    assert run(docs_frame([])) == {}


def test_texts_under_one_id_are_told_apart(docs_frame):
    p = "one two three four. five six seven eight. nine ten eleven twelve."
    rows = [(1, p), (3, "first own words here. " + p), (3, "other words of another text. and some more. " + p)]
    assert sorted(r["text"] for r in run(docs_frame(rows)).values()) == sorted(
        [p, "first own words here. ", "other words of another text. and some more. "])


def test_short_lines_and_repeated_words_make_runs(docs_frame):
    r = random.Random(4)
    lines = "\n".join(f"v{r.randrange(10 ** 6)}" for _ in range(60))
    tail = "one two three four five six. a. b. seven eight nine ten eleven twelve thirteen. x. y. z."
    rows = [(1, lines), (2, lines), (3, "buy " * 60), (4, "buy " * 60), (5, "spam " * 60), (6, "spam " * 60), (7, tail), (8, tail)]
    got = {k[0]: v for k, v in run(docs_frame(rows)).items()}
    assert got[1]["text"] == lines and got[7]["text"] == tail
    assert all(got[i]["text"] == "" and got[i]["n_removed"] == got[i]["n_sentences"] for i in (2, 4, 6, 8))


def test_a_passage_glued_at_both_edges(docs_frame):
    r = random.Random(5)
    for _ in range(5):
        passage = " ".join(sentence(r, 15) for _ in range(4))[:-1]
        rows = [(i, sentence(r, 6)[:-1] + " " + passage + " " + sentence(r, 6)) for i in range(2)]
        got = {k[0]: v for k, v in run(docs_frame(rows)).items()}
        assert got[0]["text"] == rows[0][1] and " ".join(passage.split()[20:40]) not in got[1]["text"]


def test_two_texts_of_one_id_with_equal_crc32(docs_frame):
    """A long text and a short one under one id, whose crc32 are equal, are documents of their own."""
    import zlib

    r = random.Random(7)
    passage = " ".join(sentence(r, 9) for _ in range(7))
    long = " ".join(sentence(r, 9) for _ in range(5)) + " " + passage
    target, stem, short = zlib.crc32(long.encode()), b"short ", None
    state = zlib.crc32(stem)
    # four bytes that lead from one crc state to another, by the table's last bytes
    table = [zlib.crc32(bytes([i])) ^ 0xFF000000 ^ zlib.crc32(b"\0") ^ 0xFF000000 for i in range(256)]
    table = []
    for i in range(256):
        c = i
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    want, picks = target ^ 0xFFFFFFFF, []
    for _ in range(4):
        i = next(i for i in range(256) if table[i] >> 24 == want >> 24)
        picks.insert(0, i)
        want = (want ^ table[i]) << 8 & 0xFFFFFFFF
    c, out = state ^ 0xFFFFFFFF, b""
    for i in picks:
        out += bytes([(c ^ i) & 0xFF])
        c = c >> 8 ^ table[i]
    assert zlib.crc32(stem + out) == target
    # a text must be UTF-8: try stems until the four bytes are ASCII
    n = 0
    while short is None:
        stem = f"short {n} ".encode()
        c, out = zlib.crc32(stem) ^ 0xFFFFFFFF, b""
        for i in picks:
            out += bytes([(c ^ i) & 0xFF])
            c = c >> 8 ^ table[i]
        if all(33 <= x < 127 for x in out):
            short = (stem + out).decode()
        n += 1
    assert zlib.crc32(short.encode()) == target
    got = without_repeated_runs(docs_frame([(1, passage), (5, long), (5, short)])).collect()
    texts = {(r["doc_id"], r["n_removed"]): r["text"] for r in got}
    assert texts[(5, 0)] == short and texts[(1, 0)] == passage
    assert texts[(5, 7)].strip() == long[:-len(passage)].strip()


def test_hot_runs_are_dealt_apart(docs_frame, monkeypatch):
    from modlens.llm import spans

    r = random.Random(8)
    common = " ".join(sentence(r, 9) for _ in range(4))
    rows = [(i, sentence(r, 9) + " " + (common if i % 2 else sentence(r, 12)) + " " + sentence(r, 9)) for i in range(40)]
    want = {k: v["text"] for k, v in run(docs_frame(rows)).items()}
    for share in (1, 1 << 40):  # no run is hot, every run is
        monkeypatch.setattr(spans, "HOT_SHARE", share)
        assert {k: v["text"] for k, v in run(docs_frame(rows)).items()} == want


def test_places_of_frequent_runs_are_one_row_a_text(docs_frame, monkeypatch):
    """Copies of a text: what is written and joined follows the texts, not the places of their runs."""
    from modlens.llm import spans

    tables, stored = {}, spans.stored
    monkeypatch.setattr(spans, "stored", lambda df, name: tables.setdefault(name, stored(df, name)))
    r = random.Random(9)
    text = " ".join(sentence(r, 9) for _ in range(40))
    rows = [(i, text) for i in range(50)] + [(3, text), (60, sentence(r, 9))]
    got = run(docs_frame(rows))
    assert sorted(k[0] for k, v in got.items() if v["n_removed"]) == [*range(1, 4), 3, *range(4, 50)]
    assert all(v["text"] == "" for v in got.values() if v["n_removed"]) and got[(0, 0)]["text"] == text
    assert tables["runs-places"].count() == 51

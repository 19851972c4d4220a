from pyspark.sql import functions as F

from modlens.llm.common import documents
from modlens.llm.langid import codes, counted, gram_counts, grams, held_out, predict, profiles, ranked

SF01 = "/root/testdata/sf0.01"


def brute_ranks(text, top):
    low = "".join(c.lower() if c.isalpha() else " " for c in text)
    words = low.split()
    n = {}
    padded = " " + " ".join(words) + " "
    for k in (1, 2, 3):
        for i in range(len(padded) - k + 1):
            g = padded[i:i + k]
            if g.strip() == "" or " " in g[1:-1]:
                continue
            if k == 3 and g[1] == " ":
                continue
            if k == 3 and g[0] == " " and g[2] == " ":
                continue
            n[g] = n.get(g, 0) + 1
    return n


def test_counts_equal_a_plain_count():
    texts = ["Ab, ab!  c", "", "été ÉTÉ", "x"]
    for first, keys, n in gram_counts(texts):
        for row in range(len(texts)):
            mine = {}
            for k, c in zip(keys.tolist(), n.tolist()):
                if k >> 48 == row:
                    g = "".join(chr((k >> s) & 0xFFFF) for s in (32, 16, 0) if (k >> s) & 0xFFFF).replace("\x01", " ")
                    mine[g] = c
            assert mine == brute_ranks(texts[row], 10), texts[row]


def test_ranks_are_by_count_then_code():
    keys, n = counted(grams(*codes(["aaa bb"])))
    row, gram, rank = ranked(keys, n, 3)
    assert rank.tolist() == [0, 1, 2] and gram[0] == ord("a")


def test_held_out_accuracy(spark):
    docs = documents(spark, SF01)
    marked = docs.withColumn("held_out", held_out(F.col("doc_id")))
    out = predict(marked, profiles(marked.where("not held_out"))).where("held_out")
    right, total = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert total > 150 and right / total > 0.98


def test_edge_cases(docs_frame, long_text):
    learn = docs_frame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None)])
    known = profiles(learn)
    assert list(known) == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the dog and the cat"), (4, "the dog and the cat"), (None, "die katze und"),
            (6, long_text)]
    got = predict(docs_frame(rows, extra=True), known).select("doc_id", "lang_pred", "score").collect()
    by = sorted(((r[0] or 0, r[1]) for r in got))
    assert by == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (6, "en")]
    assert all(0 <= r["score"] <= 1 for r in got)


def test_nothing_to_learn_from_and_empty_tables(docs_frame):
    assert profiles(docs_frame([])) == {}
    assert [r["lang_pred"] for r in predict(docs_frame([(1, "text")]), {}).collect()] == ["und"]
    assert predict(docs_frame([]), {"en": [97]}).collect() == []

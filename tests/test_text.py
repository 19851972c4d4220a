"""Fixed-length encoding and vocabulary."""

from pyspark.sql import functions as F

from modlens.operators import text as txt

from conftest import SF001


def test_encode_shape_and_mask(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    vocab = txt.vocabulary(docs)
    enc = txt.encode_fixed(docs, vocab, "doc_id", "text", max_len=32)
    lens = docs.select("doc_id", F.size(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"),
                                                 lambda x: x != "")).alias("n"))
    rows = enc.join(lens, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert len(r["input_ids"]) == 32 and len(r["attention_mask"]) == 32
        assert sum(r["attention_mask"]) == min(r["n"] + 2, 32)
        assert r["input_ids"][0] == txt.BOS
        assert txt.EOS in r["input_ids"]
        assert all(i >= txt.FIRST_WORD_ID for i in r["input_ids"][1:sum(r["attention_mask"]) - 1])


def test_vocab_ids_follow_frequency(spark):
    df = spark.createDataFrame([("b a a",), ("c b a",)], "text string")
    got = {r["token"]: (r["n"], r["id"]) for r in txt.vocabulary(df).collect()}
    assert got == {"a": (3, 4), "b": (2, 5), "c": (1, 6)}


def test_empty_text_encodes_to_markers(spark):
    df = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    vocab = spark.createDataFrame([("x", 1, 4)], "token string, n long, id long")
    got = {r["doc_id"]: r["input_ids"][:3] for r in txt.encode_fixed(df, vocab, max_len=4).collect()}
    assert got == {1: [0, 2, 1], 2: [0, 2, 1]}


def test_truncation_profile(spark):
    df = spark.createDataFrame([("a",), ("a b c",), ("a b c d e",)], "text string")
    r = txt.truncation_profile(df, max_len=5).first()
    assert (r["n_docs"], r["p50"], r["max_tokens"]) == (3, 3, 5)
    assert abs(r["share_truncated"] - 1 / 3) < 1e-12


def test_head_and_tail_vocab_paths_agree(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    vocab = txt.vocabulary(docs)
    a = txt.encode_fixed(docs, vocab, "doc_id", "text", max_len=64)
    b = txt.encode_fixed(docs, vocab, "doc_id", "text", max_len=64, head_size=3)
    assert a.count() == docs.count() and a.exceptAll(b).count() == 0


def test_repeated_keys_are_rows_of_their_own(spark):
    rows = [(1, "a b"), (1, "c d e f g"), (2, "a"), (2, "a"), (3, None), (3, ""), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocab = txt.vocabulary(df)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    for head in (100, 2):  # with and without rarer words than the head holds
        got = [(r["doc_id"], r["input_ids"], r["attention_mask"]) for r in
               txt.encode_fixed(df, vocab, max_len=6, head_size=head).collect()]
        want = []
        for key, text in rows:
            seq = [0, *[ids[w] for w in (text or "").split()][:4], 2]
            want.append((key, seq + [1] * (6 - len(seq)), [1] * len(seq) + [0] * (6 - len(seq))))
        assert sorted(got, key=str) == sorted(want, key=str)


def test_hashed_ids(spark):
    import hashlib

    df = spark.createDataFrame([(1, "b A b"), (1, "x y z w v u"), (2, None), (3, "!!")], "doc_id bigint, text string")
    number = lambda w: 4 + int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 50
    got = sorted((r["doc_id"], r["input_ids"], sum(r["attention_mask"])) for r in txt.encode_hashed(df, max_len=6, buckets=50).collect())
    assert got == sorted([(1, [0, number("b"), number("a"), number("b"), 2, 1], 5),
                          (1, [0, *map(number, "xyzw"), 2], 6), (2, [0, 2, 1, 1, 1, 1], 2), (3, [0, 2, 1, 1, 1, 1], 2)])


def test_hashed_ids_on_a_stream_equal_a_table(spark):
    from modlens.session import scratch_path

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    path, out = scratch_path(spark, "stream-docs"), scratch_path(spark, "stream-ids")
    docs.repartition(3).write.parquet(path)
    stream = txt.encode_hashed(spark.readStream.schema(docs.schema).parquet(path), max_len=32)
    assert stream.isStreaming
    query = (stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "stream-ckpt"))
             .trigger(availableNow=True).start(out))
    query.awaitTermination()
    rows = lambda d: sorted((r["doc_id"], r["input_ids"]) for r in d.collect())
    assert rows(spark.read.parquet(out)) == rows(txt.encode_hashed(docs, max_len=32))


def test_frequent_words_are_encoded_without_a_shuffle(spark):
    df = spark.createDataFrame([(i, "a b c " * 5) for i in range(20)], "doc_id bigint, text string").repartition(20)
    vocab = txt.vocabulary(df)
    plan = txt.encode_fixed(df.select("doc_id", "text"), vocab, max_len=9)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan and "Join" not in plan


def test_first_tokens_are_those_of_the_whole_text(spark):
    from modlens.functions.columns import first_tokens, tokens

    texts = ["", " ", None, "!!a--b  c", "a", "a b c d e f", ". x.y z w,", "É1 ß2;\nİ3 d e", "abc", "...", "a. b. "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (0, 1, 2, 3, 5, 9):
        got = df.select(first_tokens("t", n).alias("a"), F.slice(tokens("t"), 1, n).alias("b")).collect()
        assert [r.a for r in got] == [r.b for r in got], n


def test_words_of_neither_head_nor_rest_are_unknown(spark):
    df = spark.createDataFrame([(1, "new a z b"), (None, "a new"), (None, "a new"), (2, "a b")], "doc_id bigint, text string")
    vocab = spark.createDataFrame([("a", 3, 4), ("b", 2, 5), ("z", 1, 6)], "token string, n bigint, id bigint")
    for head in (100, 1):
        got = [(r["doc_id"], r["input_ids"]) for r in txt.encode_fixed(df, vocab, max_len=7, head_size=head).collect()]
        assert sorted(got, key=str) == sorted([(1, [0, 3, 4, 6, 5, 2, 1]), (None, [0, 4, 3, 2, 1, 1, 1]), (None, [0, 4, 3, 2, 1, 1, 1]),
                                               (2, [0, 4, 5, 2, 1, 1, 1])], key=str)

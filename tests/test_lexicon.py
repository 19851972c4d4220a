"""Lexicon match (inline and join forms), channel search, URL path filter."""

from pyspark.sql import functions as F

from modlens.operators import lexicon as lx
from modlens.plans import inputs as I
from modlens.sources import files
from modlens.session import scratch_path

from conftest import SF01


def test_inline_equals_join(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    cols = ["doc_id", "hits", F.array_join("matched_terms", " "), F.array_join("categories", " ")]
    a = lx.match_lexicon(docs, I.LEXICON_ROWS, method="inline").select(*cols)
    b = lx.match_lexicon(docs, I.lexicon(spark), method="join").select(*cols)
    assert a.count() == b.count() == docs.count()
    assert a.exceptAll(b).count() == 0


def test_multiword_terms_and_language(spark):
    df = spark.createDataFrame([(1, "You are a Total Loser, loser!", "en"),
                                (2, "total loser", "fr"),
                                (3, "nothing here", "en")], "doc_id long, text string, lang string")
    lex = [("total loser", "insult", "en"), ("loser", "insult", "en"), ("nul", "insult", "fr")]
    for method in ("inline", "join"):
        got = {r["doc_id"]: (r["hits"], r["matched_terms"]) for r in
               lx.match_lexicon(df, lex, method=method).collect()}
        assert got == {1: (3, ["loser", "total loser"]), 2: (0, []), 3: (0, [])}, method


def test_score_threshold_inclusive(spark):
    df = spark.createDataFrame([(1, "idiot", "en"), (2, "fine", "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["toxicity"], r["pred"]) for r in lx.lexicon_score(df, I.LEXICON_ROWS).collect()}
    assert got == {1: (0.5, 1), 2: (0.0, 0)}


def test_channel_search_with_paths(spark):
    df = spark.createDataFrame([
        (1, "what an idiot", "en", "Board", "https://www.board.example/garden/abc"),
        (2, "what an idiot", "en", "Board", "https://board.example/kitchen/abc"),
        (3, "what an idiot", "en", "Wall", "https://twitter.com/x"),
        (4, "what an idiot", "en", "Forum", "https://forum.example/x"),
        (5, "all good", "en", "Wall", "https://twitter.com/y"),
    ], "doc_id long, text string, lang string, source string, url string")
    spec_q = {"en": ["idiot"]}
    spec_p = {"Wall": [], "Board": ["board.example/garden", "board.example/tools"]}
    got = sorted(r["doc_id"] for r in lx.channel_search(df, spec_q, spec_p, url_col="url").collect())
    assert got == [1, 3]


def test_url_path_prefix(spark):
    df = spark.createDataFrame([("http://a.example.com/fr/825?page=2",), ("https://b.example.net/en/25#top",),
                                ("https://c.example.org/de/1",), ("no-scheme.org/en/x",)], "url string")
    got = sorted(r["url"] for r in lx.path_filter(df, ["/en/", "/fr/"]).collect())
    assert got == ["http://a.example.com/fr/825?page=2", "https://b.example.net/en/25#top", "no-scheme.org/en/x"]


def test_read_term_list(spark, tmp_path_factory):
    path = scratch_path(spark, "terms")
    spark.createDataFrame([("Idiot",), ("",), ("  total   Loser ",), ("idiot",)], "value string") \
        .coalesce(1).write.text(path)
    lex = files.read_term_list(spark, path, lang="en", category="insult")
    assert sorted(r["term"] for r in lex.collect()) == ["idiot", "total loser"]


def test_large_lexicon_splits_hot_terms(spark, monkeypatch):
    """Beyond the broadcast size: the same rows as the inline form, whether terms are hot or not."""
    rows = [(i % 7 if i % 5 else None, "en" if i % 3 else "fr", "the cat the dog " + "the " * (i % 9) + f"word{i % 4} of the day")
            for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(5)
    terms = [("the", "hot", "en"), ("of the", "pair", "en"), ("word1", "rare", "en"), ("word2", "rare", "fr"), ("absent", "x", "fr")]
    lexicon = lx.lexicon_frame(spark, terms)
    result = lambda d: sorted((tuple(r) for r in d.select("doc_id", "lang", "text", "hits", "matched_terms", "categories").collect()), key=str)
    want = result(lx.match_lexicon(df, terms, method="inline"))
    assert result(lx.match_lexicon(df, lexicon, method="join")) == want
    for share in (1, 4096):  # no term is hot, every term is
        monkeypatch.setattr(lx, "HOT_SHARE", share)
        assert result(lx.match_lexicon(df, lexicon, method="join", broadcast_terms=0)) == want

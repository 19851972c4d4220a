"""Edge data in sources, columns and lexicons."""

import json

import pytest
from pyspark.sql import functions as F

from modlens.functions.columns import fill_cast
from modlens.operators import aggregate as agg
from modlens.operators import lexicon as lx
from modlens.operators import partitioning
from modlens.session import scratch_path
from modlens.sources import files


def test_csv_and_tsv_keep_blanks(spark):
    rows = [(1, "  lead"), (2, "trail  "), (3, "\ttab\t"), (4, "\n"), (5, 'a "b", c'), (6, " "), (7, None)]
    df = spark.createDataFrame(rows, "k bigint, text string")
    for write, read in ((files.write_csv, files.read_csv), (files.write_tsv_report, files.read_tsv)):
        back = read(spark, write(df, scratch_path(spark, "blanks")), "k bigint, text string")
        assert sorted(map(tuple, back.collect())) == rows


def test_json_document_and_bad_json(spark):
    path = scratch_path(spark, "json")
    doc = json.dumps({"name": "x", "n": [1, 2]}, indent=4)
    spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(path)
    schema = "name string, n array<int>"
    assert [tuple(r) for r in files.read_json(spark, path, schema, multi_line=True).collect()] == [("x", [1, 2])]
    with pytest.raises(Exception):
        files.read_json(spark, path, schema).collect()


def test_fill_cast_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.select(fill_cast("x", "int")).collect()] == [1, 0, 0]


def test_punctuated_terms_match_in_both_forms(spark):
    df = spark.createDataFrame([(1, "Those self-haters and f**k", "en"), (2, "self", "en")], "doc_id bigint, text string, lang string")
    terms = [("self-haters", "a", "en"), ("F**K", "b", "en"), ("***", "c", "en")]
    for method in ("inline", "join"):
        got = {r["doc_id"]: (r["hits"], r["matched_terms"]) for r in lx.match_lexicon(df, terms, method=method).collect()}
        assert got == {1: (2, ["f k", "self haters"]), 2: (0, [])}
    assert lx.channel_search(df, {"en": ["self-haters"]}).count() == 1
    path = scratch_path(spark, "terms")
    spark.createDataFrame([("Self-Haters",), ("",), (" ** ",)], "value string").write.text(path)
    assert [r["term"] for r in files.read_term_list(spark, path).collect()] == ["self haters"]


def test_repeated_keys_keep_their_own_hits(spark):
    df = spark.createDataFrame([(1, "idiot", "en"), (1, "idiot idiot", "en"), (1, "idiot", "en"), (None, "idiot", "en"), (2, None, "en")],
                               "doc_id bigint, text string, lang string")
    for method in ("inline", "join"):
        got = sorted(r["hits"] for r in lx.match_lexicon(df, [("idiot", "x", "en")], method=method).collect())
        assert got == [0, 1, 1, 1, 2], method


def test_spread_starts_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    partitioning.spread(df, "k")
    assert list(tracker.getJobIdsForGroup("spread")) == []
    spark.sparkContext.setJobGroup("", "")


def test_profile_counts_exact_and_approximate(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "x string")
    assert tuple(agg.profile_counts(df, "x").first()) == (5, 3)
    assert tuple(agg.profile_counts(df, "x", approx=True).first()) == (5, 3)
    assert tuple(agg.profile_counts(df.limit(0), "x").first()) == (0, 0)


def test_exact_density_is_near_the_binned_one(spark):
    df = spark.range(2000).select((F.col("id") % 97 + F.rand(1)).alias("v"))
    exact = [r["density"] for r in agg.kde_exact(df, "v").orderBy("grid").collect()]
    binned = [r["density"] for r in agg.kde_grid(df, "v").orderBy("grid").collect()]
    assert max(abs(a - b) for a, b in zip(exact, binned)) < 1e-3 * max(exact)


def test_given_categories_have_no_bound(spark):
    df = spark.createDataFrame([(1, ["c1", "c1500"])], "k bigint, cats array<string>")
    wide = agg.multilabel_onehot(df, "k", "cats", categories=[f"c{i}" for i in range(1501)])
    assert len(wide.columns) == 1502 and wide.select("c1", "c2", "c1500").first() == (1, 0, 1)

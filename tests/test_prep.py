"""Dataset preparation: annotation cleaning, roll-up, projections, CSV round trip."""

import math

import pytest
from pyspark.sql import functions as F

from modlens.operators import aggregate as agg
from modlens.operators import prep
from modlens.session import scratch_path
from modlens.sources import files


def _annotations(spark):
    rows = [
        (1, "t1", "1", "0.7", "A b a"),
        (2, "t2", "none", "none", "  x  y "),
        (3, "t3", "", "", ""),
        (4, "t4", None, None, None),
        (5, "t5", "0", "NaN", "B"),
    ]
    return spark.createDataFrame(rows, "doc_id long, Text string, Label string, Toxicity string, Categories string")


def test_clean_annotations(spark):
    out = prep.clean_annotations(_annotations(spark), "doc_id")
    assert out.columns == ["doc_id", "text", "label", "toxicity", "a", "b", "x", "y"]
    got = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert got[1]["a"] == 2 and got[1]["b"] == 1 and got[1]["label"] == 1 and got[1]["toxicity"] == 0.7
    assert got[2]["x"] == got[2]["y"] == 1 and got[2]["label"] == 0 and got[2]["toxicity"] == 0.0
    for k in (3, 4):
        assert [got[k][c] for c in "abxy"] == [0, 0, 0, 0]
    assert got[5]["b"] == 1 and got[5]["toxicity"] == 0.0


def test_category_colliding_with_column_raises(spark):
    df = _annotations(spark).withColumn("Categories", F.lit("text"))
    with pytest.raises(ValueError):
        prep.clean_annotations(df, "doc_id")


def test_strict_label_reproduces_string_rule(spark):
    out = prep.clean_annotations(_annotations(spark), "doc_id", strict_label=True)
    assert {r["label"] for r in out.collect()} == {0}


def test_annotator_rollup(spark):
    rows = [(1, 10, None, 0.2), (1, 11, "first", float("nan")), (1, 12, "second", 0.6),
            (2, 20, "only", None), (None, 30, "dropped", 1.0)]
    df = spark.createDataFrame(rows, "cid long, ord long, text string, score double")
    got = {r["cid"]: (r["score"], r["text"]) for r in agg.annotator_rollup(df, "cid", "ord").collect()}
    assert set(got) == {1, 2}
    assert math.isclose(got[1][0], 0.4) and got[1][1] == "first"
    assert got[2] == (None, "only")


def test_lowercase_columns_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`A` int, `b` int")
    assert prep.lowercase_columns(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        prep.lowercase_columns(df.toDF("Ab", "aB"))


def test_onehot_grouped_equals_per_row(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"]), (3, [])], "k long, cats array<string>")
    a = agg.multilabel_onehot(df, "k", "cats", unique_key=True)
    b = agg.multilabel_onehot(df, "k", "cats", unique_key=False)
    assert a.exceptAll(b).count() == 0 and a.count() == 2
    assert {r["k"]: r["a"] for r in a.collect()} == {1: 2, 2: 0}


def test_category_counts_null_as_nan(spark):
    df = spark.createDataFrame([("A b",), (None,), ("b",)], "c string")
    got = {r["category"]: r["n"] for r in agg.category_counts(df, "c", null_as="nan").collect()}
    assert got == {"A": 1, "b": 2, "nan": 1}
    got = {r["category"]: r["n"] for r in agg.category_counts(df, "c").collect()}
    assert got == {"A": 1, "b": 2}


def test_csv_round_trip_with_quotes_and_newlines(spark):
    rows = [(1, 'she said "hi",\nthen\tleft'), (2, ""), (3, "plain")]
    df = spark.createDataFrame(rows, "id long, text string")
    path = files.write_csv(df, scratch_path(spark, "rt"))
    back = {r["id"]: r["text"] for r in files.read_csv(spark, path, "id long, text string").collect()}
    # quotes, separators and newlines survive; an empty field reads as missing (as in pandas)
    assert back == {1: 'she said "hi",\nthen\tleft', 2: None, 3: "plain"}


def test_na_values(spark):
    df = spark.createDataFrame([(1, "NA", "NA"), (2, "x", "null")], "id long, a string, text string")
    path = files.write_csv(df, scratch_path(spark, "na"))
    back = files.read_csv(spark, path, "id long, a string, text string", na_values=["NA", "null"],
                          exempt=["text"])
    got = {r["id"]: (r["a"], r["text"]) for r in back.collect()}
    assert got == {1: (None, "NA"), 2: ("x", "null")}


def test_histogram_constant_and_max_bin(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    h = agg.histogram(df, "v", 30).collect()
    assert len(h) == 30 and sum(r["n"] for r in h) == 2
    df = spark.createDataFrame([(0.0,), (3.0,), (float("nan"),), (None,)], "v double")
    h = {r["bin"]: r["n"] for r in agg.histogram(df, "v", 3).collect()}
    assert h == {0: 1, 1: 0, 2: 1}

"""Column helpers: NaN / NULL / text-in-number traps."""

import math

import duckdb
from pyspark.sql import functions as F

from modlens.functions import (
    fill_cast,
    flag_ge,
    flag_gt,
    md5_uniform,
    ngrams,
    numeric_guard,
    sanitize_label,
    split_words,
    tokens,
)


def test_thresholds_guard_nan_and_null(spark):
    vals = [float("nan"), None, 0.5, 0.4999, 0.5001, 1.0, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, s double")
    got = {r["i"]: (r["gt"], r["ge"]) for r in
           df.select("i", flag_gt("s", 0.5).alias("gt"), flag_ge("s", 0.5).alias("ge")).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 1), 3: (0, 0), 4: (1, 1), 5: (1, 1), 6: (0, 0)}


def test_sanitize_label_parses_strings(spark):
    raw = ["0", "1", "2", "none", "", None, "1.0", "NaN"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, l string")
    got = [r["x"] for r in df.orderBy("i").select(sanitize_label("l").alias("x")).collect()]
    assert got == [0, 1, 0, 0, 0, 0, 1, 0]


def test_numeric_guard(spark):
    raw = ["0.7", "1", "none", "", "NaN", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, t string")
    got = [r["x"] for r in df.orderBy("i").select(numeric_guard("t").alias("x")).collect()]
    assert got == [0.7, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_fill_cast(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "i int, n double")
    assert [r[0] for r in df.orderBy("i").select(fill_cast("n")).collect()] == [0, 3]


def test_split_words_edge_cases(spark):
    raw = ["A b a", "  x  y ", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(raw)], "i int, c string")
    got = [r["w"] for r in df.orderBy("i").select(split_words("c").alias("w")).collect()]
    assert got == [["a", "b", "a"], ["x", "y"], [], []]


def test_tokens_and_ngrams(spark):
    df = spark.createDataFrame([("Hé, you IDIOT!x2 ",)], "t string")
    r = df.select(tokens("t").alias("t")).select("t", ngrams(F.col("t"), 2).alias("b"),
                                                  ngrams(F.col("t"), 5).alias("e")).first()
    assert r["t"] == ["hé", "you", "idiot", "x2"]
    assert r["b"] == ["hé you", "you idiot", "idiot x2"]
    assert r["e"] == []


def test_md5_uniform_matches_duckdb(spark):
    df = spark.range(200).select(F.col("id"), md5_uniform(F.col("id"), 42).alias("u"))
    spark_u = {r["id"]: r["u"] for r in df.collect()}
    con = duckdb.connect()
    duck_u = dict(con.execute(
        "SELECT range, CAST(('0x' || substr(md5(CAST(range AS VARCHAR) || ':42'), 1, 13))::BIGINT AS DOUBLE)"
        " / 4503599627370496.0 FROM range(200)").fetchall())
    assert spark_u == duck_u
    assert all(0.0 <= u < 1.0 for u in spark_u.values())
    assert not any(math.isnan(u) for u in spark_u.values())

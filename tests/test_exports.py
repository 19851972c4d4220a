"""CSV with inferred types and JSON exports of unknown shape."""

import pytest
from pyspark.sql import functions as F

from modlens.session import scratch_path
from modlens.sources import files


def landed(spark, lines, header, files_=1):
    path = scratch_path(spark, "lines")
    (spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, v string").repartitionByRange(files_, "i")
     .select(F.col("v").alias(header)).write.option("header", True).option("sep", "\x01").option("quote", "").csv(path))
    return path


def exported(spark, lines):
    path = scratch_path(spark, "json")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


@pytest.mark.parametrize("values, kind", [
    (["1", "2"], "int"), (["1", "", "NA"], "int"), (["1", str(2 ** 31)], "bigint"), (["-1", str(2 ** 63)], "double"),
    (["1", "2.5"], "double"), (["1e3", ".5", "+7."], "double"), (["1", "nan"], "int"), (["1", "inf"], "string"),
    (["1d", "2"], "string"), (["0x1"], "string"), (["007"], "int"), (["True", "false"], "boolean"), (["tRue"], "string"),
    (["True", "1"], "string"), (["", "NA"], "string"), (["x"], "string"), ([" 1", "2"], "string")])
def test_column_types(spark, values, kind):
    path = landed(spark, [f"{i},{v}" for i, v in enumerate(values)], "k,v")
    assert dict(files.read_csv_inferred(spark, path).dtypes)["v"] == kind


def test_type_that_changes_in_the_last_row_of_the_last_file(spark):
    path = landed(spark, [str(i) + ",1" for i in range(5000)] + ["5000,1.5", "oops,1"], "a,b", files_=5)
    df = files.read_csv_inferred(spark, path)
    assert df.dtypes == [("a", "string"), ("b", "double"), (files.CORRUPT, "string")]
    assert df.agg(F.count("a"), F.sum("b"), F.count(files.CORRUPT)).first() == (5002, 5002.5, 0)


def test_corrupt_rows_are_kept_and_have_no_part_in_types(spark):
    path = landed(spark, ["1,a", "2,b,c", "x", '3,"q, ""r"""'], "n,s")
    df = files.read_csv_inferred(spark, path, text=["s"])
    assert df.dtypes[0] == ("n", "int")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [(1, "a", None), (None, None, "2,b,c"), (None, None, "x"), (3, 'q, "r"', None)], key=str)
    assert df.select("n").where("n is null").count() == 2  # also where only one column is read


def test_text_columns_keep_na_strings_and_never_become_numbers(spark):
    path = landed(spark, ["NA,1", "null,2", ",3"], "t,n")
    assert [tuple(r) for r in files.read_csv_inferred(spark, path, text=["t"]).orderBy("n").collect()] == [
        ("NA", 1, None), ("null", 2, None), (None, 3, None)]


def test_newlines_in_fields_and_a_header_alone(spark):
    df = spark.createDataFrame([("a\nb", "1"), ("c", "2")], "t string, n string")
    path = files.write_csv(df, scratch_path(spark, "multi"))
    got = files.read_csv_inferred(spark, path, multi_line=True)
    assert got.dtypes[1] == ("n", "int") and {r["t"] for r in got.collect()} == {"a\nb", "c"}
    empty = files.write_csv(df.limit(0).coalesce(1), scratch_path(spark, "empty"))
    assert files.read_csv_inferred(spark, empty).count() == 0


def test_a_column_named_like_the_corrupt_one_raises(spark):
    path = landed(spark, ["1"], files.CORRUPT)
    with pytest.raises(ValueError):
        files.read_csv_inferred(spark, path)
    assert files.read_csv_inferred(spark, path, corrupt="bad").columns == [files.CORRUPT, "bad"]


def test_shapes_merge_over_all_records(spark):
    path = exported(spark, ['{"a":1,"b":{"c":"x","d":[1,2]},"e":1}', '{"a":2.5,"b":{"c":null},"e":"s","n":null}',
                            '{"a":3,"e":{"z":1},"q\\"t":true,"x y":1}', "not json", "[1]", "", "   ", '"s"', '{"a":1,"a":2}', "{}"])
    df = files.read_json_export(spark, path)
    assert dict(df.dtypes) == {"a": "double", "b.c": "string", "b.d": "array<bigint>", "e": "string", 'q"t': "boolean",
                               "x y": "bigint", files.CORRUPT: "string"}
    rows = df.collect()
    assert sorted(r[files.CORRUPT] for r in rows if r[files.CORRUPT]) == ['"s"', "[1]", "not json", '{"a":1,"a":2}']
    assert sorted((r["a"], r["b.c"], r["b.d"], r["e"], r['q"t']) for r in rows if r["a"]) == [
        (1.0, "x", [1, 2], "1", None), (2.5, None, None, "s", None), (3.0, None, None, '{"z":1}', True)]
    assert len(rows) == 8  # blank lines are no records, an empty object is one


def test_lists_and_objects_under_one_name(spark):
    df = files.read_json_export(spark, exported(spark, ['{"v":[1,"a"]}', '{"v":[{"k":1}]}', '{"v":{"k":[true]}}', '{"v":"s"}']))
    assert {r["v"] for r in df.collect()} == {'[1,"a"]', '[{"k":1}]', '{"k":[true]}', "s"}


def test_whole_files_and_top_level_lists(spark):
    path = scratch_path(spark, "whole")
    for i, text in enumerate(['[\n {"a": 1},\n {"a": 2, "b": [1]}, 3\n]', '{\n "a": 4\n}', "[]"]):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(path)
    got = files.read_json_export(spark, path, whole_files=True)
    assert sorted((r["a"], r["b"]) for r in got.where("a is not null").collect()) == [(1, None), (2, [1]), (4, None)]
    assert [r[files.CORRUPT] for r in got.where(f"{files.CORRUPT} is not null").collect()] == ["3"]


def test_empty_exports_and_maps(spark):
    assert files.read_json_export(spark, exported(spark, [""])).columns == [files.CORRUPT]
    assert files.read_json_export(spark, exported(spark, ["nope"])).collect()[0][0] == "nope"
    with pytest.raises(ValueError):
        files.read_json_export(spark, exported(spark, ['{%s}' % ",".join(f'"k{i}":1' for i in range(30))]), wide=20)

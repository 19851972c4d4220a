"""File sources and sinks: CSV / TSV, JSON, term lists, partitioned Parquet, metric logs.

CSV with ``multiLine`` is not splittable: write several files and query Parquet afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StringType, StructField, StructType

from modlens.functions.columns import tokens

# Options that make quotes, separators, newlines and outer blanks inside text round-trip
# (Spark trims fields on write by default).
CSV_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_WRITE_OPTIONS = {"header": "true", "quoteAll": "true", "escape": '"', "quote": '"', **CSV_KEEP_BLANKS}
CSV_READ_OPTIONS = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
                    "mode": "FAILFAST", **CSV_KEEP_BLANKS}


def write_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    """``to_csv(path, index=False)``: header, every field quoted."""
    df.write.mode("overwrite").options(**CSV_WRITE_OPTIONS).option("sep", sep).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",",
             na_values: Sequence[str] = (), exempt: Sequence[str] = ()) -> DataFrame:
    """Headed CSV with a declared schema (no inference). An empty field reads
    as NULL, as pandas reads it.

    ``na_values`` lists extra strings read as missing (pandas treats 'NA',
    'null' and '' as missing by default; Spark only the empty string). Columns
    in ``exempt`` (free text) keep those strings.
    """
    df = spark.read.options(**CSV_READ_OPTIONS).option("sep", sep).schema(schema).csv(path)
    if na_values:
        for f in df.schema.fields:
            if f.name in exempt or f.dataType.simpleString() != "string":
                continue
            df = df.withColumn(f.name, F.when(F.col(f.name).isin(*na_values), F.lit(None))
                               .otherwise(F.col(f.name)))
    return df


#: Strings that pandas reads as missing besides the empty one. Fixed values.
NA_VALUES = ["#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
             "NULL", "NaN", "None", "n/a", "nan", "null"]
CORRUPT = "_corrupt_record"


def column_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """The narrowest type that every value of each string column has, found by one aggregate over all rows:
    boolean, int, bigint, double, else string; a column without values is a string.

    A number is plain decimal (``007`` and ``1e3`` are numbers, ``1d`` and ``0x1`` are text); a boolean is True or
    False in upper, lower or title case. Booleans and numbers together are text. Flags are combined with
    ``bool_and``, so the result doesn't depend on where in the files a type changes.
    """
    number = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    whole = r"^[+-]?\d+$"
    flags = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        for kind, ok in (("boolean", x.rlike("^(true|false|True|False|TRUE|FALSE)$")),
                         ("int", x.rlike(whole) & x.try_cast("int").isNotNull()),
                         ("bigint", x.rlike(whole) & x.try_cast("bigint").isNotNull()),
                         ("double", x.rlike(number) & x.try_cast("double").isNotNull())):
            flags.append(F.bool_and(F.when(x.isNotNull(), ok)).alias(f"{i}_{kind}"))
    if not columns:
        return {}
    row = df.agg(*flags).first()
    return {c: next((k for k in ("boolean", "int", "bigint", "double") if row[f"{i}_{k}"]), "string")
            for i, c in enumerate(columns)}


def read_csv_inferred(spark: SparkSession, path: str, sep: str = ",", na_values: Sequence[str] = NA_VALUES,
                      text: Sequence[str] = (), multi_line: bool = False, corrupt: str = CORRUPT) -> DataFrame:
    """Headed CSV whose column types are found from all rows (``column_types``), as pandas finds them.

    The header names the columns. A row with more or fewer fields than it is kept whole in ``corrupt`` and
    its columns are NULL; it has no part in the types. ``na_values`` and the empty field are missing, but in ``text``
    columns only the empty field is, and those stay strings. Two passes: one aggregate for the types, one
    scan that casts. Without ``multi_line`` files are split over tasks; with it, a field may hold newlines and
    a file is one task.
    """
    options = {k: v for k, v in CSV_READ_OPTIONS.items() if k != "mode"} | {"multiLine": str(multi_line).lower(), "sep": sep}
    header = spark.read.options(**options).csv(path).columns
    if corrupt in header:
        raise ValueError(f"{corrupt!r} is a column of the file: name another one for corrupt rows")
    schema = StructType([StructField(c, StringType()) for c in [*header, corrupt]])
    options["columnPruning"] = "false"  # or a scan of some columns wouldn't see that a row is short
    raw = (spark.read.options(**options).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt)
           .schema(schema).csv(path))
    bad = F.col(corrupt).isNotNull()
    missing = [v for v in na_values if v != ""]

    def value(c):
        x = F.col(f"`{c}`")
        return F.when(bad | (x == "") | (F.lit(False) if c in text else x.isin(*missing)), F.lit(None)).otherwise(x)

    clean = raw.select(*[value(c).alias(c) for c in header], corrupt)
    types = column_types(clean, [c for c in header if c not in text])
    return clean.select(*[F.col(f"`{c}`").cast(types.get(c, "string")).alias(c) for c in header], corrupt)


def variant_columns(schema: str, wide: int = 1000) -> list[tuple[str, str, str]]:
    """(path, name, type) of the leaves of a merged variant schema such as ``OBJECT<a: BIGINT, b: OBJECT<c: STRING>>``.

    Objects are opened, names in order; what has several types, or is a list of several, is a ``variant``, and
    so is an object with a name that paths can't quote. Fractions are doubles. More than ``wide`` leaves raise:
    such an export is a map, to be read as one."""
    out: list[tuple[str, str, str]] = []

    def opened(t, path, names):
        if isinstance(t, StructType) and not any("'" in n and '"' in n for n in t.names):
            for f in t.fields:
                mark = "'" if '"' in f.name else '"'
                opened(f.dataType, f"{path}[{mark}{f.name}{mark}]", [*names, f.name])
        elif not isinstance(t, NullType):
            kind = "variant" if isinstance(t, StructType) else t.simpleString()
            out.append((path, ".".join(names), re.sub(r"decimal\(\d+,[1-9]\d*\)", "double", kind)))

    opened(StructType.fromDDL(f"v {schema.replace('OBJECT<', 'STRUCT<')}")["v"].dataType, "$", [])
    if len(out) > wide:
        raise ValueError(f"{len(out)} different paths in the export, more than {wide}")
    return out


def read_json_export(spark: SparkSession, path: str, whole_files: bool = False, corrupt: str = CORRUPT,
                     wide: int = 1000) -> DataFrame:
    """A JSON export of unknown shape: one column per path that occurs anywhere, named ``a.b``.

    Records are parsed once into VARIANT. One aggregate (``schema_of_variant_agg``) merges the shapes of all
    records; the second pass takes each path's value in its merged type. A path whose values have several
    types (a number here, a string or an object there) is a string: the value's JSON, or a string's own
    characters. Lists stay arrays. A path with nulls only has no column. A line that isn't JSON, or isn't an object,
    is kept in ``corrupt`` with all other columns NULL. ``whole_files`` reads files that each hold one
    indented object or a list of them (a file is one value, so files, not records, are spread over tasks).
    Records that repeat a name keep none of it: they count as not JSON.
    """
    lines = spark.read.text(path, wholetext=whole_files)
    lines = lines.where(F.trim("value") != "")
    parsed = lines.select(F.try_parse_json("value").alias("v"), "value")
    if whole_files:
        is_list = F.coalesce(F.schema_of_variant("v").startswith("ARRAY"), F.lit(False))
        items = F.try_variant_get("v", "$", "array<variant>")
        parsed = (parsed.where(~is_list)
                  .unionByName(parsed.where(is_list).select(F.explode(items).alias("v"))
                               .select("v", F.to_json("v").alias("value"))))
    record = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    parsed = parsed.select(F.when(record, F.col("v")).alias("v"), F.when(~record, F.col("value")).alias(corrupt))
    schema = parsed.agg(F.schema_of_variant_agg("v")).first()[0]
    leaves = variant_columns(schema, wide) if schema and schema.startswith("OBJECT<") else []

    def value(p, t):
        if t != "variant":
            return F.try_variant_get("v", p, t)
        x = F.try_variant_get("v", p, "variant")
        return F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get("v", p, "string")), F.to_json(x))

    return parsed.select(*[value(p, t).alias(name) for p, name, t in leaves], corrupt)


def write_tsv_report(df: DataFrame, path: str) -> str:
    """Sample report as TSV with a header. Reports are small by construction
    (at most n rows per cell), so one output file is written."""
    df.coalesce(1).write.mode("overwrite").options(**CSV_WRITE_OPTIONS).option("sep", "\t").csv(path)
    return path


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t")


def read_json(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """JSON lines, or one (possibly indented) document per file with ``multi_line``, with a declared
    schema. A malformed record raises instead of reading as a row of NULLs."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)


def parse_json_column(df: DataFrame, column: str, schema: StructType | str,
                      alias: str | None = None) -> DataFrame:
    """Parse a nested JSON string column into a struct."""
    return df.withColumn(alias or column, F.from_json(F.col(column), schema))


def read_term_list(spark: SparkSession, path: str, lang: str = "en",
                   category: str | None = None) -> DataFrame:
    """One term per line (UTF-8) -> (term, category, lang). Blank lines dropped; a line
    goes through the token rule of texts, so several words, or a hyphenated one, match
    as an n-gram."""
    df = spark.read.text(path)
    term = F.array_join(tokens(F.col("value")), " ")
    return (df.select(term.alias("term"))
            .where(F.col("term") != "")
            .select("term", F.lit(category).cast("string").alias("category"),
                    F.lit(lang).alias("lang"))
            .dropDuplicates(["term", "category", "lang"]))


def write_split_table(df: DataFrame, path: str, split_col: str = "split") -> DataFrame:
    """Prepared dataset as Parquet partitioned by split, so a split view
    prunes partitions instead of filtering a full read."""
    df.write.mode("overwrite").partitionBy(split_col).parquet(path)
    return df.sparkSession.read.parquet(path)


def append_metric_log(df: DataFrame, path: str) -> None:
    """Append (run, epoch, split, metric, value) rows to a Parquet log."""
    df.select(F.col("run").cast("string"), F.col("epoch").cast("int"),
              F.col("split").cast("string"), F.col("metric").cast("string"),
              F.col("value").cast("double")).write.mode("append").parquet(path)

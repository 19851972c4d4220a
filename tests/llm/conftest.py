import os

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

# The tests one folder up import these from "conftest", which may be this file when all tests run together.
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_chars", LongType())])


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents table, optionally with clashing extra columns."""
    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]))
                for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            names = ["id", "n", "h", "size", "score", "lang_pred", "spans", "k", "component_id", "set_id", "word", "x"]
            for i, c in enumerate(names):
                df = df.withColumn(c, F.lit(i))
        return df

    return make


@pytest.fixture(scope="session")
def long_text():
    """A text of about 5 MB, more than any slice."""
    return " ".join(f"word{i % 9973} of the day." for i in range(220_000))

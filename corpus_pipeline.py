"""Corpus pipeline: five stages over the documents table, each calling one operator.

Every stage but the last returns the columns of documents; each stage's result is written as Parquet in
the shared scratch folder and read again as the next one's input. Nulls, empty and very long texts,
repeated rows and empty tables are handled as the operators define; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.llm.common import documents, parted, stored
from modlens.llm.decontaminate import without_contaminated
from modlens.llm.jaccard import jaccard_components, with_set_ids
from modlens.llm.langid import UNKNOWN, predict, profiles
from modlens.llm.mixing import mix
from modlens.llm.pii import redacted

#: Documents whose best language is further away than this are rejected as no language that was learned.
MIN_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. A missing ``lang`` is filled in."""
    found = predict(docs, profiles(docs), lang_col="__lang", score_col="__score")
    keep = found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE))
    return (keep.withColumn("lang", F.coalesce("lang", "__lang")).select(*[F.col(f"`{c}`") for c in docs.columns]))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id, and of several texts
    under that id one. Texts are decided one by one, also where an id has several; rows that repeat an
    id and a text are one document."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    members = stored(jaccard_components(docs, sets_too=True).where("doc_id is not null")
                     .select(F.col("doc_id").alias("__id"), F.col("set_id").alias("__s"),
                             F.col("component_id").alias("__component"), F.col("component").alias("__node")), "pipeline-members")
    # Most documents are alone: only those that may go or repeat an id meet the texts kept in a join.
    several = stored(members.groupBy("__id").agg(F.count(F.lit(1)).alias("__rows"), F.min("__component").alias("__component"))
                     .where("__id != __component or __rows > 1").select("__id"), "pipeline-groups")
    kept = (members.where("__s is not null and __id = __component").groupBy("__id", "__node")
            .agg(F.min("__s").alias("__s")).select("__id", "__s"))
    some, alone = parted(docs, "doc_id", several, "__id")
    some = with_set_ids(some, "__set")
    once = (some.join(kept, (F.col("doc_id") == F.col("__id")) & (F.col("__set") == F.col("__s")), "left_semi")
            .groupBy("doc_id", "__set").agg(F.min_by(F.struct(*own), "text").alias("__row")))
    once = once.select(*[F.col(f"__row.`{c}`") for c in docs.columns])
    empty = some.where("doc_id is not null and __set is null").select(*own).dropDuplicates(["doc_id", "text"])
    return (alone.unionByName(some.where("doc_id is null").select(*own)).unionByName(once).unionByName(empty))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any region of a benchmark item."""
    return without_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows."""
    clean = redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("bigint"), "n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mix(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("mixing", mixing)]

#: The first, third and fourth stage are learned models and alignments, which SQL can't express; the
#: pipeline is tested against brute-force versions of its stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}

"""The registered query of each operator: ``(spark, sf_dir) -> DataFrame`` over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.llm.alignment import link_counts
from modlens.llm.common import documents
from modlens.llm.decontaminate import contaminated
from modlens.llm.embeddings import near_duplicates
from modlens.llm.extract import extracted
from modlens.llm.infill import fill_in_middle, restored
from modlens.llm.jaccard import jaccard_components
from modlens.llm.langid import held_out, predict, profiles
from modlens.llm.mixing import mix
from modlens.llm.neighbours import nearest_neighbours
from modlens.llm.pii import personal_data
from modlens.llm.spans import without_repeated_runs
from modlens.llm.tokens import token_counts
from modlens.llm.toxicity import chain_scores


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted by scanning the token files written from the texts."""
    return token_counts(documents(spark, sf_dir))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain of low quality, then toxic; toxic where its probability is at least one half."""
    labels = documents(spark, sf_dir, "labels").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))
    scored = chain_scores(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return scored.withColumn("toxic", F.col("p_toxic") >= 0.5)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir).select("doc_id", "text"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_runs(documents(spark, sf_dir).select("doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages predicted from profiles that the held-out fifth has no part in."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(docs.drop("lang"), profiles(docs.where("not held_out")), drop_text=True)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that share a region."""
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(documents(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product for every row whose id is divisible by 20."""
    return nearest_neighbours(documents(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every document and the text rebuilt from it, as digests."""
    return (fill_in_middle(documents(spark, sf_dir))
            .withColumn("restored_sha256", F.sha2(restored(F.col("output"), F.col("form")), 256))
            .withColumn("output_sha256", F.sha2("output", 256)).drop("output"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers, with corpus-wide link counts."""
    return link_counts(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_ngram_jaccard, op3_toxicity, op4_personal_data, op5_sentence_spans, op6_language,
    op7_embeddings, op8_decontamination, op9_mixing, op10_html,
    op11_neighbours, op12_infill, op13_alignment)}

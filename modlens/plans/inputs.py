"""Common inputs of the query catalogue, derived from the given tables.

* ``labeled``: documents joined to labels on doc_id, ``label = toxic``.
* ``lex``: the lexicon classifier (``toxicity = hits/(hits+1)``, pred at >= 0.5).
* ``lm``: a fixed logistic classifier over the same matches, used as the
  second classifier of the head-to-head comparison so it has an exact oracle.
* dirty frames: NULL, NaN and text-in-number cases derived from ``event_id % 7``
  (every row is kept; the modulus only picks which rows carry which defect).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.functions.columns import flag_gt
from modlens.operators.lexicon import lexicon_frame, lexicon_score
from modlens.sources.tables import table

# The demonstration lexicon (term, category, lang).
# Ten English insult/contempt terms plus one deliberately noisy term.
LEXICON_ROWS = [
    ("idiot", "insult", "en"),
    ("trash", "contempt", "en"),
    ("scum", "contempt", "en"),
    ("clown", "insult", "en"),
    ("worthless", "contempt", "en"),
    ("moron", "insult", "en"),
    ("pathetic", "contempt", "en"),
    ("loser", "insult", "en"),
    ("disgusting", "contempt", "en"),
    ("stupid", "insult", "en"),
    ("shth", "ambiguous", "en"),
]
NOISY_TERMS = ["shth"]

# Coefficients of the fixed logistic classifier.
LM_PER_TERM = 0.5
LM_BIAS = -1.2
LM_NON_EN_LOW_QUALITY = 1.4

SEED = 42
SAMPLES_PER_CELL = 20
BATCH_SIZE = 64


def lexicon(spark: SparkSession) -> DataFrame:
    return lexicon_frame(spark, LEXICON_ROWS)


def labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return (docs.join(labels, "doc_id", "inner")
            .select("doc_id", "text", "lang", "source", "quality",
                    F.col("toxic").cast("int").alias("label")))


def labeled_ids(spark: SparkSession, sf_dir: str, with_label: bool = False) -> DataFrame:
    """The ids (and labels) of the labelled documents, without their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    out = labels.join(docs, "doc_id", "left_semi")
    return out if with_label else out.select("doc_id")


def lm_logit(matched_terms: str = "matched_terms") -> Column:
    strong = F.size(F.array_except(F.col(matched_terms),
                                   F.array(*[F.lit(t) for t in NOISY_TERMS])))
    boost = F.when((F.col("quality") == 0) & (F.col("lang") != "en"), 1.0).otherwise(0.0)
    return (F.lit(LM_PER_TERM) * strong + F.lit(LM_BIAS)
            + F.lit(LM_NON_EN_LOW_QUALITY) * boost)


SCORE_COLUMNS = ["doc_id", "lang", "source", "hits", "matched_terms", "categories", "toxicity"]


def scored(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    """Labelled documents with both classifiers: pred_lex (toxicity >= 0.5),
    z and pred_lm (z > 0).

    Documents are scored where they are read (map-only) and only narrow
    columns meet the labels in the join, so texts never cross a shuffle.
    ``with_text`` carries the text through the join for callers that need it;
    samples instead fetch text for their few keys (``attach_text``).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    s = lexicon_score(docs, LEXICON_ROWS)
    cols = SCORE_COLUMNS + (["text"] if with_text else [])
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", "quality", F.col("toxic").cast("int").alias("label"))
    return (s.select(*cols, F.col("pred").alias("pred_lex"))
            .join(labels, "doc_id", "inner")
            .withColumn("z", lm_logit())
            .withColumn("pred_lm", flag_gt(F.col("z"), 0.0)))


def attach_text(spark: SparkSession, sf_dir: str, sample: DataFrame, max_rows: int) -> DataFrame:
    """Add ``text`` to a sample whose size is bounded by construction
    (``max_rows`` = cells x rows per cell): the sample is broadcast to a
    map-side join over the documents scan, so documents are not shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if max_rows > 100_000:
        return sample.join(docs, "doc_id", "inner")
    return docs.join(F.broadcast(sample), "doc_id", "inner")


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with string label / toxicity and a nullable count, defects by event_id % 7."""
    ev = table(spark, sf_dir, "events")
    m = F.col("event_id") % 7
    label_raw = (F.when(m == 0, "0").when(m == 1, "1").when(m == 2, "none").when(m == 3, "")
                 .when(m == 4, F.lit(None)).when(m == 5, "2").otherwise("1.0"))
    tox_raw = (F.when(m == 2, "none").when(m == 3, "").when(m == 4, "NaN")
               .when(m == 5, F.lit(None)).otherwise((F.col("value") / 100.0).cast("string")))
    n_raw = (F.when(m.isin(3, 4), F.lit(None)).when(m == 1, F.lit(float("nan")))
             .otherwise(F.floor(F.col("value"))).cast("double"))
    return ev.select("event_id", "user_id", "event_type",
                     label_raw.alias("label_raw"), tox_raw.alias("toxicity_raw"),
                     n_raw.alias("n_raw"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a score that is NaN or NULL on some rows (many rows per user)."""
    ev = table(spark, sf_dir, "events")
    m = F.col("event_id") % 7
    score = (F.when(m == 4, F.lit(None)).when(m == 6, F.lit(float("nan")))
             .otherwise(F.col("value") / 100.0))
    return ev.select("event_id", "user_id", "event_type", score.alias("score"))

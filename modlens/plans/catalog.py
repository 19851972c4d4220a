"""Query catalogue: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Every query reads the given tables in full (or data Spark derives from them).
Array outputs are rendered with ``array_join`` and doubles rounded to 6 digits
so the results can be hashed against the SQL oracle.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.functions.columns import (
    dot,
    fill_cast,
    flag_eq,
    flag_ge,
    flag_gt,
    numeric_guard,
    sigmoid,
    split_words,
)
from modlens.operators import aggregate as agg
from modlens.operators import evaluate as ev
from modlens.operators import lexicon as lx
from modlens.operators import prep
from modlens.operators import sampling as smp
from modlens.operators import text as txt
from modlens.plans import inputs as I
from modlens.session import scratch_path
from modlens.sources import files
from modlens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Parameters of the demonstration queries.
CHANNEL_PLATFORMS = [f"src{i}" for i in range(10)]
PATH_PREFIXES = ["/en/", "/fr/"]
# A channel: terms by language (one hyphenated), platforms, path prefixes of one of them.
CHANNEL_TERMS = {"en": ["of-the", "and the", "idiot"], "fr": ["de la"], "de": ["und"]}
CHANNEL_SPEC = {"name": "demo", "public": True, "search_parameters": {"platform": {
    "example.com": {"path": ["/en/", "/fr/"]}, "example.net": {"path": []}}}}
LINEAR_HEAD_BIAS = 0.1
LATE_EVENT = 900          # from this event id on, the demonstration exports change type
HIST_BINS = 30
KDE_GRID = 50
KDE_FINE_BINS = 2000
MAX_LEN = 256
HASH_BUCKETS = 1 << 18
BATCHES_PER_SHARD = 16
#: The lexicon's own categories: known, so no job has to discover them.
LEXICON_CATEGORIES = sorted({c for _, c, _ in I.LEXICON_ROWS})
SHUFFLE_EPOCH = 1
ADVERSARIAL_POSITIVE = "error"
ROLE_REPLACE = {"assistant": "model"}


def linear_head_weights(dim: int = 64) -> list[float]:
    """w_i = ((37 i) mod 11 - 5) / 10 for i = 0..dim-1."""
    return [((37 * i) % 11 - 5) / 10 for i in range(dim)]


# ---------------------------------------------------------------- shared inputs

def _split_labeled(spark, sf_dir):
    return smp.stratified_split(I.labeled(spark, sf_dir), "doc_id", "label", seed=I.SEED,
                                on=I.labeled_ids(spark, sf_dir, with_label=True))


def _lex_docs(spark, sf_dir):
    return lx.lexicon_score(table(spark, sf_dir, "documents"), I.LEXICON_ROWS)


def annotations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation-export stand-in: labelled documents with the lexicon's
    toxicity and categories, dirtied like a hand-edited sheet (string label
    with 'none' / '' / NULL, toxicity as text with 'none' / 'NaN' / NULL,
    categories mixed case, sometimes repeated, NULL when none)."""
    # the split depends only on (key, label): assign it on the labels, join the narrow result
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))
    split = smp.stratified_split(labels, "doc_id", "label", seed=I.SEED).select("doc_id", "split")
    s = I.scored(spark, sf_dir, with_text=True).join(split, "doc_id", "inner")
    m = F.col("doc_id") % 7
    label_raw = (F.when(m == 2, "none").when(m == 3, F.lit(None)).when(m == 5, "")
                 .otherwise(F.col("label").cast("string")))
    tox_raw = (F.when(m == 1, "none").when(m == 4, F.lit(None)).when(m == 6, "NaN")
               .otherwise(F.col("toxicity").cast("string")))
    # one reference to the (expensive) categories column: repeat, join, case, blank -> NULL
    listed = F.array_join(F.transform(
        F.array_repeat(F.array_join("categories", " "), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1)),
        lambda c: F.when(F.col("doc_id") % 2 == 0, F.upper(c)).otherwise(c)), " ")
    cats = F.when(F.trim(listed) != "", listed)
    return s.select("doc_id", F.col("text").alias("Text"), label_raw.alias("Label"),
                    F.col("split").alias("Split"), tox_raw.alias("Toxicity"),
                    cats.alias("Categories"))


# ---------------------------------------------------------------- flagship

@register("flagship_compare")
def flagship_compare(spark, sf_dir):
    """Lexicon vs fixed logistic classifier on all labelled documents: one row
    per classifier with confusion counts, metrics and their agreement. One scan,
    one aggregate."""
    s = I.scored(spark, sf_dir)
    y = F.col("label")
    a = s.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(cond).alias(f"{name}_{cell}")
          for name, p in (("lex", F.col("pred_lex")), ("lm", F.col("pred_lm")))
          for cell, cond in (("tp", (y == 1) & (p == 1)), ("fp", (y != 1) & (p == 1)),
                             ("fn", (y == 1) & (p != 1)), ("tn", (y != 1) & (p != 1)))],
        F.avg((F.col("pred_lex") == F.col("pred_lm")).cast("double")).alias("agreement"),
    )
    rows = F.array(*[F.struct(F.lit(label).alias("classifier"), F.col("n").alias("n"),
                              *[F.col(f"{name}_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")],
                              F.col("agreement").alias("agreement"))
                     for label, name in (("lexicon", "lex"), ("logistic", "lm"))])
    out = a.select(F.inline(rows)).select("*", *ev.metric_columns())
    return out.select("classifier", "n", "tp", "fp", "fn", "tn",
                      *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1", "agreement")])


# ---------------------------------------------------------------- lexicon / search

@register("lex_score")
def lex_score(spark, sf_dir):
    s = _lex_docs(spark, sf_dir)
    return s.select("doc_id", "hits", r6("toxicity").alias("toxicity"), "pred")


@register("lex_categories")
def lex_categories(spark, sf_dir):
    s = _lex_docs(spark, sf_dir)
    return s.select("doc_id", F.array_join("categories", " ").alias("categories"),
                    F.array_join("matched_terms", " ").alias("terms"))


@register("lex_channel_search")
def lex_channel_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    query = {"en": [t for t, _, _ in I.LEXICON_ROWS]}
    platforms = {p: [] for p in CHANNEL_PLATFORMS}
    return lx.channel_search(docs, query, platforms, key="doc_id").select("doc_id", "lang", "source")


@register("lex_channel_spec")
def lex_channel_spec(spark, sf_dir):
    """A channel as it is kept: a term file per language and an indented JSON spec with platforms, some
    with path prefixes. Both are landed, read back, and applied to the pages together."""
    folder = scratch_path(spark, "channel")
    for lang, terms in CHANNEL_TERMS.items():
        spark.createDataFrame([(t,) for t in terms], "value string").coalesce(1).write.text(f"{folder}/terms-{lang}")
    spark.createDataFrame([(json.dumps(CHANNEL_SPEC, indent=2),)], "value string").write.text(f"{folder}/spec")
    schema = "name string, public boolean, search_parameters struct<platform: map<string, struct<path: array<string>>>>"
    spec = files.read_json(spark, f"{folder}/spec", schema, multi_line=True).first()
    query = {lang: [r["term"] for r in files.read_term_list(spark, f"{folder}/terms-{lang}", lang).collect()]
             for lang in CHANNEL_TERMS}
    platforms = {name: list(v["path"] or []) for name, v in spec["search_parameters"]["platform"].items()}
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.col("html").alias("text"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"),
        F.regexp_extract("url", r"example\.[a-z]+", 0).alias("source"))
    return lx.channel_search(pages, query, platforms, url_col="url", key="page_id").select("page_id", "lang", "source")


@register("lex_path_filter")
def lex_path_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return lx.path_filter(pages.select("page_id", "url"), PATH_PREFIXES)


# ---------------------------------------------------------------- evaluation

@register("join_align_predictions")
def join_align_predictions(spark, sf_dir):
    # the predictions are a stored table, as a scoring run leaves them; unmatched keys raise
    path = scratch_path(spark, "predictions")
    I.scored(spark, sf_dir).select("doc_id", "pred_lex", "pred_lm").write.parquet(path)
    labels = I.labeled_ids(spark, sf_dir, with_label=True)
    return ev.align_predictions(labels, spark.read.parquet(path), "doc_id", validate=True)


@register("join_align_by_position")
def join_align_by_position(spark, sf_dir):
    """Labels and predictions landed as two tables without keys, each in document order but cut into files
    differently, put side by side by row position."""
    s = I.scored(spark, sf_dir).select("doc_id", "label", "pred_lex")
    a, b = scratch_path(spark, "labels_in_order"), scratch_path(spark, "predictions_in_order")
    s.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").select("doc_id", "label").write.parquet(a)
    s.repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select(F.col("pred_lex").alias("pred")).write.parquet(b)
    return ev.align_by_position(spark.read.parquet(a), spark.read.parquet(b))


@register("eval_confusion_matrix")
def eval_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix_long(I.scored(spark, sf_dir), "label", "pred_lex")


def _metrics_rounded(df: DataFrame, by=()) -> DataFrame:
    return df.select(*by, "n", "tp", "fp", "fn", "tn",
                     *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("eval_metrics")
def eval_metrics(spark, sf_dir):
    return _metrics_rounded(ev.binary_metrics(I.scored(spark, sf_dir), "label", "pred_lex"))


@register("eval_metrics_by_group")
def eval_metrics_by_group(spark, sf_dir):
    m = ev.binary_metrics(I.scored(spark, sf_dir), "label", "pred_lm", by=["lang"])
    return _metrics_rounded(m, by=["lang"])


@register("eval_agreement")
def eval_agreement(spark, sf_dir):
    a = ev.agreement(I.scored(spark, sf_dir), "pred_lex", "pred_lm")
    return a.select("n", r6("agreement").alias("agreement"))


@register("eval_bce_loss")
def eval_bce_loss(spark, sf_dir):
    s = I.scored(spark, sf_dir)
    return s.agg(F.count(F.lit(1)).alias("n"),
                 r6(F.avg(ev.bce_with_logits("label", "z", 1.0))).alias("loss"),
                 r6(F.avg(ev.bce_with_logits("label", "z", 2.0))).alias("loss_pw2"))


@register("eval_epoch_batch_mean")
def eval_epoch_batch_mean(spark, sf_dir):
    # batches depend on the labelled ids only: rank those that have a document, join the scores once
    s = I.scored(spark, sf_dir).select("doc_id", "label", "pred_lm")
    ids = I.labeled_ids(spark, sf_dir)
    b = smp.batches(ids, "doc_id", I.BATCH_SIZE, epoch=0, seed=I.SEED).join(s, "doc_id")
    m = ev.epoch_batch_mean(b, "batch_id", "label", "pred_lm")
    return m.select("n_batches", "n", *[r6(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@register("scr_sigmoid_predict")
def scr_sigmoid_predict(spark, sf_dir):
    s = I.scored(spark, sf_dir)
    p = sigmoid(F.col("z"))
    return s.select("doc_id", r6("z").alias("z"), r6(p).alias("prob"), flag_gt(p, 0.5).alias("pred"))


@register("scr_linear_head")
def scr_linear_head(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    z = dot(F.col("embedding"), linear_head_weights(), LINEAR_HEAD_BIAS)
    return e.select("vec_id", r6(z).alias("z"), flag_gt(z, 0.0).alias("pred"))


# ---------------------------------------------------------------- error analysis / samples

def _cell_order() -> Column:
    return (F.when(F.col("cell") == "TN", 0).when(F.col("cell") == "FP", 1)
            .when(F.col("cell") == "FN", 2).otherwise(3))


@register("err_cell_filter")
def err_cell_filter(spark, sf_dir):
    s = I.scored(spark, sf_dir).select("doc_id", "label", F.col("pred_lex").alias("pred"))
    return ev.with_confusion_cell(s, "label", "pred")


def _cell_sample(spark, sf_dir, pred_col="pred_lex"):
    s = I.scored(spark, sf_dir).select("doc_id", "label", F.col(pred_col).alias("pred"))
    cells = ev.with_confusion_cell(s, "label", "pred")
    return smp.sample_per_group(cells, ["cell"], I.SAMPLES_PER_CELL, "doc_id", I.SEED, rank_col="_rn")


def _confusion_samples(spark, sf_dir, pred_col="pred_lex"):
    sample = I.attach_text(spark, sf_dir, _cell_sample(spark, sf_dir, pred_col), 4 * I.SAMPLES_PER_CELL)
    out = smp.renumber(sample, [_cell_order(), F.col("_rn")], "row_id")
    return out.select("row_id", "cell", "doc_id", "text", "label", "pred")


@register("err_confusion_samples")
def err_confusion_samples(spark, sf_dir):
    return _confusion_samples(spark, sf_dir, "pred_lex")


@register("err_disagreement_filter")
def err_disagreement_filter(spark, sf_dir):
    s = I.scored(spark, sf_dir).select("doc_id", "label", "pred_lm", "pred_lex")
    return ev.disagreements(s, "label", "pred_lm", "pred_lex", "lm", "lex")


def _dis_order() -> Column:
    return (F.when(F.col("cell") == "TN_lm", 0).when(F.col("cell") == "TP_lm", 1)
            .when(F.col("cell") == "TN_lex", 2).otherwise(3))


@register("err_disagreement_samples")
def err_disagreement_samples(spark, sf_dir):
    s = I.scored(spark, sf_dir).select("doc_id", "label", "pred_lm", "pred_lex")
    d = ev.disagreements(s, "label", "pred_lm", "pred_lex", "lm", "lex")
    sample = smp.sample_per_group(d, ["cell"], I.SAMPLES_PER_CELL, "doc_id", I.SEED, rank_col="_rn")
    sample = I.attach_text(spark, sf_dir, sample, 4 * I.SAMPLES_PER_CELL)
    out = smp.renumber(sample, [_dis_order(), F.col("_rn")], "row_id")
    return out.select("row_id", "cell", "doc_id", "text", "label", "pred_lm", "pred_lex")


@register("set_union_tagged")
def set_union_tagged(spark, sf_dir):
    # one scan: each row yields one row per classifier, sampled per (classifier, cell)
    both = F.array(*[F.struct(F.lit(name).alias("classifier"), F.col(c).alias("pred"))
                     for name, c in (("lexicon", "pred_lex"), ("logistic", "pred_lm"))])
    rows = I.scored(spark, sf_dir).select("doc_id", "label", F.inline(both))
    cells = ev.with_confusion_cell(rows, "label", "pred")
    return (smp.sample_per_group(cells, ["classifier", "cell"], I.SAMPLES_PER_CELL, "doc_id", I.SEED)
            .select("classifier", "cell", "doc_id", "label", "pred"))


@register("snk_tsv_samples")
def snk_tsv_samples(spark, sf_dir):
    sample = _confusion_samples(spark, sf_dir, "pred_lex")
    path = files.write_tsv_report(sample, scratch_path(spark, "conf_samples_tsv"))
    schema = "row_id bigint, cell string, doc_id bigint, text string, label int, pred int"
    return files.read_tsv(spark, path, schema)


# ---------------------------------------------------------------- sources

@register("src_csv_roundtrip")
def src_csv_roundtrip(spark, sf_dir):
    # outer blanks and tabs must come back too
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("  "), "text", F.lit("\t")).alias("text"), "lang", "source")
    path = files.write_csv(docs, scratch_path(spark, "documents_csv"))
    return files.read_csv(spark, path, "doc_id bigint, text string, lang string, source string")


@register("src_csv_inferred")
def src_csv_inferred(spark, sf_dir):
    """A hand-made event export, read without a schema: a number that turns fractional and a code that turns
    into text among the last events, missing values in several spellings, rows with a field too many or too
    few. Rows and columns come back with their types' names."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    late = i >= LATE_EVENT
    line = F.concat_ws(
        ",", i.cast("string"), (i * 3_000_000_000).cast("string"), F.when(i % 7 == 2, "NA").otherwise((i % 2 == 0).cast("string")),
        F.when(i % 7 == 3, "").when(late, F.round("value", 2).cast("string")).otherwise((i % 100).cast("string")),
        F.when(i % 7 == 4, "n/a").when(late, F.concat(F.lit("c"), i % 10)).otherwise((i % 10).cast("string")),
        F.concat(F.lit('"'), F.col("event_type"), F.lit(', said ""x"""')))
    line = F.when(i % 11 == 5, F.concat(line, F.lit(",surplus"))).when(i % 11 == 7, i.cast("string")).otherwise(line)
    path = scratch_path(spark, "events_by_hand")
    # one column named like the header, written without quotes, is a file of the lines as they are
    (e.select(line.alias("id,big,flag,amount,code,note")).write.option("header", True).option("sep", "\x01")
     .option("quote", "").option("escape", "").csv(path))
    rows = files.read_csv_inferred(spark, path, text=["note"])
    types = ",".join(t for _, t in rows.dtypes)
    return rows.select("id", "big", "flag", F.col("amount").alias("amount"), "code", "note",
                       F.length(files.CORRUPT).alias("corrupt_chars"), F.lit(types).alias("types"))


@register("src_json_export")
def src_json_export(spark, sf_dir):
    """A channel export of mixed shapes, read without a schema: nested objects, lists, a field of several types,
    a field that only late records have, and lines that aren't JSON."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    post = F.to_json(F.struct(
        i.alias("id"), F.when(i % 5 != 1, F.struct(F.col("event_type").alias("name"), F.col("user_id").alias("no"))).alias("author"),
        F.when(i % 3 == 0, F.array(F.col("user_id"), i)).alias("refs"), F.when(i >= LATE_EVENT, F.col("value")).alias("score")))
    mixed = (F.when(i % 4 == 0, F.lit(',"extra":7}')).when(i % 4 == 1, F.lit(',"extra":"seven"}'))
             .when(i % 4 == 2, F.lit(',"extra":{"n":7}}')).otherwise(F.lit("}")))
    line = F.when(i % 13 == 6, F.concat(F.lit("broken "), i)).otherwise(F.concat(F.rtrim(post, F.lit("}")), mixed))
    line = F.when((i % 13 != 6) & (F.substring(post, -2, 2) == "}}"), F.concat(F.rtrim(post, F.lit("}")), F.lit("}"), mixed)).otherwise(line)
    path = scratch_path(spark, "channel_export")
    e.select(line.alias("value")).write.text(path)
    rows = files.read_json_export(spark, path)
    name = lambda c: F.col(f"`{c}`")
    return rows.select("id", name("author.name").alias("author_name"), name("author.no").alias("author_no"),
                       F.array_join(F.col("refs").cast("array<string>"), " ").alias("refs"), r6("score").alias("score"), "extra",
                       F.col(files.CORRUPT).alias("corrupt"))


@register("src_json_props")
def src_json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props")
    parsed = files.parse_json_column(e, "props", "k bigint", alias="p")
    return parsed.select("event_id", F.col("p.k").alias("k"))


# ---------------------------------------------------------------- projections

@register("view_split")
def view_split(spark, sf_dir):
    return prep.split_view(_split_labeled(spark, sf_dir), "test", ["doc_id", "text", "label"])


@register("view_split_partitioned")
def view_split_partitioned(spark, sf_dir):
    """The split view over a table written by split: the filter prunes its partitions."""
    path = scratch_path(spark, "by_split")
    data = files.write_split_table(_split_labeled(spark, sf_dir).select("doc_id", "text", "label", "split"), path)
    return prep.split_view(data, "val", ["doc_id", "text", "label"])


@register("prj_select")
def prj_select(spark, sf_dir):
    return I.labeled(spark, sf_dir).select("doc_id", "lang", "source", "label")


@register("prj_rename_class_label")
def prj_rename_class_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("class"))
    return prep.rename_class_label(e, "class")


@register("prj_threshold_strict")
def prj_threshold_strict(spark, sf_dir):
    s = _lex_docs(spark, sf_dir)
    return s.select("doc_id", r6("toxicity").alias("toxicity"), flag_gt("toxicity", 0.5).alias("label"))


@register("prj_threshold_inclusive")
def prj_threshold_inclusive(spark, sf_dir):
    s = _lex_docs(spark, sf_dir)
    return s.select("doc_id", r6("toxicity").alias("toxicity"), flag_ge("toxicity", 0.5).alias("label"))


@register("prj_label_from_string")
def prj_label_from_string(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return e.withColumn("label", flag_eq("event_type", ADVERSARIAL_POSITIVE))


@register("prj_replace_value")
def prj_replace_value(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return prep.replace_values(c, "role", ROLE_REPLACE)


@register("prj_lower_columns")
def prj_lower_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("Event_ID"),
                                             F.col("user_id").alias("UserID"),
                                             F.col("event_type").alias("EventType"))
    return prep.lowercase_columns(e)


@register("prj_sanitize_label")
def prj_sanitize_label(spark, sf_dir):
    d = I.dirty_events(spark, sf_dir).select("event_id", "label_raw",
                                             F.col("label_raw").alias("label"))
    return prep.sanitize_label_column(d, "label")


@register("prj_numeric_guard")
def prj_numeric_guard(spark, sf_dir):
    d = I.dirty_events(spark, sf_dir)
    return d.select("event_id", numeric_guard("toxicity_raw").alias("toxicity"))


@register("prj_fill_cast")
def prj_fill_cast(spark, sf_dir):
    d = I.dirty_events(spark, sf_dir)
    return d.select("event_id", fill_cast("n_raw", "int").alias("n"))


# ---------------------------------------------------------------- multi-label

@register("arr_split_categories")
def arr_split_categories(spark, sf_dir):
    a = annotations_raw(spark, sf_dir)
    return a.select("doc_id", F.array_join(split_words("Categories", lower=True), " ").alias("categories"))


@register("agg_multilabel_long")
def agg_multilabel_long(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", split_words("p_name").alias("words"))
    return agg.multilabel_long(p, "p_partkey", "words", "category")


@register("agg_multilabel_onehot")
def agg_multilabel_onehot(spark, sf_dir):
    a = annotations_raw(spark, sf_dir).select("doc_id", split_words("Categories").alias("cats"))
    return agg.multilabel_onehot(a, "doc_id", "cats", categories=LEXICON_CATEGORIES)


@register("join_left_categories")
def join_left_categories(spark, sf_dir):
    a = annotations_raw(spark, sf_dir).select("doc_id", split_words("Categories").alias("cats"))
    # several rows per key in general: grouped one-hot, left-joined back to every key
    onehot = agg.multilabel_onehot(a, "doc_id", "cats", categories=LEXICON_CATEGORIES, unique_key=False)
    return agg.join_categories(I.labeled_ids(spark, sf_dir), onehot, "doc_id")


@register("agg_category_counts")
def agg_category_counts(spark, sf_dir):
    a = annotations_raw(spark, sf_dir)
    return agg.category_counts(a, "Categories", lower=False, null_as="nan")


@register("prep_annotations")
def prep_annotations(spark, sf_dir):
    return prep.clean_annotations(annotations_raw(spark, sf_dir), "doc_id", categories=LEXICON_CATEGORIES)


# ---------------------------------------------------------------- aggregation

@register("agg_annotator_rollup")
def agg_annotator_rollup(spark, sf_dir):
    e = I.scored_events(spark, sf_dir)
    r = agg.annotator_rollup(e, "user_id", "event_id", ["score", "event_type"])
    return r.select("user_id", r6("score").alias("score"), "event_type")


@register("prep_scored_comments")
def prep_scored_comments(spark, sf_dir):
    e = I.scored_events(spark, sf_dir).select("user_id", "event_id", "score", "event_type")
    out = prep.prepare_scored_comments(e, "user_id", "event_id", "score", 0.5, seed=I.SEED)
    return out.select("user_id", r6("score").alias("score"), "event_type", "label", "split")


@register("agg_merged_profile")
def agg_merged_profile(spark, sf_dir):
    """Counts and distinct users of each event type, merged from stored sketches of seven partial loads, and
    whether each estimate is within the sketch's bound of the exact number."""
    e = table(spark, sf_dir, "events")
    path = scratch_path(spark, "profile_sketches")
    agg.write_profile_sketches(e.withColumn("load", F.col("event_id") % 7), path, "event_id", by=["load", "event_type"])
    merged = agg.merge_profile_sketches(spark.read.parquet(path), by=["event_type"])
    exact = e.groupBy("event_type").agg(F.count_distinct("event_id").alias("exact"))
    close = F.abs(F.col("distinct_estimate") - F.col("exact")) <= agg.SKETCH_BOUND * F.col("exact")
    return merged.join(exact, "event_type").select("event_type", "n", "n_null", close.alias("within_bound"))


@register("agg_profile_counts")
def agg_profile_counts(spark, sf_dir):
    parts = [
        agg.profile_counts(table(spark, sf_dir, "documents"), "text").select(F.lit("documents.text").alias("target"), "*"),
        agg.profile_counts(table(spark, sf_dir, "events"), "user_id").select(F.lit("events.user_id").alias("target"), "*"),
        agg.profile_counts(table(spark, sf_dir, "labels"), "doc_id").select(F.lit("labels.doc_id").alias("target"), "*"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("agg_value_counts")
def agg_value_counts(spark, sf_dir):
    return agg.value_counts(table(spark, sf_dir, "events"), "event_type")


@register("agg_class_share")
def agg_class_share(spark, sf_dir):
    s = agg.class_share(_split_labeled(spark, sf_dir), "label", "split")
    return s.select("split", "label", "n", r6("share").alias("share"))


@register("agg_label_pred_counts")
def agg_label_pred_counts(spark, sf_dir):
    return agg.distinct_counts(I.scored(spark, sf_dir), ["label", "pred_lex", "pred_lm"])


@register("agg_histogram_30")
def agg_histogram_30(spark, sf_dir):
    h = agg.histogram(table(spark, sf_dir, "events"), "value", HIST_BINS)
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@register("agg_kde_grid")
def agg_kde_grid(spark, sf_dir):
    k = agg.kde_grid(table(spark, sf_dir, "events"), "value", KDE_GRID, KDE_FINE_BINS)
    return k.select("grid", r6("x").alias("x"), F.round("density", 9).alias("density"))


@register("agg_kde_exact")
def agg_kde_exact(spark, sf_dir):
    k = agg.kde_exact(table(spark, sf_dir, "events"), "value", KDE_GRID)
    return k.select("grid", r6("x").alias("x"), F.round("density", 9).alias("density"))


# ---------------------------------------------------------------- sampling

@register("smp_stratified_split")
def smp_stratified_split(spark, sf_dir):
    return _split_labeled(spark, sf_dir).select("doc_id", "label", "split")


@register("smp_split_balance")
def smp_split_balance(spark, sf_dir):
    return (_split_labeled(spark, sf_dir).groupBy("split", "label")
            .agg(F.count(F.lit(1)).alias("n")))


@register("smp_class_weights")
def smp_class_weights(spark, sf_dir):
    w = smp.class_weights(I.labeled(spark, sf_dir).select("doc_id", "label"), "label")
    return w.select("doc_id", "label", F.round("weight", 9).alias("weight"))


@register("smp_balanced_resample")
def smp_balanced_resample(spark, sf_dir):
    d = I.labeled(spark, sf_dir).select("doc_id", "label")
    return smp.balanced_resample(d, "doc_id", "label", seed=I.SEED)


@register("smp_exact_resample")
def smp_exact_resample(spark, sf_dir):
    """As many class-balanced draws as there are labelled documents, exactly."""
    return smp.exact_resample(I.labeled_ids(spark, sf_dir, with_label=True), "doc_id", "label", seed=I.SEED).select(
        "doc_id", "label", "copy")


@register("smp_shuffle_order")
def smp_shuffle_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return smp.shuffle_order(o, "o_orderkey", epoch=SHUFFLE_EPOCH, seed=I.SEED)


@register("smp_batches")
def smp_batches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return smp.batches(o, "o_orderkey", I.BATCH_SIZE, epoch=0, seed=I.SEED)


@register("smp_epoch_shards")
def smp_epoch_shards(spark, sf_dir):
    """The batches of an epoch as sorted shard files: places and batches come from where rows stand in the files."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    path = scratch_path(spark, "epoch_shards")
    manifest = smp.write_epoch_shards(o, "o_orderkey", path, I.BATCH_SIZE, epoch=0, seed=I.SEED,
                                      batches_per_shard=BATCHES_PER_SHARD)
    rows = smp.read_epoch_shards(spark, path, "o_orderkey bigint, pos bigint, batch_id bigint, shard bigint")
    pos = F.col("first_pos") + F.col("_file_pos")
    return (rows.join(smp.per_class(manifest.select("shard", "first_pos")), "shard")
            .select("o_orderkey", pos.alias("pos"), F.floor((pos - 1) / I.BATCH_SIZE).cast("bigint").alias("batch_id")))


# ---------------------------------------------------------------- text

@register("txt_encode_hashed")
def txt_encode_hashed(spark, sf_dir):
    e = txt.encode_hashed(table(spark, sf_dir, "documents"), max_len=MAX_LEN, buckets=HASH_BUCKETS)
    return e.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).alias("n_mask"))


@register("txt_vocab")
def txt_vocab(spark, sf_dir):
    return txt.vocabulary(table(spark, sf_dir, "documents"))


@register("txt_encode_fixed")
def txt_encode_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    enc = txt.encode_fixed(docs, txt.vocabulary(docs), "doc_id", "text", MAX_LEN)
    return enc.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                      F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("n_mask"))


@register("txt_truncation_profile")
def txt_truncation_profile(spark, sf_dir):
    p = txt.truncation_profile(table(spark, sf_dir, "documents"), "text", MAX_LEN)
    return p.select("n_docs", r6("mean_tokens").alias("mean_tokens"), "p50", "p90", "p99",
                    "max_tokens", r6("share_truncated").alias("share_truncated"), "max_len")


# ---------------------------------------------------------------- dataset cards

@register("prep_tweets")
def prep_tweets(spark, sf_dir):
    # the class stands in for a rater's: every document has one
    raw = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tweet"),
                                                   (F.col("doc_id") % 3).cast("int").alias("class"))
    out = prep.prepare_tweets(raw, "doc_id", seed=I.SEED)
    return out.select("doc_id", "class", "text", "label", "split")


@register("prep_adversarial")
def prep_adversarial(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 10
    raw = e.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("acl.id"),
        F.col("props").alias("text"),
        F.col("event_type").alias("label"),
        F.col("event_type").alias("type"),
        F.when(F.col("user_id") % 2 == 0, "original").otherwise("perturbed").alias("level"),
        F.when(m < 8, "train").when(m == 8, "dev").otherwise("test").alias("split"),
        F.lit(0).alias("extra"),
    )
    return prep.prepare_adversarial(raw, positive=ADVERSARIAL_POSITIVE)

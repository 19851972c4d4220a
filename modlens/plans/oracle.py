"""Equivalent DuckDB SQL for each catalogue key (the correctness oracle).

Column names and types match the Spark queries: counts BIGINT, flags INTEGER,
doubles rounded to 6 digits (9 for densities and weights), arrays rendered as
space-joined strings. Fixed values (lexicon, weights) come from the same
constants the Spark side uses.
"""

from __future__ import annotations

from collections import defaultdict

from modlens.plans import catalog as C
from modlens.plans import inputs as I
from modlens.plans import models as M

#: Steps of the head's descent: far more than it needs at its rate.
HEAD_STEPS = 200


def _tok(c: str) -> str:
    return ("list_filter(regexp_split_to_array(lower(" + c + r"), '[^\p{L}\p{N}]+'), "
            "lambda x: x <> '')")


def _ws(c: str) -> str:
    return "list_filter(string_split_regex(" + c + r", '\s+'), lambda x: x <> '')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_BY_LANG = defaultdict(list)
for _t, _c, _l in I.LEXICON_ROWS:
    _BY_LANG[_l].append(_t)
_MATCH = " OR ".join(f"(lang = {_q(l)} AND t IN {_in_list(ts)})" for l, ts in sorted(_BY_LANG.items()))
_CATS = defaultdict(list)
for _t, _c, _l in I.LEXICON_ROWS:
    _CATS[_c].append(_t)
_CAT_CASE = "CASE " + " ".join(f"WHEN t IN {_in_list(ts)} THEN {_q(c)}" for c, ts in sorted(_CATS.items())) + " END"
CATEGORIES = sorted(_CATS)
_NOISY = _in_list(I.NOISY_TERMS)


def _lex_cols(src: str, extra: str) -> str:
    """Lexicon match columns over ``src`` (which has doc_id, text, lang)."""
    return f"""
  SELECT {extra},
         CAST(len(matched) AS BIGINT) AS hits,
         list_sort(list_distinct(matched)) AS matched_terms,
         list_sort(list_distinct(list_transform(matched, lambda t: {_CAT_CASE}))) AS categories,
         CAST(len(matched) AS DOUBLE) / (CAST(len(matched) AS DOUBLE) + 1.0) AS toxicity
  FROM (SELECT *, list_filter({_tok('text')}, lambda t: {_MATCH}) AS matched FROM {src})"""


LEX_DOCS = f"""lexd AS ({_lex_cols('documents', 'doc_id, text, lang, source')}),
lexs AS (SELECT *, CASE WHEN NOT isnan(toxicity) AND toxicity >= 0.5 THEN 1 ELSE 0 END AS pred FROM lexd)"""

LABELED = """lab AS (
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality, CAST(l.toxic AS INTEGER) AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

SCORED = LABELED + f""",
sc0 AS ({_lex_cols('lab', 'doc_id, text, lang, source, quality, label')}),
sc1 AS (
  SELECT *, CASE WHEN NOT isnan(toxicity) AND toxicity >= 0.5 THEN 1 ELSE 0 END AS pred_lex,
         CAST({I.LM_PER_TERM!r} AS DOUBLE) * CAST(len(list_filter(matched_terms, lambda t: t NOT IN {_NOISY})) AS DOUBLE)
         + CAST({I.LM_BIAS!r} AS DOUBLE)
         + CAST({I.LM_NON_EN_LOW_QUALITY!r} AS DOUBLE) * (CASE WHEN quality = 0 AND lang <> 'en' THEN 1.0 ELSE 0.0 END)::DOUBLE AS z
  FROM sc0),
sc AS (SELECT *, CASE WHEN NOT isnan(z) AND z > 0 THEN 1 ELSE 0 END AS pred_lm FROM sc1)"""


def _md5(key: str, seed: int = I.SEED) -> str:
    return f"md5(CAST({key} AS VARCHAR) || ':{seed}')"


def split_ctes(src: str, key: str, label: str, out: str, p: str = "sp") -> str:
    """Exact stratified 80/10/10 split of CTE ``src`` into CTE ``out`` (adds ``split``)."""
    return f"""{p}_rank AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY {_md5(key)}, {key}) AS {p}_rk FROM {src}),
{p}_cnt AS (SELECT {label} AS lbl, count(*) AS n_c FROM {src} GROUP BY 1),
{p}_tot AS (SELECT sum(n_c) AS n_all, (sum(n_c) + 4) // 5 AS h_all FROM {p}_cnt),
{p}_h1 AS (SELECT lbl, n_c, (n_c * h_all) // n_all AS fl, (n_c * h_all) % n_all AS rem, h_all FROM {p}_cnt, {p}_tot),
{p}_h AS (SELECT lbl, n_c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, lbl) <= h_all - sum(fl) OVER () THEN 1 ELSE 0 END AS h_c FROM {p}_h1),
{p}_t0 AS (SELECT sum(h_c) AS hs, (sum(h_c) + 1) // 2 AS t_all FROM {p}_h),
{p}_t1 AS (SELECT lbl, n_c, h_c, (h_c * t_all) // hs AS fl, (h_c * t_all) % hs AS rem, t_all FROM {p}_h, {p}_t0),
{p}_q AS (SELECT lbl, n_c, h_c, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, lbl) <= t_all - sum(fl) OVER () THEN 1 ELSE 0 END AS t_c FROM {p}_t1),
{out} AS (
  SELECT r.* EXCLUDE ({p}_rk),
         CASE WHEN {p}_rk <= q.n_c - q.h_c THEN 'train' WHEN {p}_rk <= q.n_c - q.t_c THEN 'val' ELSE 'test' END AS split
  FROM {p}_rank r JOIN {p}_q q ON r.{label} = q.lbl)"""


def _metric_sql(rounded: bool = True) -> str:
    r = (lambda e: f"round({e}, 6)") if rounded else (lambda e: e)
    return f"""n, tp, fp, fn, tn,
  {r("CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn)::DOUBLE / n END")} AS accuracy,
  {r("CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END")} AS precision,
  {r("CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END")} AS recall,
  {r("CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END")} AS f1"""


def _counts_sql(pred: str) -> str:
    return f"""count(*) AS n,
  count(*) FILTER (WHERE label = 1 AND {pred} = 1) AS tp,
  count(*) FILTER (WHERE label <> 1 AND {pred} = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND {pred} <> 1) AS fn,
  count(*) FILTER (WHERE label <> 1 AND {pred} <> 1) AS tn"""


_CELL = ("CASE WHEN label = 0 AND pred = 0 THEN 'TN' WHEN label = 0 AND pred = 1 THEN 'FP' "
         "WHEN label = 1 AND pred = 0 THEN 'FN' WHEN label = 1 AND pred = 1 THEN 'TP' END")
_CELL_ORDER = "CASE cell WHEN 'TN' THEN 0 WHEN 'FP' THEN 1 WHEN 'FN' THEN 2 ELSE 3 END"
_DIS_CELL = ("CASE WHEN label = 0 AND pred_lm = label AND pred_lex <> label THEN 'TN_lm' "
             "WHEN label = 1 AND pred_lm = label AND pred_lex <> label THEN 'TP_lm' "
             "WHEN label = 0 AND pred_lm <> label AND pred_lex = label THEN 'TN_lex' "
             "WHEN label = 1 AND pred_lm <> label AND pred_lex = label THEN 'TP_lex' END")
_DIS_ORDER = "CASE cell WHEN 'TN_lm' THEN 0 WHEN 'TP_lm' THEN 1 WHEN 'TN_lex' THEN 2 ELSE 3 END"
N = I.SAMPLES_PER_CELL


def _conf_samples(pred: str) -> str:
    return f"""WITH {SCORED},
c AS (SELECT doc_id, text, label, {pred} AS pred FROM sc),
cc AS (SELECT *, {_CELL} AS cell FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {_md5('doc_id')}, doc_id) AS rn FROM cc),
s AS (SELECT * FROM r WHERE rn <= {N})
SELECT CAST(row_number() OVER (ORDER BY {_CELL_ORDER}, rn) - 1 AS BIGINT) AS row_id, cell, doc_id, text, label, pred FROM s"""


SPLIT_LAB = LABELED + ",\n" + split_ctes("lab", "doc_id", "label", "spl")

DIRTY_EVENTS = """de AS (
  SELECT event_id, user_id, event_type,
    CASE event_id % 7 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN 'none' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '2' ELSE '1.0' END AS label_raw,
    CASE event_id % 7 WHEN 2 THEN 'none' WHEN 3 THEN '' WHEN 4 THEN 'NaN' WHEN 5 THEN NULL ELSE CAST(value / 100.0 AS VARCHAR) END AS toxicity_raw,
    CASE WHEN event_id % 7 IN (3, 4) THEN NULL WHEN event_id % 7 = 1 THEN 'NaN'::DOUBLE ELSE CAST(floor(value) AS DOUBLE) END AS n_raw
  FROM events)"""

SCORED_EVENTS = """se AS (
  SELECT event_id, user_id, event_type,
    CASE WHEN event_id % 7 = 4 THEN NULL WHEN event_id % 7 = 6 THEN 'NaN'::DOUBLE ELSE value / 100.0 END AS score
  FROM events)"""

ROLLUP = SCORED_EVENTS + """,
ru AS (
  SELECT user_id, avg(CASE WHEN NOT isnan(score) THEN score END) AS score,
         arg_min(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS event_type
  FROM se WHERE user_id IS NOT NULL GROUP BY user_id)"""

_JOINED = "array_to_string(categories, ' ')"
ANNOTATIONS = SCORED + ",\n" + split_ctes("sc", "doc_id", "label", "scs") + f""",
ann AS (
  SELECT doc_id, text AS "Text",
    CASE WHEN doc_id % 7 = 2 THEN 'none' WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 7 = 5 THEN '' ELSE CAST(label AS VARCHAR) END AS "Label",
    split AS "Split",
    CASE WHEN doc_id % 7 = 1 THEN 'none' WHEN doc_id % 7 = 4 THEN NULL WHEN doc_id % 7 = 6 THEN 'NaN' ELSE CAST(toxicity AS VARCHAR) END AS "Toxicity",
    CASE WHEN doc_id % 2 = 0 THEN upper(cj) ELSE cj END AS "Categories"
  FROM (SELECT *, CASE WHEN len(categories) = 0 THEN NULL
                       WHEN doc_id % 3 = 0 THEN {_JOINED} || ' ' || {_JOINED}
                       ELSE {_JOINED} END AS cj FROM scs)),
annc AS (SELECT *, coalesce({_ws('lower("Categories")')}, []::VARCHAR[]) AS cats FROM ann)"""


def _onehot_cols(src_list: str = "cats") -> str:
    return ", ".join(f"CAST(len(list_filter({src_list}, lambda c: c = {_q(c)})) AS INTEGER) AS {c}"
                     for c in CATEGORIES)


_W = "[" + ", ".join(repr(w) for w in C.linear_head_weights()) + "]::DOUBLE[]"


def _vocab(src: str = "documents") -> str:
    return f"""vt AS (SELECT unnest({_tok('text')}) AS token FROM {src}),
vc AS (SELECT token, count(*) AS n FROM vt GROUP BY token),
voc AS (SELECT token, n, CAST(row_number() OVER (ORDER BY n DESC, token) + 3 AS BIGINT) AS id FROM vc)"""


ML = C.MAX_LEN


def _poisson_ctes() -> str:
    return f"""c AS (SELECT label, count(*) AS n_c FROM lab GROUP BY label),
kk AS (SELECT count(*) AS k_cls, sum(n_c) AS n_all FROM c),
lam AS (SELECT label, CAST(n_all AS DOUBLE) / (k_cls * n_c) AS lam FROM c, kk),
dr AS (SELECT label, greatest(1, ceil(lam / 8))::BIGINT AS m FROM lam),
jj AS (SELECT range AS j FROM range(64)),
lf AS (SELECT j, sum(CASE WHEN j = 0 THEN 0.0 ELSE ln(j) END) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lf FROM jj),
pm AS (SELECT label, j, exp(-(lam / m) + j * ln(lam / m) - lf) AS p FROM lam JOIN dr USING (label), lf),
cdf AS (SELECT label, j, sum(p) OVER (PARTITION BY label ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cdf FROM pm),
rd AS (SELECT doc_id, lab.label, unnest(range(m)) AS d FROM lab JOIN dr ON lab.label = dr.label),
u AS (SELECT doc_id, label, d, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{I.SEED}'
        || CASE WHEN d = 0 THEN '' ELSE ':' || CAST(d AS VARCHAR) END), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0 AS u FROM rd),
uk AS (
  SELECT u.doc_id, u.label, u.d, (SELECT count(*) FROM cdf WHERE cdf.label = u.label AND cdf.cdf <= u.u) AS k FROM u)"""


def _channel_spec() -> str:
    """Pages whose tokens, space-joined, hold a term of their language, on a platform, under a path."""
    terms = " OR ".join(
        f"(lang = {_q(l)} AND (" + " OR ".join(
            f"contains(toks, {_q(' ' + ' '.join(t.replace('-', ' ').split()) + ' ')})" for t in ts) + "))"
        for l, ts in C.CHANNEL_TERMS.items())
    path = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*(/[^?#]*)?', 1)"
    places = " OR ".join(
        f"(source = {_q(n)}" + ("" if not v["path"] else " AND (" + " OR ".join(
            f"starts_with({path}, {_q(x)})" for x in v["path"]) + ")") + ")"
        for n, v in C.CHANNEL_SPEC["search_parameters"]["platform"].items())
    return f"""WITH p AS (SELECT page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  regexp_extract(url, 'example\\.[a-z]+', 0) AS source, ' ' || array_to_string({_tok('html')}, ' ') || ' ' AS toks FROM pages)
SELECT page_id, lang, source FROM p WHERE ({terms}) AND ({places})"""


ORACLE: dict[str, str] = {
    "flagship_compare": f"""WITH {SCORED},
a AS (SELECT 'lexicon' AS classifier, {_counts_sql('pred_lex')} FROM sc
      UNION ALL SELECT 'logistic', {_counts_sql('pred_lm')} FROM sc),
g AS (SELECT avg(CASE WHEN pred_lex = pred_lm THEN 1.0 ELSE 0.0 END) AS agreement FROM sc)
SELECT classifier, {_metric_sql()}, round(agreement, 6) AS agreement FROM a, g""",

    "lex_score": f"""WITH {LEX_DOCS}
SELECT doc_id, hits, round(toxicity, 6) AS toxicity, pred FROM lexs""",

    "lex_categories": f"""WITH {LEX_DOCS}
SELECT doc_id, array_to_string(categories, ' ') AS categories, array_to_string(matched_terms, ' ') AS terms FROM lexs""",

    "lex_channel_search": f"""SELECT doc_id, lang, source FROM documents
WHERE lang = 'en' AND len(list_filter({_tok('text')}, lambda t: t IN {_in_list(t for t, _, _ in I.LEXICON_ROWS)})) > 0
  AND source IN {_in_list(C.CHANNEL_PLATFORMS)}""",

    "lex_channel_spec": _channel_spec(),

    "lex_path_filter": "SELECT page_id, url FROM pages WHERE "
        + " OR ".join(f"starts_with(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]*(/[^?#]*)?', 1), {_q(p)})"
                      for p in C.PATH_PREFIXES),

    "join_align_predictions": f"WITH {SCORED} SELECT doc_id, label, pred_lex, pred_lm FROM sc",

    "eval_confusion_matrix": f"""WITH {SCORED}
SELECT l.label, p.pred, CAST(count(sc.doc_id) AS BIGINT) AS n
FROM (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) p(pred)
LEFT JOIN sc ON sc.label = l.label AND sc.pred_lex = p.pred GROUP BY l.label, p.pred""",

    "eval_metrics": f"""WITH {SCORED}, a AS (SELECT {_counts_sql('pred_lex')} FROM sc)
SELECT {_metric_sql()} FROM a""",

    "eval_metrics_by_group": f"""WITH {SCORED}, a AS (SELECT lang, {_counts_sql('pred_lm')} FROM sc GROUP BY lang)
SELECT lang, {_metric_sql()} FROM a""",

    "eval_agreement": f"""WITH {SCORED}
SELECT count(*) AS n, round(avg(CASE WHEN pred_lex = pred_lm THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM sc""",

    "eval_bce_loss": f"""WITH {SCORED},
b AS (SELECT label::DOUBLE AS y,
        greatest(-z, 0.0) + ln(1 + exp(-abs(z))) AS sp_neg,
        greatest(z, 0.0) + ln(1 + exp(-abs(z))) AS sp_pos FROM sc)
SELECT count(*) AS n, round(avg(1.0 * y * sp_neg + (1.0 - y) * sp_pos), 6) AS loss,
       round(avg(2.0 * y * sp_neg + (1.0 - y) * sp_pos), 6) AS loss_pw2 FROM b""",

    "eval_epoch_batch_mean": f"""WITH {SCORED},
b AS (SELECT *, (row_number() OVER (ORDER BY md5('{I.SEED}:0:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) // {I.BATCH_SIZE} AS batch_id FROM sc),
pb AS (SELECT batch_id, {_counts_sql('pred_lm')} FROM b GROUP BY batch_id),
m AS (SELECT {_metric_sql(rounded=False)} FROM pb)
SELECT count(*) AS n_batches, CAST(sum(n) AS BIGINT) AS n,
  round(sum(accuracy * n) / sum(n), 6) AS accuracy, round(sum(precision * n) / sum(n), 6) AS precision,
  round(sum(recall * n) / sum(n), 6) AS recall, round(sum(f1 * n) / sum(n), 6) AS f1 FROM m""",

    "scr_sigmoid_predict": f"""WITH {SCORED}, p AS (SELECT doc_id, z, 1.0 / (1.0 + exp(-z)) AS prob FROM sc)
SELECT doc_id, round(z, 6) AS z, round(prob, 6) AS prob,
       CASE WHEN NOT isnan(prob) AND prob > 0.5 THEN 1 ELSE 0 END AS pred FROM p""",

    "scr_linear_head": f"""WITH h AS (
  SELECT vec_id, list_reduce(list_transform(range(1, len(embedding) + 1),
           lambda i: CAST(embedding[i] AS DOUBLE) * ({_W})[i]), lambda a, b: a + b) + CAST({C.LINEAR_HEAD_BIAS!r} AS DOUBLE) AS z
  FROM embeddings)
SELECT vec_id, round(z, 6) AS z, CASE WHEN NOT isnan(z) AND z > 0 THEN 1 ELSE 0 END AS pred FROM h""",

    "err_cell_filter": f"""WITH {SCORED}, c AS (SELECT doc_id, label, pred_lex AS pred FROM sc)
SELECT doc_id, label, pred, {_CELL} AS cell FROM c""",

    "err_confusion_samples": _conf_samples("pred_lex"),

    "err_disagreement_filter": f"""WITH {SCORED}
SELECT doc_id, label, pred_lm, pred_lex, {_DIS_CELL} AS cell FROM sc WHERE pred_lm <> pred_lex""",

    "err_disagreement_samples": f"""WITH {SCORED},
d AS (SELECT doc_id, text, label, pred_lm, pred_lex, {_DIS_CELL} AS cell FROM sc WHERE pred_lm <> pred_lex),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {_md5('doc_id')}, doc_id) AS rn FROM d),
s AS (SELECT * FROM r WHERE rn <= {N})
SELECT CAST(row_number() OVER (ORDER BY {_DIS_ORDER}, rn) - 1 AS BIGINT) AS row_id, cell, doc_id, text, label, pred_lm, pred_lex FROM s""",

    "set_union_tagged": f"""SELECT 'lexicon' AS classifier, cell, doc_id, label, pred FROM ({_conf_samples('pred_lex')})
UNION ALL
SELECT 'logistic' AS classifier, cell, doc_id, label, pred FROM ({_conf_samples('pred_lm')})""",

    "snk_tsv_samples": _conf_samples("pred_lex"),

    "src_csv_roundtrip": "SELECT doc_id, '  ' || text || chr(9) AS text, lang, source FROM documents",

    "src_json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",

    "view_split": f"WITH {SPLIT_LAB} SELECT doc_id, text, label FROM spl WHERE split = 'test'",

    "ml_checkpoint_reload": f"WITH {SPLIT_LAB} SELECT doc_id, label, TRUE AS same FROM spl WHERE split = 'test'",

    "view_split_partitioned": f"WITH {SPLIT_LAB} SELECT doc_id, text, label FROM spl WHERE split = 'val'",

    "prj_select": f"WITH {LABELED} SELECT doc_id, lang, source, label FROM lab",

    "prj_rename_class_label": "SELECT vec_id, label AS class, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label FROM embeddings",

    "prj_threshold_strict": f"""WITH {LEX_DOCS}
SELECT doc_id, round(toxicity, 6) AS toxicity, CASE WHEN NOT isnan(toxicity) AND toxicity > 0.5 THEN 1 ELSE 0 END AS label FROM lexs""",

    "prj_threshold_inclusive": f"""WITH {LEX_DOCS}
SELECT doc_id, round(toxicity, 6) AS toxicity, CASE WHEN NOT isnan(toxicity) AND toxicity >= 0.5 THEN 1 ELSE 0 END AS label FROM lexs""",

    "prj_label_from_string": f"""SELECT event_id, event_type, CASE WHEN event_type = {_q(C.ADVERSARIAL_POSITIVE)} THEN 1 ELSE 0 END AS label FROM events""",

    "prj_replace_value": "SELECT conv_id, turn, CASE " + " ".join(
        f"WHEN role = {_q(a)} THEN {_q(b)}" for a, b in C.ROLE_REPLACE.items()) + " ELSE role END AS role FROM conversations",

    "prj_lower_columns": "SELECT event_id, user_id AS userid, event_type AS eventtype FROM events",

    "prj_sanitize_label": f"""WITH {DIRTY_EVENTS}
SELECT event_id, label_raw,
  CASE WHEN TRY_CAST(label_raw AS DOUBLE) IN (0, 1) THEN CAST(TRY_CAST(label_raw AS DOUBLE) AS INTEGER) ELSE 0 END AS label FROM de""",

    "prj_numeric_guard": f"""WITH {DIRTY_EVENTS}
SELECT event_id,
  coalesce(CASE WHEN isnan(TRY_CAST(toxicity_raw AS DOUBLE)) THEN 0.0 ELSE TRY_CAST(toxicity_raw AS DOUBLE) END, 0.0) AS toxicity FROM de""",

    "prj_fill_cast": f"WITH {DIRTY_EVENTS} SELECT event_id, CAST(coalesce(CASE WHEN isnan(n_raw) THEN 0 ELSE n_raw END, 0) AS INTEGER) AS n FROM de",

    "arr_split_categories": f"WITH {ANNOTATIONS} SELECT doc_id, array_to_string(cats, ' ') AS categories FROM annc",

    "agg_multilabel_long": f"""SELECT p_partkey, category, count(*) AS n FROM (
  SELECT p_partkey, unnest({_ws('lower(p_name)')}) AS category FROM part) GROUP BY p_partkey, category""",

    "agg_multilabel_onehot": f"WITH {ANNOTATIONS} SELECT doc_id, {_onehot_cols()} FROM annc WHERE len(cats) > 0",

    "join_left_categories": f"WITH {ANNOTATIONS} SELECT doc_id, {_onehot_cols()} FROM annc",

    "agg_category_counts": f"""WITH {ANNOTATIONS}
SELECT category, count(*) AS n FROM (SELECT unnest({_ws("coalesce(\"Categories\", 'nan')")}) AS category FROM ann) GROUP BY category""",

    "prep_annotations": f"""WITH {ANNOTATIONS}
SELECT doc_id, "Text" AS text,
  CASE WHEN TRY_CAST("Label" AS DOUBLE) IN (0, 1) THEN CAST(TRY_CAST("Label" AS DOUBLE) AS INTEGER) ELSE 0 END AS label,
  "Split" AS split,
  coalesce(CASE WHEN isnan(TRY_CAST("Toxicity" AS DOUBLE)) THEN 0.0 ELSE TRY_CAST("Toxicity" AS DOUBLE) END, 0.0) AS toxicity,
  {_onehot_cols()}
FROM annc""",

    "agg_annotator_rollup": f"WITH {ROLLUP} SELECT user_id, round(score, 6) AS score, event_type FROM ru",

    "prep_scored_comments": f"""WITH {ROLLUP},
rl AS (SELECT *, CASE WHEN NOT isnan(score) AND score > 0.5 THEN 1 ELSE 0 END AS label FROM ru),
{split_ctes('rl', 'user_id', 'label', 'rs')}
SELECT user_id, round(score, 6) AS score, event_type, label, split FROM rs""",

    "agg_profile_counts": """
SELECT 'documents.text' AS target, count(*) AS n_rows, CAST(count(DISTINCT text) + max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct FROM documents
UNION ALL
SELECT 'events.user_id', count(*), CAST(count(DISTINCT user_id) + max(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM events
UNION ALL
SELECT 'labels.doc_id', count(*), CAST(count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) FROM labels""",

    "agg_value_counts": "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type",

    "agg_class_share": f"""WITH {SPLIT_LAB},
g AS (SELECT split, label, count(*) AS n FROM spl GROUP BY split, label
      UNION ALL SELECT 'all', label, count(*) FROM spl GROUP BY label)
SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split), 6) AS share FROM g""",

    "agg_label_pred_counts": f"""WITH {SCORED}
SELECT 'label' AS variable, CAST(label AS BIGINT) AS value, count(*) AS n FROM sc GROUP BY label
UNION ALL SELECT 'pred_lex', CAST(pred_lex AS BIGINT), count(*) FROM sc GROUP BY pred_lex
UNION ALL SELECT 'pred_lm', CAST(pred_lm AS BIGINT), count(*) FROM sc GROUP BY pred_lm""",

    "agg_histogram_30": f"""WITH x AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
st AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
              CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM x),
p AS (SELECT lo, (hi - lo) / {C.HIST_BINS} AS w FROM st),
c AS (SELECT CAST(least(floor((v - lo) / w), {C.HIST_BINS - 1}) AS INTEGER) AS bin, count(*) AS n FROM x, p GROUP BY 1),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({C.HIST_BINS}))
SELECT g.bin, round(lo + g.bin * w, 6) AS lo, round(lo + (g.bin + 1) * w, 6) AS hi, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g CROSS JOIN p LEFT JOIN c ON g.bin = c.bin""",

    "agg_kde_grid": f"""WITH x AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM x),
p AS (SELECT n, lo, hi, sd * pow(n, -0.2) AS bw, (hi - lo) / {C.KDE_FINE_BINS} AS w, (hi - lo) / {C.KDE_GRID - 1} AS step FROM st),
b AS (SELECT least(floor((v - lo) / w), {C.KDE_FINE_BINS - 1}) AS b, count(*) AS m FROM x, p GROUP BY 1),
c AS (SELECT lo + (b + 0.5) * w AS c, m FROM b, p),
g AS (SELECT CAST(range AS INTEGER) AS grid, lo + range * step AS gx FROM p, range({C.KDE_GRID}))
SELECT grid, round(gx, 6) AS x,
  round(sum(m * exp(-0.5 * pow((gx - c) / bw, 2.0))) * (1.0 / (n * bw * sqrt(2.0 * pi()))), 9) AS density
FROM g, c, p GROUP BY grid, gx, n, bw""",

    "agg_kde_exact": f"""WITH x AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)),
st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM x),
p AS (SELECT n, lo, sd * pow(n, -0.2) AS bw, (hi - lo) / {C.KDE_GRID - 1} AS step FROM st),
g AS (SELECT CAST(range AS INTEGER) AS grid, lo + range * step AS gx, n, bw FROM p, range({C.KDE_GRID}))
SELECT grid, round(gx, 6) AS x,
  round(sum(exp(-0.5 * pow((gx - v) / bw, 2.0))) * (1.0 / (n * bw * sqrt(2.0 * pi()))), 9) AS density
FROM g, x GROUP BY grid, gx, n, bw""",

    "smp_stratified_split": f"WITH {SPLIT_LAB} SELECT doc_id, label, split FROM spl",

    "smp_split_balance": f"WITH {SPLIT_LAB} SELECT split, label, count(*) AS n FROM spl GROUP BY split, label",

    "smp_class_weights": f"""WITH {LABELED}, c AS (SELECT label, count(*) AS n FROM lab GROUP BY label)
SELECT doc_id, lab.label, round(1.0::DOUBLE / c.n, 9) AS weight FROM lab JOIN c ON lab.label = c.label""",

    "smp_balanced_resample": f"""WITH {LABELED}, {_poisson_ctes()}
SELECT doc_id, label, CAST(d * 65536 + unnest(generate_series(1, k)) AS BIGINT) AS copy FROM uk WHERE k > 0""",

    # draw d: the class of floor(2 u) among the labels, then the row of rank floor(n v) in it by md5(key:seed)
    "smp_exact_resample": f"""WITH {LABELED},
ranked AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || ':{I.SEED}'), doc_id) AS rk FROM lab),
cls AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS c, count(*) OVER () AS k FROM lab GROUP BY label),
d AS (SELECT unnest(range((SELECT count(*) FROM lab))) AS id),
u AS (SELECT id, CAST('0x' || substr(md5('{I.SEED}:' || id || ':class'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS uc,
             CAST('0x' || substr(md5('{I.SEED}:' || id || ':row'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS ur FROM d),
p AS (SELECT cls.label, least(CAST(floor(ur * n) AS BIGINT), n - 1) + 1 AS rk FROM u JOIN cls ON cls.c = least(CAST(floor(uc * k) AS BIGINT), k - 1))
SELECT r.doc_id, r.label, CAST(row_number() OVER (PARTITION BY r.doc_id) AS BIGINT) AS copy
FROM p JOIN ranked r ON r.label = p.label AND r.rk = p.rk""",

    "smp_epoch_shards": f"""WITH o AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5('{I.SEED}:0:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS BIGINT) AS pos FROM orders)
SELECT o_orderkey, pos, CAST((pos - 1) // {I.BATCH_SIZE} AS BIGINT) AS batch_id FROM o""",

    "txt_encode_hashed": f"""WITH e AS (SELECT doc_id, list_transform(({_tok('text')})[1:{ML - 2}],
  lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {C.HASH_BUCKETS} + 4) AS ids FROM documents),
f AS (SELECT doc_id, [0::BIGINT] || ids || [2::BIGINT] AS seq FROM e)
SELECT doc_id, array_to_string(seq || list_transform(range({ML} - len(seq)), lambda i: 1::BIGINT), ' ') AS input_ids,
       CAST(len(seq) AS INTEGER) AS n_mask FROM f""",

    "src_csv_inferred": f"""WITH e AS (SELECT event_id AS i, event_type, value, event_id % 11 IN (5, 7) AS bad, event_id >= {C.LATE_EVENT} AS late FROM events)
SELECT CASE WHEN NOT bad THEN i END::INTEGER AS id, CASE WHEN NOT bad THEN i * 3000000000 END::BIGINT AS big,
  CASE WHEN NOT bad AND i % 7 <> 2 THEN i % 2 = 0 END AS flag,
  CASE WHEN NOT bad AND i % 7 <> 3 THEN CASE WHEN late THEN round(value, 2) ELSE i % 100 END END::DOUBLE AS amount,
  CASE WHEN NOT bad AND i % 7 <> 4 THEN CASE WHEN late THEN 'c' ELSE '' END || (i % 10) END AS code,
  CASE WHEN NOT bad THEN event_type || ', said "x"' END AS note,
  CASE WHEN i % 11 = 7 THEN length(i::VARCHAR)
       WHEN i % 11 = 5 THEN length(concat_ws(',', i, i * 3000000000, CASE WHEN i % 7 = 2 THEN 'NA' ELSE (i % 2 = 0)::VARCHAR END,
         CASE WHEN i % 7 = 3 THEN '' WHEN late THEN round(value, 2)::VARCHAR ELSE (i % 100)::VARCHAR END,
         CASE WHEN i % 7 = 4 THEN 'n/a' WHEN late THEN 'c' || (i % 10) ELSE (i % 10)::VARCHAR END,
         '"' || event_type || ', said ""x""' || '"', 'surplus')) END::INTEGER AS corrupt_chars,
  'int,bigint,boolean,double,string,string,string' AS types FROM e""",

    "src_json_export": f"""SELECT CASE WHEN i % 13 <> 6 THEN i END AS id,
  CASE WHEN i % 13 <> 6 AND i % 5 <> 1 THEN event_type END AS author_name, CASE WHEN i % 13 <> 6 AND i % 5 <> 1 THEN user_id END AS author_no,
  CASE WHEN i % 13 <> 6 AND i % 3 = 0 THEN user_id || ' ' || i END AS refs,
  CASE WHEN i % 13 <> 6 AND i >= {C.LATE_EVENT} THEN round(value, 6) END AS score,
  CASE WHEN i % 13 <> 6 THEN CASE i % 4 WHEN 0 THEN '7' WHEN 1 THEN 'seven' WHEN 2 THEN '{{"n":7}}' END END AS extra,
  CASE WHEN i % 13 = 6 THEN 'broken ' || i END AS corrupt
FROM (SELECT *, event_id AS i FROM events)""",

    "join_align_by_position": f"""WITH {SCORED}
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS pos, doc_id, label, pred_lex AS pred FROM sc""",

    "agg_merged_profile": """SELECT event_type, count(*) AS n, CAST(0 AS BIGINT) AS n_null, TRUE AS within_bound
FROM events GROUP BY event_type""",

    "ml_resumed_training": f"""WITH {SPLIT_LAB} SELECT doc_id, label, TRUE AS same_model, TRUE AS same_log, TRUE AS rule_holds,
  TRUE AS best_is_least FROM spl WHERE split = 'test'""",

    "ml_text_checks": f"""WITH {SPLIT_LAB}
SELECT split, count(*) AS n, count_if(label = 1) AS positives, CAST((count(*) + {I.BATCH_SIZE - 1}) // {I.BATCH_SIZE} AS BIGINT) AS n_batches,
  CASE WHEN split = 'train' THEN round(avg(label), 3) END AS mean_prob, CASE WHEN split = 'train' THEN TRUE END AS beats_base, TRUE AS pred_follows_logit,
  TRUE AS metrics_follow_cells, TRUE AS accuracy_is_batch_mean FROM spl GROUP BY split""",

    "ml_epoch_checks": f"""WITH {SPLIT_LAB}
SELECT split, m.metric, count(*) AS n, TRUE AS every_epoch, TRUE AS rule_holds,
  CASE WHEN split = 'val' THEN TRUE END AS logged_is_scored
FROM spl JOIN (VALUES ('loss'), ('accuracy'), ('precision'), ('recall'), ('f1')) m(metric)
  ON split = 'val' OR (split = 'train' AND m.metric = 'loss') GROUP BY split, m.metric""",

    # Gradient descent with momentum on the same objective: balanced log-loss, penalty on all but the intercept.
    "ml_fit_embedding_head": f"""WITH RECURSIVE emb AS (
  SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label,
    list_append(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), CAST(1 AS DOUBLE)) AS x FROM embeddings),
{split_ctes('emb', 'vec_id', 'label', 'es')},
cls AS (SELECT count(*) AS n, count_if(label = 1) AS pos, max(len(x)) AS d FROM es WHERE split = 'train'),
tr AS (SELECT x, label, CASE WHEN label = 1 THEN 0.5 / pos ELSE 0.5 / (n - pos) END AS wt FROM es, cls WHERE split = 'train'),
gd AS (
  SELECT 0 AS i, list_transform(range(d), lambda k: CAST(0 AS DOUBLE)) AS w, list_transform(range(d), lambda k: CAST(0 AS DOUBLE)) AS v FROM cls
  UNION ALL
  SELECT i + 1, list(w + dv ORDER BY k), list(dv ORDER BY k) FROM (
    SELECT i, k, d, any_value(w) AS w,
      0.6 * any_value(v) - 4.0 * (sum(r * xk) + CASE WHEN k < d THEN {M.HEAD_REG} * any_value(w) ELSE 0 END) AS dv
    FROM (SELECT i, d, unnest(range(1, d + 1)) AS k, unnest(gd.w) AS w, unnest(gd.v) AS v, unnest(tr.x) AS xk,
            wt * (1 / (1 + exp(-list_dot_product(gd.w, tr.x))) - label) AS r FROM gd, tr, cls WHERE i < {HEAD_STEPS})
    GROUP BY i, k, d) GROUP BY i),
h AS (SELECT vec_id, label, list_dot_product(w, x) AS z FROM es, gd WHERE i = {HEAD_STEPS} AND split <> 'train')
SELECT vec_id, label, round(1 / (1 + exp(-z)), 4) AS prob, CASE WHEN z > 0 THEN 1 ELSE 0 END AS pred FROM h""",

    "ml_score_external": f"""WITH h AS (
  SELECT vec_id, list_reduce(list_transform(range(1, len(embedding) + 1),
           lambda i: CAST(embedding[i] AS DOUBLE) * ({_W})[i]), lambda a, b: a + b) + CAST({C.LINEAR_HEAD_BIAS!r} AS DOUBLE) AS z
  FROM embeddings)
SELECT vec_id, round(z, 6) AS z, CASE WHEN NOT isnan(z) AND z > 0 THEN 1 ELSE 0 END AS pred FROM h""",

    "smp_shuffle_order": f"""SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5('{I.SEED}:{C.SHUFFLE_EPOCH}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS BIGINT) AS pos FROM orders""",

    "smp_batches": f"""WITH o AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5('{I.SEED}:0:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS BIGINT) AS pos FROM orders)
SELECT o_orderkey, pos, CAST((pos - 1) // {I.BATCH_SIZE} AS BIGINT) AS batch_id FROM o""",

    "txt_vocab": f"WITH {_vocab()} SELECT token, n, id FROM voc",

    "txt_encode_fixed": f"""WITH {_vocab()},
e AS (SELECT doc_id, ({_tok('text')})[1:{ML - 2}] AS toks FROM documents),
x AS (SELECT doc_id, unnest(toks) AS token, unnest(generate_series(1, len(toks))) AS pos FROM e),
ids AS (SELECT x.doc_id, list(coalesce(voc.id, 3) ORDER BY x.pos) AS ids FROM x LEFT JOIN voc ON x.token = voc.token GROUP BY x.doc_id),
f AS (SELECT d.doc_id, [0::BIGINT] || coalesce(ids.ids, []::BIGINT[]) || [2::BIGINT] AS seq FROM documents d LEFT JOIN ids ON d.doc_id = ids.doc_id)
SELECT doc_id, array_to_string(seq || list_transform(range({ML} - len(seq)), lambda i: 1::BIGINT), ' ') AS input_ids,
       CAST(len(seq) AS INTEGER) AS n_mask FROM f""",

    "txt_truncation_profile": f"""WITH s AS (SELECT len({_tok('text')}) AS len FROM documents),
h AS (SELECT len, count(*) AS c FROM s GROUP BY len),
hc AS (SELECT len, c, sum(c) OVER (ORDER BY len ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, sum(c) OVER () AS total FROM h)
SELECT CAST(max(total) AS BIGINT) AS n_docs, round(sum(len * c) / max(total), 6) AS mean_tokens,
  CAST(min(CASE WHEN cum >= (total * 50 + 99) // 100 THEN len END) AS BIGINT) AS p50,
  CAST(min(CASE WHEN cum >= (total * 90 + 99) // 100 THEN len END) AS BIGINT) AS p90,
  CAST(min(CASE WHEN cum >= (total * 99 + 99) // 100 THEN len END) AS BIGINT) AS p99,
  CAST(max(len) AS BIGINT) AS max_tokens,
  round(sum(CASE WHEN len > {ML - 2} THEN c ELSE 0 END) / max(total), 6) AS share_truncated,
  {ML} AS max_len FROM hc""",

    "prep_tweets": f"""WITH tw AS (
  SELECT doc_id, CAST(doc_id % 3 AS INTEGER) AS class, text, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS label
  FROM documents),
{split_ctes('tw', 'doc_id', 'label', 'tws')}
SELECT doc_id, class, text, label, split FROM tws""",

    "prep_adversarial": f"""SELECT 'e' || CAST(event_id AS VARCHAR) AS "acl.id", props AS text,
  CASE WHEN event_type = {_q(C.ADVERSARIAL_POSITIVE)} THEN 1 ELSE 0 END AS label, event_type AS type,
  CASE WHEN user_id % 2 = 0 THEN 'original' ELSE 'perturbed' END AS level,
  CASE WHEN event_id % 10 < 8 THEN 'train' WHEN event_id % 10 = 8 THEN 'val' ELSE 'test' END AS split
FROM events""",
}

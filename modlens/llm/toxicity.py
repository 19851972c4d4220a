"""Toxicity by classifier chains over word features.

Categories are predicted one after the other: each category's linear (logistic) model reads the
text's words and the probabilities of the categories before it. For training, those probabilities
are out-of-fold predictions, so that a later model learns from the kind of input it will meet.

Fitting uses a bounded sample: the ``SAMPLE`` labelled rows with the smallest id hashes. Words are the
runs of letters, digits and non-ASCII bytes with A-Z lowered, so punctuation and noise around a word
don't hide it; a text's features are which of the vocabulary's words it has. The vocabulary is, per
category, the ``VOCABULARY`` words whose share among the sample's positives and negatives differs
most. All texts are scored whole, map-only, with the models broadcast (bounded by the vocabulary).

Nulls and ties: a null or empty text has no words and gets the models' base probabilities; rows of the
label table without an id, a text, or any of the labels teach nothing; repeated rows are each
scored, and each counts in fitting if labelled; equal words rank by hash; without labelled rows, or
with one value only, a category's probability is the smoothed share of positives.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.llm.common import SLICE_BYTES, hash_sample, schema_with, slices, span_hashes, stored, utf8, words
from modlens.llm.decontaminate import FOLD

SAMPLE, VOCABULARY, FOLDS, MIN_DOCS = 20_000, 1024, 5, 5
ROUNDS, L2 = 300, 0.1


def row_words(col: pa.Array):
    """(row, sorted distinct word hashes) of every text."""
    raw, offs = utf8(col)
    for a, b in slices(offs):
        lo, hi = int(offs[a]), int(offs[b])
        if b == a + 1 and hi - lo > 2 * SLICE_BYTES:
            got, at = [], lo
            while at < hi:
                to = min(at + SLICE_BYTES, hi)
                while to < hi and FOLD[raw[to]] != 32:  # not inside a word
                    to += 1
                x = FOLD[raw[at:to]]
                s, e, _ = words(x, np.array([0, len(x)]))
                got.append(np.unique(span_hashes(x, s, e)))
                at = to
            yield a, np.unique(np.concatenate(got))
            continue
        x = FOLD[raw[lo:hi]]
        s, e, counts = words(x, offs[a:b + 1] - lo)
        h = span_hashes(x, s, e)
        at = 0
        for i, n in enumerate(counts.tolist()):
            g = np.sort(h[at:at + n])
            yield a + i, g[np.concatenate(([True], g[1:] != g[:-1]))] if n else g
            at += n


def sampled(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str, text_col: str,
            size: int) -> DataFrame:
    """(y, fold, words) of the labelled sample; its ids are broadcast (at most ``size`` rows)."""
    usable = (labels.where(F.col(id_col).isNotNull())
              .where(" and ".join(f"`{c}` is not null" for c in categories))
              .select(F.col(id_col).alias("__id"), F.array(*[F.col(f"`{c}`").cast("int") for c in categories]).alias("y")))
    chosen = hash_sample(usable, "__id", size)
    rows = (docs.where(F.col(text_col).isNotNull())
            .join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
            .select("y", F.pmod(F.crc32(F.col("__id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int").alias("fold"),
                    F.col(text_col).alias("text")))

    def features(batches):
        for batch in batches:
            got: list = [np.empty(0, np.int64)] * batch.num_rows
            for i, g in row_words(batch.column(2)):
                got[i] = g.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int64()))], ["y", "fold", "words"])

    return stored(rows.mapInArrow(features, "y array<int>, fold int, words array<bigint>"), "labelled-words")


def vocabulary(rows: DataFrame, n_categories: int, per_category: int) -> np.ndarray:
    """Sorted hashes of the words that tell a category's positives best (by the two-proportion score)."""
    y = [F.sum(F.col("y")[j]) for j in range(n_categories)]
    total = rows.agg(F.count(F.lit(1)).alias("n"), *[v.alias(f"p{j}") for j, v in enumerate(y)]).first()
    if not total["n"]:
        return np.empty(0, np.int64)
    counts = (rows.select("y", F.explode("words").alias("w")).groupBy("w")
              .agg(F.count(F.lit(1)).alias("n"), *[v.alias(f"p{j}") for j, v in enumerate(y)])
              .where(F.col("n") >= MIN_DOCS))
    out: set[int] = set()
    for j in range(n_categories):
        pos = int(total[f"p{j}"] or 0)
        if not 0 < pos < total["n"]:
            continue
        rate = pos / total["n"]
        score = F.abs(F.col(f"p{j}") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
        out.update(r["w"] for r in counts.orderBy(score.desc(), "w").limit(per_category).select("w").collect())
    return np.array(sorted(out), np.int64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Which features each row has, as one flat index."""

    def __init__(self, lists: list[np.ndarray], n_features: int):
        size = np.array([len(x) for x in lists], np.int64)
        self.n, self.n_features = len(lists), n_features
        self.flat = np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(self.n), size)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.flat], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, weights=r[self.row], minlength=self.n_features)


def fit(x: Rows, extra: np.ndarray, y: np.ndarray, use: np.ndarray, rounds: int = ROUNDS, l2: float = L2) -> np.ndarray:
    """Weights (features, extra columns, intercept) of a ridge logistic regression on the rows in ``use``,
    by accelerated gradient steps. The data is the bounded sample, so this is driver work."""
    k = extra.shape[1]
    share = (y[use].sum() + 1) / (use.sum() + 2)
    w = np.zeros(x.n_features + k + 1)
    w[-1] = np.log(share / (1 - share))
    if len(np.unique(y[use])) < 2:
        return w
    # A bound of the curvature per coordinate: the rows that have it times their mean row length.
    length = np.bincount(x.row, minlength=x.n) + k + 1
    weight = use * length / 4
    step = 1 / (np.concatenate((x.back(weight), (np.abs(extra) * weight[:, None]).sum(0), [weight.sum()])) + l2)
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        r = use * (sigmoid(x.times(v) + extra @ v[x.n_features:-1] + v[-1]) - y)
        g = np.concatenate((x.back(r), extra.T @ r, [r.sum()])) + l2 * np.append(v[:-1], 0)
        new = v - step * g
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def predict(x: Rows, extra: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x.times(w) + extra @ w[x.n_features:-1] + w[-1])


def learn(rows: DataFrame, n_categories: int, per_category: int = VOCABULARY) -> tuple[np.ndarray, list[np.ndarray]]:
    """(vocabulary, weights per category) of the chain."""
    known = vocabulary(rows, n_categories, per_category)
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def narrow(batches):
        known = shared.value
        for batch in batches:
            got = [np.flatnonzero(np.isin(known, w.values.to_numpy(zero_copy_only=False), assume_unique=True)).astype(np.int32)
                   for w in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.int32()))], ["y", "fold", "has"])

    sample = rows.mapInArrow(narrow, "y array<int>, fold int, has array<int>").orderBy("fold", "y", "has").toArrow()
    has = [w.values.to_numpy(zero_copy_only=False) if w.is_valid else np.empty(0, np.int32)
           for w in sample.column("has").combine_chunks()] if sample.num_rows else []
    x = Rows(has, len(known))
    y = np.array(sample.column("y").to_pylist(), float).reshape(-1, n_categories)
    fold = sample.column("fold").to_numpy()
    extra, weights = np.zeros((x.n, 0)), []
    for j in range(n_categories):
        weights.append(fit(x, extra, y[:, j], np.ones(x.n, bool)))
        if j + 1 < n_categories:
            unseen = np.zeros(x.n)
            for f in range(FOLDS):
                unseen[fold == f] = predict(x, extra, fit(x, extra, y[:, j], fold != f))[fold == f]
            extra = np.column_stack((extra, unseen))
    return known, weights


def chain_scores(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("low_quality", "toxic"),
                 id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The other columns with p_<category> for each category, in the chain's order.

    ``labels`` has the id and a 0/1 column per category."""
    known, weights = learn(sampled(docs, labels, categories, id_col, text_col, sample), len(categories))
    model = docs.sparkSession.sparkContext.broadcast((known, weights))
    names = [f"p_{c}" for c in categories]
    others = [c for c in docs.columns if c not in (text_col, *names)]

    def work(batches):
        known, weights = model.value
        for batch in batches:
            has: list = [np.empty(0, np.int64)] * batch.num_rows
            for i, g in row_words(batch.column(text_col)):
                if len(known) and len(g):
                    at = np.searchsorted(known, g.view(np.int64))
                    at[at == len(known)] = 0
                    has[i] = at[known[at] == g.view(np.int64)]
            x = Rows(has, len(known))
            extra = np.zeros((x.n, 0))
            for w in weights:
                extra = np.column_stack((extra, predict(x, extra, w)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), *(pa.array(extra[:, j]) for j in range(len(names)))], [*others, *names])

    return (docs.select(*[F.col(f"`{c}`") for c in others], F.col(text_col))
            .mapInArrow(work, schema_with(docs, others, ", ".join(f"`{n}` double" for n in names))))

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from modlens.llm.common import documents
from modlens.llm.toxicity import FOLDS, L2, Rows, chain_scores, fit, predict


def test_held_out_accuracy(spark):
    """Learn from four fifths of the labels, score the rest."""
    base = "/root/testdata/sf0.1"
    labels = documents(spark, base, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = chain_scores(documents(spark, base).select("doc_id", "text"), labels.where(~rest))
    got = np.array([(r["toxic"], r["p_toxic"]) for r in scored.join(labels.where(rest), "doc_id").collect()])
    y, p = got[:, 0], got[:, 1] >= 0.5
    assert (p & (y == 1)).sum() / (y == 1).sum() > 0.65  # some 350 positives teach; with 20,000 labels 0.96
    assert (p & (y == 0)).sum() / (y == 0).sum() < 0.01


def rows_of(n, seed=0):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        words = [f"w{j}" for j in r.integers(0, 200, 30)] + (["Idiot!!!"] if bad else [])
        rows.append((i, " ".join(words), bad, bool(bad and i % 2)))
    return rows


def test_chain_learns_and_handles_edges(spark, docs_frame, long_text):
    rows = rows_of(300)
    labels = spark.createDataFrame([(i, int(a), int(b)) for i, _, a, b in rows] + [(None, 1, 1), (5000, None, 1), (7000, 1, 1)],
                                   "doc_id bigint, insult int, threat int")
    texts = [(i, t) for i, t, _, _ in rows] + [(5000, "x"), (6000, None), (6001, ""), (6002, long_text + " idiot"), (6003, "idiot"), (6003, "idiot")]
    got = chain_scores(docs_frame(texts, extra=True), labels, ("insult", "threat"))
    assert {"p_insult", "p_threat", "score", "spans"} <= set(got.columns)
    p = {}
    for r in got.collect():
        p.setdefault(r["doc_id"], []).append(r["p_insult"])
    assert all((p[i][0] >= 0.5) == a for i, _, a, _ in rows)
    assert p[6000] == p[6001] and p[6003][0] == p[6003][1] >= 0.5


def test_no_labels_one_value_and_no_rows(spark, docs_frame):
    none = spark.createDataFrame([], "doc_id bigint, a int")
    assert [r["p_a"] for r in chain_scores(docs_frame([(1, "x")]), none, ("a",)).collect()] == [0.5]
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id bigint, a int")
    assert all(r["p_a"] > 0.5 for r in chain_scores(docs_frame([(i, "x y") for i in range(20)]), one, ("a",)).collect())
    assert chain_scores(docs_frame([]), none, ("a",)).collect() == []


def test_fit_reaches_the_optimum():
    r = np.random.default_rng(1)
    x = Rows([np.flatnonzero(r.random(12) < 0.4) for _ in range(400)], 12)
    w0 = r.normal(size=13)
    none = np.zeros((400, 0))
    y = (r.random(400) < predict(x, none, w0)).astype(float)
    use = np.ones(400, bool)
    w = fit(x, none, y, use, rounds=2000)
    g = np.concatenate((x.back(predict(x, none, w) - y), [(predict(x, none, w) - y).sum()])) + L2 * np.append(w[:-1], 0)
    assert np.abs(g).max() < 1e-3
    assert np.abs(fit(x, none, y, use) - w).max() < 0.05


def test_later_models_train_on_out_of_fold_predictions():
    assert FOLDS >= 2


def newton(x, y):
    """The exact optimum of the ridge logistic regression; the last column is the intercept's."""
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, L2), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
    return w


def test_chain_against_a_plain_version(spark, docs_frame):
    """Words by a regular expression, dense matrices, exact optima: every document's probabilities."""
    r = np.random.default_rng(11)
    names = ["alpha", "Beta", "g4mma", "délta", "EPS", "zeta!", "eta.", "theta", "iota", "kappa"]
    texts, labels = [], []
    for i in range(600):
        has = r.random(len(names)) < 0.4
        texts.append((i, ", ".join(n for n, h in zip(names, has) if h) + f" once{i}"))
        first = int(r.random() < 1 / (1 + np.exp(2 - 3 * has[0] - 2 * has[3])))
        labels.append((i, first, int(r.random() < 1 / (1 + np.exp(3 - 3 * first - 2 * has[5])))))
    frame = spark.createDataFrame(labels[:450], "doc_id bigint, first int, second int")
    got = {x["doc_id"]: (x["p_first"], x["p_second"]) for x in chain_scores(docs_frame(texts), frame, ("first", "second")).collect()}

    found = [set(re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))) for _, t in texts]
    known = sorted({w for f in found[:450] for w in f if sum(w in g for g in found[:450]) >= 5})
    assert len(known) == len(names)
    x = np.array([[w in f for w in known] + [True] for f in found], float)
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in range(450)])
    train, every, want = x[:450], x, []
    for j in (1, 2):
        y = np.array([row[j] for row in labels[:450]], float)
        p = 1 / (1 + np.exp(-every @ newton(train, y)))
        want.append(p)
        unseen = np.zeros(450)
        for f in range(FOLDS):
            unseen[fold == f] = 1 / (1 + np.exp(-train[fold == f] @ newton(train[fold != f], y[fold != f])))
        train, every = np.column_stack((unseen, train)), np.column_stack((p, every))
    assert np.abs(np.array([got[i] for i in range(600)]) - np.array(want).T).max() < 0.01

"""Model lifecycle: better than the base rate, determinism, reload, early stopping rule."""

import pytest
from pyspark.sql import functions as F

from modlens.operators import evaluate as ev
from modlens.operators import ml
from modlens.plans import models as M
from modlens.plans.models import split_labeled
from modlens.session import scratch_path

from conftest import SF01


def _data(spark):
    d = split_labeled(spark, SF01).cache()
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "val"), d.where(F.col("split") == "test")


def test_epochs_lower_the_training_loss_and_are_deterministic(spark):
    tr, va, _ = _data(spark)
    _, log = ml.train_epochs(tr, va, scratch_path(spark, "e"), num_features=512, max_epochs=4, patience=10)
    losses = [r.train_loss for r in log]
    assert all(b < a for a, b in zip(losses, losses[1:]))
    assert set(log[0].metrics) == {"accuracy", "precision", "recall", "f1"}
    _, again = ml.train_epochs(tr, va, scratch_path(spark, "e"), num_features=512, max_epochs=4, patience=10)
    assert all(abs(a.val_loss - b.val_loss) < 1e-6 for a, b in zip(log, again))


def test_early_stopping_follows_the_rule_and_keeps_the_best(spark):
    tr, va, _ = _data(spark)
    model, log = ml.train_epochs(tr, va, scratch_path(spark, "e"), num_features=512, max_epochs=12, patience=2, min_delta=1e-4)
    best, wait = float("inf"), 0
    for r in log:
        if r.val_loss < best - 1e-4:
            best, wait = r.val_loss, 0
        else:
            wait += 1
        assert r.wait == wait
        assert r.stopped == (wait >= 2)
    assert log[-1].stopped or len(log) == 12
    kept = ml.score(model, va, "doc_id").agg(F.avg(ev.bce_with_logits("label", "logit"))).first()[0]
    assert abs(kept - min(r.val_loss for r in log)) < 1e-6


def test_pipeline_reload_gives_same_predictions(spark):
    tr, _, te = _data(spark)
    model = ml.fit_text_classifier(tr, reg=0.05, num_features=1 << 12)
    path = ml.save_model(model, scratch_path(spark, "m"))
    a = ml.score(model, te, "doc_id").select("doc_id", "prob")
    b = ml.score(ml.load_model(path), te, "doc_id").select("doc_id", "prob")
    assert a.exceptAll(b).count() == 0


def test_text_model_beats_the_base_rate(spark):
    per = {r["split"]: r for r in M.ml_fit_text(spark, "/root/testdata/sf0.1").collect()}
    for split in ("train", "val", "test"):
        assert per[split]["logloss"] < 0.7 * per[split]["base_logloss"], split


def test_embedding_head_separates_its_classes(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(
        "vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))
    rows = e.withColumn("label", (F.col("embedding")[0] > 0).cast("int"))  # a class the vectors do hold
    model = ml.fit_embedding_head(rows)
    s = ml.score_embedding_head(model, rows, "vec_id")
    assert s.count() == rows.count()
    assert s.where("label = pred").count() > 0.95 * rows.count()


def _toy(spark, n=240):
    rows = [(i, ("bad awful " if i % 3 == 0 else "good fine ") + f"w{i % 11} x{i % 5}", int(i % 3 == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int").repartition(2, "doc_id").persist()
    return df.where("doc_id % 4 <> 0"), df.where("doc_id % 4 = 0")


def test_a_stopped_run_goes_on(spark):
    train, val = _toy(spark)
    whole, path = scratch_path(spark, "whole"), scratch_path(spark, "stopped")
    args = dict(num_features=64, iterations=1, patience=3)
    model, log = ml.train_epochs(train, val, whole, max_epochs=4, **args)
    ml.train_epochs(train, val, path, max_epochs=1, **args)
    ran = []
    again, resumed = ml.train_epochs(train, val, path, max_epochs=4, resume=True, on_epoch=lambda r: ran.append(r.epoch), **args)
    assert ran == [1, 2, 3] and [r.epoch for r in resumed] == [0, 1, 2, 3]
    for a, b in zip(log, resumed):
        assert abs(a.val_loss - b.val_loss) < 1e-9 and (a.improved, a.wait, a.stopped, a.metrics) == (b.improved, b.wait, b.stopped, b.metrics)
    rows = lambda m: [(r["doc_id"], round(r["logit"], 6)) for r in ml.score(m, val, "doc_id").orderBy("doc_id").collect()]
    assert rows(model) == rows(again) == rows(ml.best_model(spark, path))
    # a finished run does no work, and a longer one goes on from its end
    _, same = ml.train_epochs(train, val, path, max_epochs=4, resume=True, on_epoch=lambda r: ran.append(r.epoch), **args)
    assert same == resumed and ran == [1, 2, 3]


def test_an_epoch_without_a_committed_state_is_done_again(spark, monkeypatch):
    train, val = _toy(spark)
    path = scratch_path(spark, "crash")
    args = dict(num_features=64, iterations=1, patience=3)
    commit = ml._commit_state
    monkeypatch.setattr(ml, "_commit_state", lambda s, p, r, *a: (_ for _ in ()).throw(RuntimeError) if r.epoch == 1 else commit(s, p, r, *a))
    with pytest.raises(RuntimeError):
        ml.train_epochs(train, val, path, max_epochs=3, **args)
    monkeypatch.setattr(ml, "_commit_state", commit)
    _, log = ml.train_epochs(train, val, path, max_epochs=3, resume=True, **args)
    assert [r.epoch for r in log] == [0, 1, 2]
    assert spark.read.parquet(f"{path}/state").count() == 3


def test_early_stop_survives_the_interruption(spark):
    train, val = _toy(spark)
    path = scratch_path(spark, "early")
    args = dict(num_features=64, iterations=1, patience=2, min_delta=10.0)  # nothing counts as better but the first epoch
    ml.train_epochs(train, val, path, max_epochs=2, **args)
    _, log = ml.train_epochs(train, val, path, max_epochs=9, resume=True, **args)
    assert [(r.epoch, r.wait, r.stopped) for r in log] == [(0, 0, False), (1, 1, False), (2, 2, True)]
    assert len(ml.train_epochs(train, val, path, max_epochs=9, resume=True, **args)[1]) == 3


def test_external_model_over_text_and_numbers(spark):
    import numpy as np

    def length_model(model):
        per, bias = np.frombuffer(model)

        def predict(texts, times):
            return np.array([len(t) for t in texts]) * per * times + bias
        return predict

    path = ml.write_model_bytes(spark, np.array([0.5, -1.0]).tobytes(), scratch_path(spark, "model"))
    rows = [(1, "abcd", 1.0), (2, "", 3.0), (3, None, 1.0), (4, "xy", None), (5, "ab", 1.0)]
    df = spark.createDataFrame(rows, "k bigint, text string, times double").withColumn("prob", F.lit("clash"))
    got = {r["k"]: (r["logit"], r["pred"]) for r in
           ml.score_external(df, path, length_model, ["text", "times"], ["k"], batch_size=2).collect()}
    assert got == {1: (1.0, 1), 2: (-1.0, 0), 3: (None, 0), 4: (None, 0), 5: (0.0, 0)}
    assert ml.score_external(df.limit(0), path, length_model, ["text", "times"], ["k"]).collect() == []


def test_external_model_is_loaded_once_per_worker(spark):
    import numpy as np

    loads = spark.sparkContext.accumulator(0)

    def load(model):
        loads.add(1)
        return lambda v: v[:, 0] * np.frombuffer(model)[0]

    path = ml.write_model_bytes(spark, np.array([2.0]).tobytes(), scratch_path(spark, "model"))
    df = spark.range(400).select("id", F.array(F.col("id").cast("double")).alias("v")).coalesce(1)
    out = ml.score_external(df, path, load, ["v"], ["id"], batch_size=10).collect()
    assert all(r["logit"] == 2.0 * r["id"] for r in out) and loads.value == 1


def test_embedding_head_finds_the_rare_class(spark):
    rows = M.ml_fit_embedding_head(spark, "/root/testdata/sf0.1").collect()
    hits = sum(r.label == r.pred == 1 for r in rows)
    assert hits > 0 and 0 < sum(r.pred for r in rows) < len(rows)


def test_balanced_pos_weight(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,), (None,)], "label int")
    assert ml.balanced_pos_weight(df) == 3.0
    assert ml.balanced_pos_weight(df.where("label = 1")) == ml.balanced_pos_weight(df.limit(0)) == 1.0


def test_replayed_rule_notices_a_wrong_log():
    record = lambda e, loss, improved, wait, stopped: ml.EpochRecord(e, 0.0, loss, 0.0, improved, wait, stopped, {})
    log = [record(0, 1.0, True, 0, False), record(1, 0.5, True, 0, False), record(2, 0.6, False, 1, False)]
    assert M.rule_holds(log) and M.rule_holds([])
    log[2].wait = 0
    assert not M.rule_holds(log)


def test_epochs_take_the_perceptrons_own_steps_on_sparse_rows(spark, monkeypatch):
    """The log is that of Spark ML's fits, but no fit makes the rows dense."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier as Perceptron
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    train, val = _toy(spark, 700)
    train = train.unionByName(spark.createDataFrame([(1000, "", 1), (1001, "?!", 0)], train.schema))
    fit, sizes = Perceptron.fit, []
    monkeypatch.setattr(Perceptron, "fit", lambda self, df, *a: (sizes.append(df.count()), fit(self, df, *a))[1])
    _, log = ml.train_epochs(train, val, scratch_path(spark, "sparse"), num_features=64, max_epochs=4, patience=9, iterations=3)
    assert sizes and max(sizes) <= 1
    terms = RegexTokenizer(inputCol="text", outputCol="_t", pattern=ml.TOKEN_SPLIT)
    tf = HashingTF(inputCol="_t", outputCol="_f", numFeatures=64, binary=True)
    rows = tf.transform(terms.transform(train))
    step = Perceptron(featuresCol="_f", labelCol="label", layers=[64, 2], maxIter=3, seed=1, probabilityCol="_prob",
                      rawPredictionCol="_raw", predictionCol="_pred")
    for record in log:
        model = fit(step, rows)
        loss = ml.score(model, rows, "doc_id").agg(F.avg(ev.bce_with_logits("label", "logit"))).first()[0]
        assert abs(record.train_loss - loss) < 1e-6
        step = step.setInitialWeights(model.weights)


def test_steps_on_no_rows_and_on_a_label_of_no_class(spark):
    train, val = _toy(spark)
    _, log = ml.train_epochs(train.limit(0), val, scratch_path(spark, "empty"), num_features=64, max_epochs=1)
    assert [r.train_loss for r in log] == [0.0] and log[0].val_loss > 0
    with pytest.raises(Exception, match="0 or 1"):
        ml.train_epochs(train.withColumn("label", F.lit(2)), val, scratch_path(spark, "three"), num_features=64, max_epochs=1)

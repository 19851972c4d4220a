"""Model lifecycle as data work: fit, epoch training with early stopping,
batch scoring, test metrics, checkpoint / reload, epoch metric logs.

* ``fit_text_classifier`` (M1): Spark ML pipeline -- tokenizer, hashed binary
  term features, IDF, L2 logistic regression with a positive-class weight.
* ``train_epochs`` (M2): Spark ML's perceptron classifier over hashed term
  features, fitted epoch by epoch: each epoch continues from the weights of
  the one before. Its solver's steps are taken here on sparse rows, as Spark ML
  makes every row dense (32 KB at 4,096 features) in every epoch. Validation loss and metrics each epoch; stop after
  ``patience`` epochs without a ``min_delta`` improvement of val loss; the best
  epoch's model is saved as it is found, and reloaded for use.
  Training state is committed every epoch, so an interrupted run goes on where it stopped.
* ``fit_embedding_head`` (M5): logistic head on pooled vectors.
* ``score_external`` (M3): batch scoring with a model from outside Spark ML, loaded once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce, wraps

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from modlens.functions.columns import TOKEN_SPLIT, flag_gt, sigmoid
from modlens.operators.evaluate import bce_with_logits, confusion_aggs, metric_columns


# ---------------------------------------------------------------- M1 / M3 / M5

def _with_weight(df: DataFrame, label: str, pos_weight: float, weight_col: str = "_w") -> DataFrame:
    return df.withColumn(weight_col, F.when(F.col(label) == 1, F.lit(float(pos_weight)))
                         .otherwise(F.lit(1.0)))


def fit_text_classifier(train: DataFrame, text_col: str = "text", label: str = "label",
                        pos_weight: float = 1.0, reg: float = 0.05, num_features: int = 1 << 16,
                        min_doc_freq: int = 3, max_iter: int = 200, tol: float = 1e-6) -> PipelineModel:
    """Binary text classifier with positive-class weight and L2 penalty, run to tolerance.
    ``num_features`` (hash buckets) and ``min_doc_freq`` are model parameters.

    Texts are tokenised and hashed once; only the sparse term vectors, label
    and weight are persisted for the fit (IDF and the optimizer each pass over
    them), never the raw text, and they are released afterwards. The stages
    are assembled into one ``PipelineModel`` that scores raw text.
    """
    tokenizer = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN_SPLIT, gaps=True,
                               toLowercase=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features, binary=True)
    rows = _with_weight(train, label, pos_weight).select(text_col, label, "_w")
    feats = tf.transform(tokenizer.transform(rows)).select("_tf", label, "_w").persist()
    try:
        idf = IDF(inputCol="_tf", outputCol="_features", minDocFreq=min_doc_freq).fit(feats)
        lr = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_w",
                                regParam=reg, elasticNetParam=0.0, maxIter=max_iter, tol=tol,
                                probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")
        head = lr.fit(idf.transform(feats))
    finally:
        feats.unpersist()
    return PipelineModel(stages=[tokenizer, tf, idf, head])


def score(model: PipelineModel, df: DataFrame, key: str, label: str = "label", carry: Sequence[str] = ()) -> DataFrame:
    """(key, label, carried columns, logit, prob, pred): pred = sigmoid(logit) > 0.5.

    The logit is a logistic head's second raw score, and the difference of a perceptron's two."""
    out = model.transform(df)
    raw = vector_to_array(F.col("_raw"))
    prob = vector_to_array(F.col("_prob"))[1]
    head = model.stages[-1] if isinstance(model, PipelineModel) else model
    z = raw[1] - raw[0] if isinstance(head, MultilayerPerceptronClassificationModel) else raw[1]
    return out.select(key, label, *carry, z.alias("logit"), prob.alias("prob"), flag_gt(prob, 0.5).alias("pred"))


def balanced_pos_weight(train: DataFrame, label: str = "label") -> float:
    """Negatives per positive: with it both classes weigh the same, so a rare class is still predicted.
    1 where a class is missing; rows without a label count nowhere."""
    n, pos = train.agg(F.count(label), F.count_if(F.col(label) == 1)).first()
    return (n - pos) / pos if 0 < pos < n else 1.0


def fit_embedding_head(train: DataFrame, vec_col: str = "embedding", label: str = "label",
                       pos_weight: float = 1.0, reg: float = 0.01, max_iter: int = 100, tol: float = 1e-6,
                       standardize: bool = True) -> PipelineModel:
    """Linear head (logistic) on pooled vectors stored as array<float>. The penalty is on the weights of the
    scaled vectors, or of the vectors as they are without ``standardize``."""
    feats = train.withColumn("_features", array_to_vector(F.col(vec_col)))
    lr = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_w", regParam=reg,
                            maxIter=max_iter, tol=tol, standardization=standardize, probabilityCol="_prob",
                            rawPredictionCol="_raw", predictionCol="_pred")
    return PipelineModel(stages=[lr.fit(_with_weight(feats, label, pos_weight))])


def score_embedding_head(model: PipelineModel, df: DataFrame, key: str, vec_col: str = "embedding",
                         label: str = "label") -> DataFrame:
    return score(model, df.withColumn("_features", array_to_vector(F.col(vec_col))), key, label)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------------- M2: epoch loop

@dataclass
class EpochRecord:
    epoch: int
    train_loss: float
    val_loss: float
    best_val_loss: float
    improved: bool
    wait: int
    stopped: bool
    metrics: dict


#: Spark ML averages a perceptron's loss over blocks of this many rows of a partition (its ``blockSize``).
BLOCK_ROWS = 128
#: Entries of a chunk of sparse rows, at least (4 MB).
CHUNK_ENTRIES = 1 << 20


def sparse_chunks(rows: DataFrame) -> RDD:
    """(entries per row, feature of every entry, label and weight of each row) of many rows (binary sparse vector,
    label) at once. A row weighs one by the size of its block, as in Spark ML's loss."""

    def packed(blocks):
        rows = [r for b in blocks for r in b]
        return (np.array([len(i) for i, _ in rows]), np.concatenate([i for i, _ in rows]).astype(np.int32),
                np.array([y for _, y in rows], np.float64), np.concatenate([np.full(len(b), 1 / len(b)) for b in blocks]))

    def pack(part):
        chunk, block, held = [], [], 0
        for features, label in part:
            if label not in (0, 1):
                raise ValueError(f"a label of two classes is 0 or 1, not {label!r}")
            block.append((features.indices, label))
            held += len(features.indices)
            if len(block) == BLOCK_ROWS:
                chunk.append(block)
                block = []
                if held >= CHUNK_ENTRIES:
                    yield packed(chunk)
                    chunk, held = [], 0
        if block:
            chunk.append(block)
        if chunk:
            yield packed(chunk)

    return rows.rdd.mapPartitions(pack)


def loss_and_gradient(chunks: RDD, weights: np.ndarray, n_blocks: int) -> tuple[float, np.ndarray]:
    """Mean cross-entropy of a perceptron without hidden layers, and its gradient, in one pass. Weights are in
    Spark ML's order: two for each feature, then two biases; only the classes' difference counts."""
    margin = weights[1::2] - weights[::2]
    n = len(margin) - 1

    def sums(part):
        total = np.zeros(n + 2)
        for sizes, features, label, weight in part:
            row = np.repeat(np.arange(len(sizes)), sizes)
            z = np.bincount(row, margin[features], len(sizes)) + margin[n]
            off = weight * (1 / (1 + np.exp(np.minimum(-z, 700))) - label)
            total[:n] += np.bincount(features, off[row], n)
            total[n] += off.sum()
            total[n + 1] += (weight * (np.logaddexp(0, z) - label * z)).sum()
        yield total

    total = chunks.mapPartitions(sums).treeReduce(np.add) / n_blocks
    return float(total[-1]), np.column_stack((-total[:-1], total[:-1])).ravel()


class SearchFailed(Exception):
    pass


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tol: float = 1e-6,
          memory: int = 10) -> np.ndarray:
    """x after ``steps`` steps of limited-memory BFGS with a strong Wolfe search, the solver of Spark ML's
    perceptron: a failed search forgets the past steps once, and ends it the second time."""
    value, grad = f(x)
    past, taken, failed = [], 0, False
    while taken < steps and np.linalg.norm(grad) > max(tol * value, 1e-8):
        try:
            way = _descent(past, grad)
            t, new_value, new_grad = wolfe_search(f, x, value, grad, way, 1.0 if taken else 1 / np.linalg.norm(way))
            if t * np.linalg.norm(grad) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                break
            past, failed = [], True
            continue
        past = [(t * way, new_grad - grad), *past][:memory]
        x, value, grad, failed = x + t * way, new_value, new_grad, False
        taken += 1
    return x


def _descent(past: list, grad: np.ndarray) -> np.ndarray:
    """The two-loop product of the gradient and the approximated inverse Hessian, downwards."""
    way, kept = grad.copy(), []
    for s, y in past:
        rho = s @ y
        a = s @ way / rho if rho else np.nan
        if np.isnan(a):
            raise SearchFailed
        kept.append((rho, a))
        way -= a * y
    if past:
        s, y = past[0]
        if s @ y < 0:
            raise SearchFailed
        way *= s @ y / (y @ y)
    for (s, y), (rho, a) in zip(past[::-1], kept[::-1]):
        way += (a - y @ way / rho) * s
    return -way


def wolfe_search(f, x: np.ndarray, value: float, grad: np.ndarray, way: np.ndarray, t: float, tries: int = 10,
                 c1: float = 1e-4, c2: float = 0.9) -> tuple[float, float, np.ndarray]:
    """(t, loss, gradient) at x + t * way where the strong Wolfe conditions hold (Nocedal and Wright, 3.5)."""
    slope = grad @ way
    if slope > 0:
        raise SearchFailed

    def at(t):
        v, g = f(x + t * way)
        return t, v, g @ way, g

    def between(a, b):
        (ta, va, sa, _), (tb, vb, sb, _) = sorted((a, b), key=lambda p: p[0])
        d1 = sa + sb - 3 * (va - vb) / (ta - tb)
        root = d1 * d1 - sa * sb
        d2 = np.sqrt(root) if root >= 0 else np.nan
        t = tb - (tb - ta) * (sb + d2 - d1) / (sb - sa + 2 * d2)
        low, high = ta + 0.1 * (tb - ta), ta + 0.9 * (tb - ta)
        return low if t < low else high if t > high else t

    def zoom(low, high):
        for _ in range(tries):
            c = at(between(low, high))
            if c[1] > value + c1 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= c2 * abs(slope):
                return c[0], c[1], c[3]
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        raise SearchFailed

    low = 0.0, value, slope, grad
    for i in range(tries):
        c = at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + c1 * t * slope or (c[1] >= low[1] and i):
            return zoom(low, c)
        if abs(c[2]) <= c2 * abs(slope):
            return c[0], c[1], c[3]
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    raise SearchFailed


def _perceptron(classifier: MultilayerPerceptronClassifier, spark: SparkSession, label: str, weights=None
                ) -> MultilayerPerceptronClassificationModel:
    """The model with these weights, or the seed's first ones: a fit of no steps, on one row without terms."""
    row = spark.createDataFrame([(Vectors.sparse(classifier.getLayers()[0], [], []), 0.0)], [classifier.getFeaturesCol(), label])
    still = classifier.copy({classifier.maxIter: 0})
    return (still if weights is None else still.setInitialWeights(weights)).fit(row)


def _losses(model, rows: DataFrame, label: str) -> dict:
    """Loss per part (0 train, 1 validation) and validation metrics, in one pass."""
    scored = score(model, rows, "_part", label)
    per = scored.groupBy("_part").agg(F.avg(bce_with_logits(label, "logit")).alias("loss"),
                                      *confusion_aggs(label, "pred")).select("_part", "loss", "n", *metric_columns())
    return {r["_part"]: r.asDict() for r in per.collect()}


def train_epochs(train: DataFrame, val: DataFrame, path: str, text_col: str = "text", label: str = "label",
                 num_features: int = 1 << 12, max_epochs: int = 20, patience: int = 3,
                 min_delta: float = 1e-4, iterations: int = 5, seed: int = 1, resume: bool = False,
                 on_epoch: Callable[[EpochRecord], None] | None = None
                 ) -> tuple[PipelineModel, list[EpochRecord]]:
    """Epoch training with early stopping on val loss; returns the best epoch's model, read back
    from ``path``, and the log.

    An epoch is ``iterations`` steps of Spark ML's solver from the last epoch's weights. Hashed
    features are persisted once, for the steps as arrays of the terms' numbers; every step is a sum over the
    partitions. The driver holds the weights (two per feature), the last steps and the losses.

    Every epoch ends with its state (weights, monitored loss, wait, log row) appended under ``path``. With
    ``resume`` a run that was stopped goes on after its last committed epoch, with the same arguments and
    rows, and ends with the log and model of a run that never stopped; a finished run does no work.
    ``path`` holds one run: without ``resume`` it must be new.
    """
    tokenizer = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=TOKEN_SPLIT, gaps=True,
                               toLowercase=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=num_features, binary=True)
    part = lambda df, n: df.select(text_col, label, F.lit(n).alias("_part"))
    rows = (tf.transform(tokenizer.transform(part(train, 0).unionByName(part(val, 1))))
            .select("_features", label, "_part").persist())
    step = MultilayerPerceptronClassifier(featuresCol="_features", labelCol=label, layers=[num_features, 2],
                                          maxIter=iterations, solver="l-bfgs", seed=seed, probabilityCol="_prob",
                                          rawPredictionCol="_raw", predictionCol="_pred")
    chunks = sparse_chunks(rows.where("_part = 0").select("_features", label)).persist(StorageLevel.MEMORY_AND_DISK)
    n_blocks = 0
    best, monitor, wait, log, weights = float("inf"), float("inf"), 0, [], None
    if resume:
        log, weights, monitor = last_state(train.sparkSession, path)
        best, wait = (log[-1].best_val_loss, log[-1].wait) if log else (best, wait)
    try:
        for epoch in range(len(log), max_epochs):
            if log and log[-1].stopped:
                break
            if weights is None:
                weights = _perceptron(step, train.sparkSession, label).weights
            n_blocks = n_blocks or round(chunks.map(lambda c: c[3].sum()).sum())
            if n_blocks:
                weights = DenseVector(lbfgs(lambda w: loss_and_gradient(chunks, w, n_blocks), weights.toArray(),
                                            iterations, step.getTol()))
            head = _perceptron(step, train.sparkSession, label, weights)
            losses = _losses(head, rows, label)
            train_loss = losses.get(0, {}).get("loss", 0.0)
            val_loss = losses.get(1, {}).get("loss", train_loss)
            if val_loss < best:
                best = val_loss
                save_model(PipelineModel(stages=[tokenizer, tf, head]), _best_path(path, epoch))
            improved = val_loss < monitor - min_delta
            monitor, wait = (val_loss, 0) if improved else (monitor, wait + 1)
            metrics = {m: losses.get(1, {}).get(m) for m in ("accuracy", "precision", "recall", "f1")}
            log.append(EpochRecord(epoch, train_loss, val_loss, best, improved, wait, wait >= patience, metrics))
            _commit_state(train.sparkSession, path, log[-1], weights, monitor)
            if on_epoch:
                on_epoch(log[-1])
    finally:
        chunks.unpersist()
        rows.unpersist()
    return best_model(train.sparkSession, path), log


#: One row per finished epoch. The weights are the next epoch's start; the epoch of the least
#: ``best_val_loss`` names the model that counts.
STATE = ("epoch int, weights array<double>, monitor double, train_loss double, val_loss double, best_val_loss double, "
         "improved boolean, wait int, stopped boolean, metrics map<string, double>")


def _best_path(path: str, epoch: int) -> str:
    return f"{path}/best/epoch-{epoch}"


def _commit_state(spark: SparkSession, path: str, r: EpochRecord, weights, monitor: float) -> None:
    """Append an epoch's row, one row in one file: it is there whole or not at all, and an epoch that has no
    row is done again, its model written over."""
    row = (r.epoch, [float(x) for x in weights.toArray()], monitor, float(r.train_loss), float(r.val_loss),
           float(r.best_val_loss), r.improved, r.wait, r.stopped,
           {k: float(v) for k, v in r.metrics.items() if v is not None})
    spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").parquet(f"{path}/state")


def _states(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(STATE).parquet(f"{path}/state")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_state(spark: SparkSession, path: str) -> tuple[list[EpochRecord], DenseVector | None, float]:
    """(log so far, weights and monitored loss to go on with) of a run; nothing where it never ended an epoch."""
    states = _states(spark, path)
    rows = sorted(states.drop("weights").collect(), key=lambda r: r["epoch"]) if states is not None else []
    if not rows:
        return [], None, float("inf")
    log = [EpochRecord(r["epoch"], r["train_loss"], r["val_loss"], r["best_val_loss"], r["improved"], r["wait"],
                       r["stopped"], {m: r["metrics"].get(m) for m in ("accuracy", "precision", "recall", "f1")}) for r in rows]
    weights = states.where(F.col("epoch") == rows[-1]["epoch"]).select("weights").first()["weights"]
    return log, DenseVector(weights), rows[-1]["monitor"]


def best_model(spark: SparkSession, path: str) -> PipelineModel:
    """The kept model of a run under ``path``: that of the epoch with the least validation loss."""
    epoch = _states(spark, path).where("val_loss = best_val_loss").agg(F.min_by("epoch", "val_loss")).first()[0]
    return load_model(_best_path(path, epoch))


# ---------------------------------------------------------------- M3: a model from outside Spark ML

def write_model_bytes(spark: SparkSession, model: bytes, path: str) -> str:
    """A model file as one row of a Parquet table, on storage that the whole cluster reads."""
    spark.createDataFrame([(bytearray(model),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def read_model_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.schema("model binary").parquet(path).first()["model"])


def score_external(df: DataFrame, path: str, load: Callable[[bytes], Callable], inputs: Sequence[str], keep: Sequence[str],
                   batch_size: int = 1024) -> DataFrame:
    """Kept columns and (logit, prob, pred) by a model of any library.

    ``load`` makes a predictor from the model file's bytes; it is called once per Python worker, which keeps
    it (``predict_batch_udf``). The predictor gets one numpy array per input column, at most ``batch_size``
    rows, and returns one logit per row. An array column is an array of rows, so its lists have one length;
    text is an array of strings. The bytes are broadcast: a model must fit in a worker. A row with a NULL
    input has a NULL logit and probability and is predicted 0, and never reaches the predictor.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_model_bytes(spark, path))

    def make():
        predict = load(shared.value)

        @wraps(predict)  # predict_batch_udf reads the number of columns from the signature
        def run(*columns):
            return np.asarray(predict(*columns), np.float64)
        return run

    shapes = []
    for c in inputs:
        nested = isinstance(df.schema[c].dataType, ArrayType)
        size = df.where(F.col(f"`{c}`").isNotNull()).select(F.size(F.col(f"`{c}`"))).first() if nested else None
        shapes.append([size[0]] if size else None)
    udf = predict_batch_udf(make, return_type=DoubleType(), batch_size=batch_size,
                            input_tensor_shapes=shapes if any(shapes) else None)
    whole = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in inputs])
    good = df.where(whole).withColumn("logit", udf(*[F.col(f"`{c}`") for c in inputs]))
    rest = df.where(~whole).withColumn("logit", F.lit(None).cast("double"))
    z = F.col("logit")
    return good.unionByName(rest).select(*keep, z, sigmoid(z).alias("prob"), flag_gt(z, 0.0).alias("pred"))


def epoch_log_frame(spark: SparkSession, run: str, log: Sequence[EpochRecord]) -> DataFrame:
    """Long (run, epoch, split, metric, value) rows of an epoch log: losses, and validation metrics."""
    rows = []
    for r in log:
        rows.append((run, r.epoch, "train", "loss", float(r.train_loss)))
        rows.append((run, r.epoch, "val", "loss", float(r.val_loss)))
        rows.extend((run, r.epoch, "val", m, float(v)) for m, v in r.metrics.items() if v is not None)
    return spark.createDataFrame(rows, "run string, epoch int, split string, metric string, value double")

"""M7, M8: a small network trained in epochs, and networks as scorers.

``network_scorer`` is the plug point for a network of any library: its weights
are broadcast (bounded by the model), loaded once per Python worker by
``predict_batch_udf`` and applied to Arrow batches; with
``hybrid_label(..., python_scorer=True)`` only messages without a lexicon hit
are sent.

``BagNet`` is a network that needs nothing but numpy: hashed words, the mean of
their vectors, tanh, two classes.  ``train_epochs`` trains it over Spark:

* M5 the word ids are made once, by Spark's own functions, and written dealt
  over ``workers`` parts;
* every epoch is one job: each part starts from the same weights, runs
  mini-batches over its rows in an order given by (seed, epoch, part), and
  sends its weights back; their mean, weighted by rows, starts the next epoch.
  What reaches the driver is ``workers`` copies of the weights, whatever the data;
* after each epoch the validation loss is one aggregation, and weights and loss
  are written to the run's folder.  A run that is stopped goes on after its last
  whole epoch, with the same result as one that is not;
* M7 the epoch with the lowest validation loss (the earlier of equal ones) is
  read back from the folder.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import model_clean
from ..session import scratch_path

BUCKETS, DIM = 1 << 13, 16
EPOCHS, BATCH, RATE, SEED = 5, 32, 0.8, 42
#: Parts of the training rows, and so copies of the weights that come back at once.
WORKERS = 16

CLASSES = 2
PREDICTION = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("confidence", T.DoubleType())])


def _at(ufunc, rows: np.ndarray, which: np.ndarray, values: np.ndarray) -> None:
    """``ufunc.at(rows, which, values)`` over single numbers, for which numpy is far faster; the order is the same."""
    width = rows.shape[1]
    each = (which.astype(np.int64)[:, None] * width + np.arange(width)).ravel()
    flat = rows.reshape(-1)  # a view: the rows are contiguous
    ufunc.at(flat, each, np.ascontiguousarray(values, rows.dtype).reshape(-1))


class BagNet:
    """Mean of word vectors, tanh, two classes."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray):
        self.vectors, self.out, self.bias = vectors, out, bias

    @classmethod
    def fresh(cls, buckets: int = BUCKETS, dim: int = DIM, seed: int = SEED) -> "BagNet":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (buckets, dim)).astype(np.float32), rng.normal(0, 0.3, (dim, CLASSES)).astype(np.float32),
                   np.zeros(CLASSES, np.float32))

    def to_bytes(self) -> bytes:
        head = np.array(self.vectors.shape, "<i8").tobytes()
        return head + b"".join(np.ascontiguousarray(a, "<f4").tobytes() for a in (self.vectors, self.out, self.bias))

    @classmethod
    def from_bytes(cls, data: bytes) -> "BagNet":
        buckets, dim = np.frombuffer(data, "<i8", 2)
        flat = np.frombuffer(data, "<f4", offset=16).copy()
        cut = np.split(flat, [buckets * dim, buckets * dim + dim * CLASSES])
        return cls(cut[0].reshape(buckets, dim), cut[1].reshape(dim, CLASSES), cut[2])

    def ids(self, clean_text: str) -> np.ndarray:
        """The buckets of the words, as ``word_ids`` makes them in Spark."""
        return np.array([zlib.crc32(w.encode()) % len(self.vectors) for w in clean_text.split(" ") if w], np.int64)

    def hidden(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """tanh of the mean vector of each text; texts without words have the mean 0."""
        sums = np.zeros((len(sizes), self.vectors.shape[1]), self.vectors.dtype)
        _at(np.add, sums, np.repeat(np.arange(len(sizes)), sizes), self.vectors[flat])
        return np.tanh(sums / np.maximum(sizes, 1)[:, None])

    def probabilities(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        logits = self.hidden(flat, sizes) @ self.out + self.bias
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        """Gradients of the mean log loss: of the words' vectors (by word), of ``out`` and of ``bias``."""
        h = self.hidden(flat, sizes)
        d = self.probabilities(flat, sizes)
        d[np.arange(len(labels)), labels] -= 1
        d /= len(labels)
        back = (d @ self.out.T) * (1 - h * h) / np.maximum(sizes, 1)[:, None]
        return np.repeat(back, sizes, axis=0), h.T @ d, d.sum(0)

    def step(self, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rate: float) -> None:
        vectors, out, bias = self.gradients(flat, sizes, labels)
        _at(np.subtract, self.vectors, flat, np.float32(rate * 10) * vectors)  # a word is in few texts of a batch
        self.out -= np.float32(rate) * out
        self.bias -= np.float32(rate) * bias

    def predict(self, texts) -> dict[str, np.ndarray]:
        """Class and top probability of model_clean texts (the plain evaluation)."""
        ids = [self.ids(t if isinstance(t, str) else "") for t in texts]
        p = self.probabilities(np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64),
                               np.array([len(i) for i in ids], np.int64))
        return {"label": p.argmax(1).astype(np.int32), "confidence": p.max(1).astype(np.float64)}


# ------------------------------------------------------------------- scoring

def network_scorer(spark: SparkSession, weights: bytes, load=BagNet.from_bytes, batch_size: int = 256):
    """M8: a scorer for ``hybrid_label(..., python_scorer=True)``.

    ``load(weights)`` gives an object whose ``predict(texts)`` returns arrays
    ``label`` and ``confidence``; it is called once per Python worker.
    """
    shared = spark.sparkContext.broadcast(weights)

    def make_predict():
        model = load(shared.value)
        return lambda texts: model.predict(texts.reshape(-1))

    predict = predict_batch_udf(make_predict, return_type=PREDICTION, batch_size=batch_size)

    def score(df: DataFrame) -> DataFrame:
        scored = df.withColumn("_p", predict(F.col("clean_text")))
        return (scored.withColumn("model_label", F.col("_p.label")).withColumn("model_confidence", F.col("_p.confidence"))
                      .drop("_p"))

    return score


# ------------------------------------------------------------------ training

@dataclass
class Trained:
    net: BagNet
    best_epoch: int
    losses: list[float]
    accuracies: list[float]


def word_ids(clean_text, buckets: int):
    """M5: the buckets of all words of the text; no position limit."""
    words = F.filter(F.split(clean_text, " "), lambda w: w != "")
    return F.transform(words, lambda w: (F.crc32(F.encode(w, "UTF-8")) % buckets).cast("int"))


def _encoded(df: DataFrame, path: str, buckets: int, parts: int) -> DataFrame:
    """(ids, label) in ``parts`` files, written unless a whole table is there already."""
    spark = df.sparkSession
    if not _whole(spark, path):
        rows = df.select(word_ids(model_clean(F.col("text")), buckets).alias("ids"), F.col("label").cast("int").alias("label"))
        rows.repartition(parts).write.mode("overwrite").parquet(path)
    return spark.read.schema("ids array<int>, label int").parquet(path)


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote this folder ended well."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _arrays(batch: pa.RecordBatch):
    lists = batch.column("ids")
    return (lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
            lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
            batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64))


def _epoch(rows: DataFrame, net: BagNet, epoch: int, batch: int, rate: float, seed: int) -> BagNet:
    """One pass: the mean of the parts' weights, weighted by their rows."""
    start = rows.sparkSession.sparkContext.broadcast(net.to_bytes())

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        mine, rng, seen = BagNet.from_bytes(start.value), np.random.default_rng([seed, epoch, part]), 0
        for b in batches:
            flat, sizes, labels = _arrays(b)
            first, order = np.cumsum(sizes) - sizes, rng.permutation(len(sizes))
            for lo in range(0, len(order), batch):
                take = order[lo:lo + batch]
                words = np.concatenate([flat[first[k]:first[k] + sizes[k]] for k in take])
                mine.step(words, sizes[take], labels[take], rate)
            seen += len(sizes)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seen]), pa.array([mine.to_bytes()], pa.binary())],
                                             names=["part", "n", "weights"])

    got = sorted((r["part"], r["n"], bytes(r["weights"]))
                 for r in rows.mapInArrow(run, "part long, n long, weights binary").collect())  # one row a part
    if not got:
        return net
    total = sum(n for _, n, _ in got)
    nets = [(n / total, BagNet.from_bytes(w)) for _, n, w in got]
    mean = lambda name: sum(share * getattr(x, name).astype(np.float64) for share, x in nets).astype(np.float32)
    return BagNet(mean("vectors"), mean("out"), mean("bias"))


def _validate(rows: DataFrame, net: BagNet) -> tuple[float, float]:
    """Mean log loss and accuracy, one aggregation."""
    shared = rows.sparkSession.sparkContext.broadcast(net.to_bytes())

    def run(batches):
        model = BagNet.from_bytes(shared.value)
        for b in batches:
            flat, sizes, labels = _arrays(b)
            p = model.probabilities(flat, sizes)
            loss = -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-15)).sum() if len(labels) else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([len(labels)]), pa.array([float(loss)]),
                                              pa.array([int((p.argmax(1) == labels).sum())])], names=["n", "loss", "right"])

    n, loss, right = rows.mapInArrow(run, "n long, loss double, right long").agg(F.sum("n"), F.sum("loss"), F.sum("right")).first()
    return (loss / n, right / n) if n else (float("inf"), 0.0)


def _state_path(root: str, epoch: int) -> str:
    return f"{root}/epoch-{epoch:03d}"


def train_epochs(train: DataFrame, validation: DataFrame, root: str | None = None, epochs: int = EPOCHS,
                 buckets: int = BUCKETS, dim: int = DIM, workers: int = WORKERS, batch: int = BATCH, rate: float = RATE,
                 seed: int = SEED) -> Trained:
    """M6 + M7 over (text, label) rows; ``root`` is the run's folder (shared), taken up again if it holds epochs."""
    spark = train.sparkSession
    root = root or scratch_path(spark, "network")
    learn = _encoded(train, f"{root}/train", buckets, workers)
    check = _encoded(validation, f"{root}/validation", buckets, workers)
    net, losses, accuracies = BagNet.fresh(buckets, dim, seed), [], []
    for epoch in range(1, epochs + 1):
        path = _state_path(root, epoch)
        if not _whole(spark, path):
            net = _epoch(learn, net, epoch, batch, rate, seed)
            loss, accuracy = _validate(check, net)
            state = spark.createDataFrame([(epoch, loss, accuracy, bytearray(net.to_bytes()))],
                                          "epoch int, loss double, accuracy double, weights binary")
            state.coalesce(1).write.mode("overwrite").parquet(path)
        saved = spark.read.parquet(path).first()
        net = BagNet.from_bytes(bytes(saved["weights"]))
        losses.append(saved["loss"])
        accuracies.append(saved["accuracy"])
    best = min(range(epochs), key=lambda k: (losses[k], k)) + 1
    weights = spark.read.parquet(_state_path(root, best)).first()["weights"]
    return Trained(BagNet.from_bytes(bytes(weights)), best, losses, accuracies)

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words (A-Z lower-cased, punctuation stripped), neighbouring
pairs, and pairs one word apart, each present or not, hashed to ``2 ** BITS`` places.
Per-coordinate learning rates and L1 leave few weights; they are broadcast as one
array of fixed size. The model is fitted on a bounded sample of labelled rows
(``max_train`` rows, ``max_bytes`` of text); their features, not their texts, reach the
driver. Toxic rows are few, so the plain model is too careful at one half: models fitted
without a part of the rows score that part, the threshold of best F1 on these scores is
found, and the bias is shifted so that it lies at one half.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, ship

BITS = 20
_STRIP = b".,;:!?\"'()[]{}*#$%&-_~<>/\\"
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.strip(_STRIP), 4)
        return h


_words = _Words()


def places_of(text: bytes) -> np.ndarray:
    """Hashed places of a text's features, with repeats."""
    w = text.lower().split()
    a = np.fromiter(map(_words.__getitem__, w), np.uint64, len(w))
    with np.errstate(over="ignore"):
        parts = [a * _A, (a[:-1] * _B) ^ (a[1:] * _A), (a[:-2] * _C) ^ (a[2:] * _B)]
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def _pack(places: np.ndarray) -> bytes:
    """Ascending places as compressed steps: about a third of their size, for the way to the driver."""
    return zlib.compress(np.diff(places, prepend=0).astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<u4"), dtype=np.uint32)


class FTRL:
    """Per-coordinate FTRL-proximal for logistic loss; the last coordinate is the bias, without L1."""

    def __init__(self, n: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(n + 1), np.zeros(n + 1)

    def weights(self, i=slice(None)) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + self.n[-1] ** 0.5) / self.alpha))

    def step(self, i: np.ndarray, y: float) -> None:
        w = self.weights(i)
        p = 1 / (1 + np.exp(-np.clip(w.sum() + self.bias(), -35, 35)))
        g = p - y
        for at, was in ((i, w), (np.array([-1]), np.array([self.bias()]))):
            sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
            self.z[at] += g - sigma * was
            self.n[at] += g * g

    def fit(self, rows: list[tuple[np.ndarray, float]], epochs: int = 4, seed: int = 3) -> FTRL:
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                self.step(*rows[k])
        return self


def calibrated(rows: list[tuple[np.ndarray, float]], folds: int = 3, n: int = 1 << BITS) -> tuple[np.ndarray, float]:
    """Weights and bias of the model of all rows; the bias is less by the threshold of best F1 on the scores of rows that a model has not seen. Without two rows of each label it is not shifted."""
    model = FTRL(n).fit(rows)
    y = np.array([label for _, label in rows])
    bias = model.bias()
    if min((y > 0.5).sum(), (y <= 0.5).sum()) >= 2:
        z = np.empty(len(rows))
        for k in range(folds):
            part = FTRL(n).fit([r for i, r in enumerate(rows) if i % folds != k])
            z[k::folds] = [part.weights(i).sum() + part.bias() for i, _ in rows[k::folds]]
        bias -= best_threshold(z, y)
    return model.weights()[:-1].astype(np.float32), bias


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """Midway between two neighbouring scores, where F1 of ``z > threshold`` is best; the highest of equals, and not above 0."""
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum(y[order] > 0.5)
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + hit[-1])
    cut = np.flatnonzero(np.append(z[1:] < z[:-1], True))
    k = cut[np.argmax(f1[cut])]
    return min(0.0, float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k]))


def held_out(doc_id: Column, mod: int = 5, at: int = 0) -> Column:
    """crc32 of the id as text; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == at, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 8000, max_bytes: int = 64 << 20) -> tuple[np.ndarray, float]:
    """Weights and bias. Labelled rows that are not held out, in order of a hash of their id, at most ``max_train`` and ``max_bytes`` of text: a text that does not fit any more is passed over, and if none fits the shortest is taken; bounded, so they are broadcast to the texts. Of several texts of one id, the least counts."""
    spark = docs.sparkSession
    ship(spark)
    key = labels[id_col]
    chosen = labels.where(key.isNotNull() & labels[label_col].isNotNull() & ~held_out(key)).select(key.alias("_id"), labels[label_col].cast("double").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_train).groupBy("_id").agg(F.max("_y").alias("_y"))
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = materialize(rows.groupBy("_id", "_y").agg(F.min("_text").alias("_text")), "toxicity-train")
    sizes = rows.select("_id", F.xxhash64("_id").alias("_h"), F.octet_length("_text").alias("_n")).collect()
    sizes.sort(key=lambda r: (r[1], str(r[0])))
    if not sizes:
        return np.zeros(1 << BITS, np.float32), -1e-12
    taken, room = [], max_bytes
    for r in sizes:
        if r[2] <= room:
            taken.append((r[0],))
            room -= r[2]
    taken = taken or [(min(sizes, key=lambda r: (r[2], r[1], str(r[0])))[0],)]
    id_field = T.StructField("_id", docs.schema[id_col].dataType)
    rows = rows.join(F.broadcast(spark.createDataFrame(taken, T.StructType([id_field]))), "_id").select("_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [_pack(np.unique(places_of(t.as_py() or b""))) for t in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.binary())], ["_id", "_y", "_f"])

    schema = T.StructType([id_field, T.StructField("_y", T.DoubleType()), T.StructField("_f", T.BinaryType())])
    got = sorted(rows.mapInArrow(run, schema).collect(), key=lambda r: (str(r[0]), r[2]))
    return calibrated([(_unpack(r[2]), r[1]) for r in got])


def score(docs: DataFrame, weights: np.ndarray, bias: float, text_col: str, keep: list[Column], types: list[T.StructField]) -> DataFrame:
    """``keep`` columns and ``score`` per row."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((np.flatnonzero(weights).astype(np.int64), weights[weights != 0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, val = shared.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = val
        for b in batches:
            out = []
            for t in b.column(b.num_columns - 1).cast(pa.binary()):
                i = places_of(t.as_py() or b"")
                i = np.unique(i[w[i] != 0])
                out.append(1 / (1 + np.exp(-np.clip(float(w[i].sum(dtype=np.float64)) + bias, -35, 35))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], [*b.schema.names[:-1], "_score"])

    return docs.select(*keep, docs[text_col].cast("string").alias("_text")).mapInArrow(run, T.StructType([*types, T.StructField("_score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 8000) -> DataFrame:
    """Per row of ``docs``: id, held_out, score, predicted.

    A null or empty text scores the bias alone. Without labels every score is just
    below 0.5, and predicted 0. Null and repeated ids stay, equal texts score alike; several
    labels of one id count as their maximum. Texts are taken whole, however long. An empty
    table gives none. Columns of other names are ignored.
    """
    weights, bias = train(docs, labels, id_col, text_col, label_col, max_train)
    d = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_t"))
    got = score(d, weights, bias, "_t", [d["_id"]], [T.StructField("_id", docs.schema[id_col].dataType)])
    return got.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 8000) -> DataFrame:
    """The rows of ``docs`` not predicted toxic, with all their columns, even two of one name; rows pass through the scorer whole."""
    weights, bias = train(docs, labels, id_col, text_col, max_train=max_train)
    names = [f"c{i}" for i in range(len(docs.columns))]
    d = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(docs.columns, names)])
    text = names[docs.columns.index(text_col)]
    got = score(d, weights, bias, text, [d[n] for n in names], [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields)])
    return got.where("_score < 0.5").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

"""Language ID: a convolutional network over bytes, trained in numpy.

A text is cut into windows of a fixed number of bytes, the last one padded with
spaces. Bytes are embedded, filters of several widths slide over a window, each
keeps its highest response, and a softmax gives the languages' probabilities. A
text's prediction is the mean over all its windows. The network is fitted on a
bounded sample of labelled documents (``max_train``, a few windows of each).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .toxicity import held_out

WINDOW = 192
EMBED, FILTERS, WIDTHS = 8, 16, (2, 3, 4)


def windows_of(text: bytes) -> np.ndarray:
    text = text.lower()
    return np.frombuffer(text + b" " * (-len(text) % WINDOW or (0 if text else WINDOW)), np.uint8).reshape(-1, WINDOW)


class ByteCNN:
    def __init__(self, classes: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.5, (256, EMBED)), "W": r.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "b": np.zeros(classes)}
        for w in WIDTHS:
            self.p[f"K{w}"] = r.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"k{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _conv(self, x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        cols = sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(-1, w * EMBED)
        return cols, (cols @ self.p[f"K{w}"]).reshape(len(x), -1, FILTERS)

    def _softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.p["W"] + self.p["b"]
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def probabilities(self, win: np.ndarray, at_once: int = 256) -> np.ndarray:
        out = []
        for i in range(0, len(win), at_once):
            x = self.p["E"][win[i : i + at_once]]
            h = np.concatenate([np.maximum(self._conv(x, w)[1].max(1) + self.p[f"k{w}"], 0) for w in WIDTHS], axis=1)
            out.append(self._softmax(h))
        return np.concatenate(out) if out else np.zeros((0, len(self.p["b"])), np.float32)

    def gradients(self, win: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        x = self.p["E"][win]
        kept, hs = {}, []
        for w in WIDTHS:
            cols, r = self._conv(x, w)
            at = r.argmax(1)
            best = np.take_along_axis(r, at[:, None], 1)[:, 0] + self.p[f"k{w}"]
            kept[w] = cols.reshape(len(x), -1, w * EMBED), at, best > 0
            hs.append(np.maximum(best, 0))
        h = np.concatenate(hs, axis=1)
        d = self._softmax(h)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"W": h.T @ d, "b": d.sum(0), "E": np.zeros_like(self.p["E"])}
        dh = d @ self.p["W"].T
        for k, w in enumerate(WIDTHS):
            cols, at, on = kept[w]
            dk = dh[:, k * FILTERS : (k + 1) * FILTERS] * on
            picked = cols[np.arange(len(x))[:, None], at]  # window, filter, width * embed
            g[f"K{w}"] = np.einsum("nf,nfc->cf", dk, picked)
            g[f"k{w}"] = dk.sum(0)
            dx = (dk[:, :, None] * self.p[f"K{w}"].T[None]).reshape(len(x), FILTERS, w, EMBED)
            for j in range(w):
                np.add.at(g["E"], win[np.arange(len(x))[:, None], at + j], dx[:, :, j])
        return g

    def fit(self, win: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.005, seed: int = 6) -> ByteCNN:
        """Adam."""
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), batch):
                k, t = order[i : i + batch], t + 1
                for n, g in self.gradients(win[k], y[k]).items():
                    m[n] = 0.9 * m.get(n, 0) + 0.1 * g
                    v[n] = 0.999 * v.get(n, 0) + 0.001 * g * g
                    self.p[n] = (self.p[n] - rate * (m[n] / (1 - 0.9**t)) / (np.sqrt(v[n] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 2000, per_doc: int = 3) -> tuple[ByteCNN, list[str]]:
    """Network and languages. Of documents with a language that are not held out, at most ``max_train`` by a hash of their id, ``per_doc`` windows of each, evenly spread. A null id is not held out and hashes like any other value."""
    ship(docs.sparkSession)
    key = docs[id_col].cast("string")
    rows = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull() & ~held_out(docs[id_col], 4, 2)).select(key.alias("_id"), docs[lang_col].cast("string").alias("_lang"), docs[text_col].cast("string").alias("_text"))
    # The sample is drawn on slim rows; their windows, not their texts, are sorted.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            win = []
            for t in b.column(2).cast(pa.binary()):
                w = windows_of(t.as_py())
                win.append(w[np.unique(np.linspace(0, len(w) - 1, per_doc).astype(int))].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(win, pa.binary())], ["_id", "_lang", "_win"])

    share = rows.select("_id").withColumn("_h", F.xxhash64("_id"))
    edge = share.orderBy("_h").limit(max_train).agg(F.max("_h")).first()[0]
    if edge is None:
        return ByteCNN(1), ["und"]
    got = rows.where(F.xxhash64("_id") <= edge).mapInArrow(run, "_id string, _lang string, _win binary").orderBy(F.xxhash64("_id"), "_id", "_win").limit(max_train).collect()
    langs = sorted({r[1] for r in got})
    win = np.concatenate([np.frombuffer(r[2], np.uint8).reshape(-1, WINDOW) for r in got])
    y = np.concatenate([np.full(len(r[2]) // WINDOW, langs.index(r[1])) for r in got])
    return ByteCNN(len(langs)).fit(win, y, epochs=max(4, min(40, 12000 // len(y)))), langs


def predict(docs: DataFrame, model: ByteCNN, langs: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score per row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.p, langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, names = shared.value
        net = ByteCNN(len(names))
        net.p = params
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score = [], []
            i = 0
            while i < len(texts):
                group, held = [], 0
                while i < len(texts) and held < 1 << 20:
                    group.append(texts[i] or "")
                    held += len(group[-1])
                    i += 1
                win = [windows_of(t.encode("utf-8", "replace")) for t in group]
                p = net.probabilities(np.concatenate(win))
                at = np.cumsum([0, *map(len, win)])
                mean = np.add.reduceat(p.astype(np.float64), at[:-1], axis=0) / np.diff(at)[:, None]
                for t, m in zip(group, mean):
                    und = not any(map(str.isalpha, t))
                    lang.append("und" if und else names[int(m.argmax())])
                    score.append(0.0 if und else float(min(1.0, m.max())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    got = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema)
    return got.select(F.col("_id").alias(id_col), held_out(F.col("_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 2000) -> DataFrame:
    """Per row of ``docs``: id, held_out, lang_pred, score.

    Null texts and those without a letter are ``und`` with score 0. Null and repeated
    ids stay as they are. If no document has a language, all others are ``und`` too.
    A text is read whole, however long, as windows of fixed length whose probabilities are
    averaged; of equal probabilities the language first in the alphabet counts; an empty
    table gives none. Columns of other names are ignored.
    """
    model, langs = train(docs, id_col, text_col, lang_col, max_train)
    return predict(docs, model, langs, id_col, text_col)

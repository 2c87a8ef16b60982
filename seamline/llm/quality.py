"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Every word bucket and every word shape has a sparse ternary index vector; a word's vector is the sum of the index vectors
of its neighbours in the fitting sample. A document is the mean of its words' vectors beside the mean of its shapes'. A
two-layer network maps that to a logit, which a temperature fitted on a fold of its own turns into a probability.

Fitting takes at most ``FIT_ROWS`` labelled rows (smallest hash of id); scoring takes every whole text, empty ones too.
Ids, sources and languages are never inputs.

Defined cases: a null text is empty; an empty text has the zero vector and the score that the network gives it; without
labelled rows every score is 0.5; a label table with several rows for an id counts the smallest; equal texts have equal
scores; repeated rows stay repeated; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.arrow import append_columns, rewrite_batches, texts_of
from seamline.llm.sampling import crc_of, fitting_rows
from seamline.llm.tokens import SHAPES, class_runs, pooled_means

#: Labelled rows that fitting sees at most.
FIT_ROWS = 4000
WORDS, DIM, NONZERO, WINDOW, HIDDEN = 1 << 14, 32, 4, 2, 24


def index_vectors(count: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: ``NONZERO`` entries of +1 or -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((count, DIM), dtype=np.float32)
    for _ in range(NONZERO):
        out[np.arange(count), rng.integers(0, DIM, count)] += rng.choice([-1.0, 1.0], count)
    return out


def context_vectors(words: list[np.ndarray], index: np.ndarray) -> np.ndarray:
    """For each word the sum of its neighbours' index vectors and its own, scaled to unit length; unseen words are zero."""
    out = np.zeros_like(index, dtype=np.float64)
    for ids in words:
        near = index[ids].copy()
        for d in range(1, WINDOW + 1):
            near[d:] += index[ids[:-d]] if d < len(ids) else 0
            near[:-d] += index[ids[d:]] if d < len(ids) else 0
        np.add.at(out, ids, near)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def pooled(self, texts: list[str]) -> np.ndarray:
        runs = class_runs(texts)
        ids = (runs.hashes % np.uint64(WORDS)).astype(np.int64)
        return np.hstack([pooled_means(self.words, ids, runs.offsets), pooled_means(self.shapes, runs.shapes, runs.offsets)])

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.tanh((pooled - self.centre) / self.scale @ w1 + b1) @ w2)[:, 0] + b2[0]

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pooled(texts)) / self.temperature, -40, 40)))


def train_layers(x: np.ndarray, y: np.ndarray, epochs: int = 120, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> list[np.ndarray]:
    """Two layers by Adam on the class-balanced logistic loss."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, (HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            b = order[at : at + 64]
            hidden = np.tanh(x[b] @ layers[0] + layers[1])
            z = (hidden @ layers[2])[:, 0] + layers[3][0]
            g = (weight[b] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[b]) / len(b))[:, None]
            back = g @ layers[2].T * (1 - hidden**2)
            grads = [x[b].T @ back + decay * layers[0], back.sum(0), hidden.T @ g + decay * layers[2], g.sum(0)]
            step += 1
            for i, d in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                layers[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit(rows: list[tuple[int, str, int]]) -> Model | None:
    """A model from ``(id, text, label)`` rows; None unless both labels occur. The id only assigns the calibration fold."""
    y = np.array([float(r[2]) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    index, words = index_vectors(WORDS, 1), []
    for _, text, _ in rows:
        words.append((class_runs([text]).hashes % np.uint64(WORDS)).astype(np.int64))
    model = Model(context_vectors(words, index), index_vectors(SHAPES, 2), np.zeros(2 * DIM), np.ones(2 * DIM), [])
    x = np.vstack([model.pooled([text]) for _, text, _ in rows])
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
    x = (x - model.centre) / model.scale
    aside = np.array([zlib.crc32(f"fold {r[0]}".encode()) % 5 == 0 for r in rows])
    if y[~aside].min(initial=1) == y[~aside].max(initial=0) or not aside.any():
        aside[:] = False
    model.layers = train_layers(x[~aside], y[~aside])
    if aside.any():
        z = model.logits(x[aside] * model.scale + model.centre)
        loss = {t: np.logaddexp(0, np.where(y[aside] > 0, -z, z) / t).mean() for t in np.geomspace(0.25, 8, 41)}
        model.temperature = float(min(loss, key=loss.get))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = FIT_ROWS) -> Model | None:
    """The model of the labelled rows that are not held out (CRC-32 of the id mod 4 is not 2)."""
    learnt = labels.where(crc_of(id_col) % 4 != 2).groupBy(id_col).agg(F.min(label_col).alias(label_col))
    return fit(fitting_rows(docs, learnt, id_col, text_col, label_col, limit))


SCORED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score_quality(df: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``keep`` columns plus score (0 to 1) and predicted (``score >= threshold``). See the module docstring."""

    def make(part) -> list:
        texts = texts_of(part, text_col)
        scores = [0.5] * len(texts) if model is None else model.scores(texts).tolist()
        return [scores, [int(s >= threshold) for s in scores]]

    return append_columns(df, keep, text_col, SCORED, make, limit=1 << 20)


def keep_good(df: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df``, all columns, whose score reaches the threshold; without a model every row."""
    if model is None:
        return df

    def change(part):
        return part.filter(pa.array(model.scores(texts_of(part, text_col)) >= threshold))

    return rewrite_batches(df, text_col, change, limit=1 << 20)

"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A document is the mean embedding of its byte n-grams (two to four bytes of lower-cased letters, with word edges), hashed
into ``BUCKETS``. Embeddings and softmax are trained together. A temperature is fitted on a fold of its own, and so is the
confidence under which a prediction is rejected (``accepted`` is false): the lowest at which ``ACCEPTED_RIGHT`` of the
fold's accepted rows are right.

Fitting takes at most ``FIT_ROWS`` labelled rows (smallest hash of id); prediction takes every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and not accepted; without labelled rows every
row is ``und``; with one language every text with a letter is of it; equal texts have equal results; repeated rows stay
repeated; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.llm.arrow import append_columns, texts_of
from seamline.llm.sampling import crc_of, fitting_rows
from seamline.llm.tokens import KIND, LETTER, pooled_means

#: Labelled rows that fitting sees at most.
FIT_ROWS = 2000
BUCKETS, DIM = 1 << 14, 16
UNKNOWN = "und"
ACCEPTED_RIGHT = 0.99
HAS_LETTER = re.compile(r"[^\W\d_]")

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[KIND != LETTER] = 32


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text by text, and the offsets of each text's."""
    raw = [b" " + t.encode() + b" " for t in texts]
    ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, dtype=np.int64)
    data = _LOWER[np.frombuffer(b"".join(raw) + b"   ", dtype=np.uint8)]
    n = len(data) - 3
    code = data[:n] << 8 | data[1 : n + 1]
    space = data == 32
    grams = np.empty((n, 3), dtype=np.uint32)
    fine = np.empty((n, 3), dtype=bool)
    fine[:, 0] = ~(space[:n] & space[1 : n + 1])
    fine[:, 1] = ~space[1 : n + 1]
    fine[:, 2] = ~(space[1 : n + 1] | space[2 : n + 2])
    grams[:, 0] = code * np.uint32(2654435761)
    code = code << 8 | data[2 : n + 2]
    grams[:, 1] = (code ^ np.uint32(0x55000000)) * np.uint32(2246822519)
    code = code << 8 | data[3 : n + 3]
    grams[:, 2] = (code ^ np.uint32(0x33)) * np.uint32(3266489917)
    counts = np.concatenate([[0], np.cumsum(fine.sum(1))])
    return (grams[fine] >> np.uint32(18)).astype(np.int64), np.concatenate([[0], counts[ends]]).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # per bucket: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    floor: float = 0.0

    def raw(self, texts: list[str]) -> np.ndarray:
        ids, offsets = subwords(texts)
        return pooled_means(self.logits, ids, offsets) + self.bias

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        z = z / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 40, rate: float = 8.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings and softmax by plain SGD; returns bucket logits and biases. Classes weigh alike."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (x.shape[1], DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.3, (DIM, classes)).astype(np.float32), np.zeros(classes, dtype=np.float32)
    weight = (1 / np.maximum(np.bincount(y, minlength=classes), 1)).astype(np.float32)[y]
    weight *= len(y) / weight.sum()
    for epoch in range(epochs):
        step = np.float32(rate * (1 - epoch / epochs) + 0.1)
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            b = order[at : at + 32]
            hidden = x[b] @ embed
            z = hidden @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p *= weight[b][:, None] / len(b)
            back = p @ soft.T
            soft -= np.float32(0.1) * step * (hidden.T @ p)
            bias -= np.float32(0.1) * step * p.sum(0)
            embed -= step * (x[b].T @ back)
    return embed @ soft, bias


def fit(rows: list[tuple[int, str, str]]) -> Model | None:
    """A model from ``(id, text, language)`` rows; the id only assigns the calibration fold."""
    rows = [r for r in rows if HAS_LETTER.search(r[1])]
    if not rows:
        return None
    languages = sorted({r[2] for r in rows})
    y = np.array([languages.index(r[2]) for r in rows])
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, (_, text, _) in enumerate(rows):
        ids, _ = subwords([text])
        x[i] = np.bincount(ids, minlength=BUCKETS) / max(1, len(ids))
    aside = np.array([zlib.crc32(f"fold {r[0]}".encode()) % 5 == 0 for r in rows])
    if len(set(y[~aside])) < len(languages):
        aside[:] = False
    table, bias = train(x[~aside], y[~aside], len(languages))
    model = Model(languages, table.astype(np.float32), bias)
    if aside.any():
        z, own = x[aside] @ table + bias, y[aside]

        def loss(t: float) -> float:
            s = z / t
            top = s.max(1)
            return float((np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(own)), own]).mean())

        model.temperature = float(min(np.geomspace(0.02, 8, 61), key=loss))
        p = model.probabilities(z)
        order = np.argsort(-p.max(1), kind="stable")
        right = np.cumsum((p.argmax(1) == own)[order]) / np.arange(1, len(own) + 1)
        good = np.flatnonzero(right >= ACCEPTED_RIGHT)
        model.floor = float(p.max(1)[order][good[-1]]) if len(good) else 1.0
    return model


def fit_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limit: int = FIT_ROWS) -> Model | None:
    """The model of the rows that are not held out (CRC-32 of the id mod 5 is not 0)."""
    learnt = docs.where((crc_of(id_col) % 5 != 0) & F.col(lang_col).isNotNull()).groupBy(id_col).agg(F.min(lang_col).alias(lang_col))
    return fit(fitting_rows(docs, learnt, id_col, text_col, lang_col, limit))


PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def predict_language(df: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus lang_pred, score and accepted. See the module docstring."""

    def make(part) -> list:
        texts = texts_of(part, text_col)
        known = [model is not None and HAS_LETTER.search(t) is not None for t in texts]
        if model is None:
            return [[UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)]
        p = model.probabilities(model.raw(texts))
        best, top = p.argmax(1), p.max(1)
        return [
            [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)],
            [float(s) if k else 0.0 for s, k in zip(top, known, strict=True)],
            [bool(k and s >= model.floor) for s, k in zip(top, known, strict=True)],
        ]

    return append_columns(df, keep, text_col, PREDICTED, make, limit=1 << 20)

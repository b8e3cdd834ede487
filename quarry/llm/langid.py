"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of byte n-grams (n = 1 to 4, hashed to
``FEATURES`` slots) present in both, over the geometric mean of their numbers
of n-grams. A Nystroem map over ``landmarks`` texts turns it into vectors, and
one-versus-rest kernel ridge regression is fitted on them. Landmark inverse
root and weights fold into one matrix, so scoring a batch is two matrix
products: presence by landmarks, landmarks by languages.

A text is scored in windows of equal size, at most ``WINDOW`` bytes, over its
whole length. Scores and n-grams in common with each landmark are added up over
the windows, so neither depends on the length of the text. Landmarks come from
one window of at most ``TRAIN_BYTES`` of each training text: that of a longer
text would hold n-grams of any language.

A text is rejected when it holds no letter, or when no landmark holds enough of
its windows' n-grams: no language's texts resemble it. How much is enough is
learnt (:func:`threshold`): what 9 in 10 training texts with their bytes
shuffled don't reach, but always less than any held-out training text has.

Cases
-----
* Null, empty and blank texts: language and scores are null, rejected.
* Training rows need a label and a text; a null label trains nothing. The
  sample is bounded: at most ``per_language`` rows of each label, those with
  the smallest hash of (id, label).
* Without any training row, ``language`` is null and no text with letters is
  rejected. With a single label, every text with letters gets it.
* Equal scores go to the alphabetically first language. Repeated rows are
  scored each. An empty table gives an empty result. Other columns are ignored
  by :func:`identify` and carried by :func:`keep_identified`, whatever their
  names. Texts of any length are scored whole; of a training text longer
  than ``TRAIN_BYTES``, the window in the middle is learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common as C

FEATURES = 1 << 14
NGRAMS = (1, 2, 3, 4)
PER_LANGUAGE = 300
LANDMARKS = 192
RIDGE = 1e-2
MIN_COVERAGE = 0.4  # where there are too few training rows to hold any out
NOISE_SHARE = 0.9
WINDOW = 1 << 12
TRAIN_BYTES = 1 << 13
_ROWS = 128


def presence(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) 0/1: the hashed n-grams of each text."""
    rows = len(offs) - 1
    x = np.zeros(rows * FEATURES, np.uint8)
    if len(buf):
        sizes = np.diff(offs)
        base = np.repeat(np.arange(rows, dtype=np.int64) * FEATURES, sizes)
        left = np.repeat(offs[1:], sizes) - np.arange(len(buf))
        code = np.zeros(len(buf), np.uint32)
        for n in range(1, max(NGRAMS) + 1):
            code[: len(buf) - n + 1] |= buf[n - 1 :].astype(np.uint32) << np.uint32(8 * (n - 1))
            if n in NGRAMS:
                h = ((code + np.uint32(n * 0x51ED270B & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)
                ok = left >= n
                x[base[ok] + h[ok]] = 1
    return x.reshape(rows, FEATURES)


def _chunks(arr: pa.Array):
    for first, buf, offs in C.text_chunks(pc.utf8_lower(arr.cast(pa.large_string()))):
        for a in range(0, len(offs) - 1, _ROWS):
            o = offs[a : a + _ROWS + 1]
            yield first + a, buf[o[0] : o[-1]], o - o[0]


def _has_letter(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    letter = C._WORD[buf] & ~((buf >= 48) & (buf <= 57))
    total = np.concatenate(([0], np.cumsum(letter)))
    return total[offs[1:]] > total[offs[:-1]]


def windows(offs: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the windows of each text, of nearly equal size within a text, and the row of each window."""
    sizes = np.diff(offs)
    n = np.maximum(-(-sizes // size), 1)
    row = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return np.append(offs[row] + sizes[row] * k // n[row], offs[-1]), row


def _middle(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts cut to their window in the middle; those within ``TRAIN_BYTES`` stay whole."""
    w, row = windows(offs, TRAIN_BYTES)
    first = np.searchsorted(row, np.arange(len(offs) - 1))
    k = first + np.bincount(row, minlength=len(offs) - 1) // 2
    parts = [buf[a:b] for a, b in zip(w[k], w[k + 1])]
    return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of two 0/1 matrices."""
    nx, ny = (np.sqrt(np.maximum(m.sum(axis=1, dtype=np.int64), 1)).astype(np.float32) for m in (x, y))
    return (x.astype(np.float32) @ y.astype(np.float32).T) / nx[:, None] / ny[None, :]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # (m, FEATURES) 0/1, packed
    weights: np.ndarray  # (m, languages)
    bias: np.ndarray
    min_coverage: float = MIN_COVERAGE

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the texts by language, and the largest share of their windows' n-grams that one landmark holds."""
        if not hasattr(self, "_columns"):
            y = np.unpackbits(self.landmarks, axis=1)
            self._norm = np.sqrt(np.maximum(y.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
            self._columns = np.ascontiguousarray(y.T.astype(np.float32))
        rows, (w, row) = len(offs) - 1, windows(offs)
        score, held, total = np.zeros((rows, len(self.languages))), np.zeros((rows, len(self._norm))), np.zeros((rows, 1))
        for a in range(0, len(row), _ROWS):
            at, r = w[a : a + _ROWS + 1], row[a : a + _ROWS]
            x = presence(buf[at[0] : at[-1]], at - at[0])
            size = np.maximum(x.sum(axis=1, dtype=np.int64), 1).astype(np.float32)[:, None]
            common = x.astype(np.float32) @ self._columns
            np.add.at(score, r, size * ((common / np.sqrt(size) / self._norm) @ self.weights + self.bias))
            np.add.at(held, r, common)
            np.add.at(total, r, size)
        return score / total, (held / total).max(axis=1)


def fit(x: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on a presence matrix; landmarks are taken in turn from every language."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels], np.int64)
    rank = np.zeros(len(y), np.int64)
    for c in range(len(languages)):
        rank[y == c] = np.arange((y == c).sum())
    pick = np.lexsort((y, rank))[:landmarks]
    kmm = kernel(x[pick], x[pick]).astype(np.float64)
    value, vector = np.linalg.eigh(kmm)
    root = (vector / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    phi = np.hstack([kernel(x, x[pick]) @ root, np.ones((len(x), 1))])
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1.0 / np.bincount(y, minlength=len(languages))[y]  # every language counts alike
    penalty = np.diag([ridge] * len(pick) + [1e-9]) / max(len(pick), 1)
    w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + penalty, phi.T @ (target * weight[:, None]))
    return Model(languages, np.packbits(x[pick], axis=1), (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32))


def coverage(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """The largest share of each text's n-grams that one landmark holds."""
    return (x.astype(np.float32) @ landmarks.astype(np.float32).T).max(axis=1) / np.maximum(x.sum(axis=1, dtype=np.int64), 1)


def threshold(x: np.ndarray, noise: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> float:
    """The least coverage of an accepted text, from a fifth of the rows and their shuffled bytes, by the landmarks of the others."""
    held = np.arange(len(x)) % 5 == 4
    if held.sum() < 10:
        return MIN_COVERAGE
    marks = np.unpackbits(fit(x[~held], [v for v, h in zip(labels, held) if not h], landmarks, ridge).landmarks, axis=1)
    return float(min(np.quantile(coverage(noise[held], marks), NOISE_SHARE), 0.9 * coverage(x[held], marks).min()))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Fit on a bounded sample of labelled rows; their n-grams are collected, not their texts."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).where("label IS NOT NULL AND id IS NOT NULL")
    w = Window.partitionBy("label").orderBy(F.xxhash64("id", "label"), "id")
    ids = slim.select("id", "label").distinct().withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language).select("id", "label")
    chosen = slim.where("text IS NOT NULL").join(F.broadcast(ids), ["id", "label"])  # at most per_language rows a label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, buf, offs in _chunks(C.column(b, "text")):
                buf, offs = _middle(buf, offs)
                part = b.slice(first, len(offs) - 1)
                order = np.lexsort((np.random.default_rng(len(buf)).random(len(buf)), np.repeat(np.arange(len(offs) - 1), np.diff(offs))))
                bits, noise = (pa.array([r.tobytes() for r in np.packbits(presence(t, offs), axis=1)], pa.binary()) for t in (buf, buf[order]))
                yield pa.RecordBatch.from_arrays([C.column(part, "label"), C.column(part, "id").cast(pa.string()), pa.array(_has_letter(buf, offs)), bits, noise], ["label", "id", "ok", "bits", "noise"])

    p = C.map_arrow(chosen, run, "label string, id string, ok boolean, bits binary, noise binary").where("ok").toPandas()
    if p.empty:
        return None
    p = p.sort_values(["label", "id", "bits"]).drop_duplicates(["label", "id"])
    x, noise = (np.unpackbits(np.frombuffer(b"".join(p[c]), np.uint8).reshape(len(p), -1), axis=1) for c in ("bits", "noise"))
    model = fit(x, p["label"].tolist(), landmarks, ridge)
    model.min_coverage = threshold(x, noise, p["label"].tolist(), landmarks, ridge)
    return model


def predict(arr: pa.Array, model: Model | None, min_coverage: float | None = None) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, best score, lead over the second, coverage, and whether accepted, of every text."""
    n = len(arr)
    language: list = [None] * n
    score, margin, coverage, ok = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, bool)
    for first, buf, offs in _chunks(arr):
        k = np.flatnonzero(_has_letter(buf, offs))
        if model is None:
            ok[first + k] = True
            continue
        if not len(k):
            continue
        s, c = (x[k] for x in model.scores(buf, offs))
        best = s.argmax(axis=1)
        top = np.sort(s, axis=1)
        for j, b in zip(first + k, best):
            language[j] = model.languages[b]
        score[first + k] = top[:, -1]
        margin[first + k] = top[:, -1] - (top[:, -2] if s.shape[1] > 1 else 0)
        coverage[first + k] = c
        ok[first + k] = c >= (model.min_coverage if min_coverage is None else min_coverage)
    return language, score, margin, coverage, ok


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float | None = None) -> DataFrame:
    """(doc_id, language, score, margin, coverage, accepted) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            language, score, margin, coverage, ok = predict(C.column(b, "text"), held.value, min_coverage)
            yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), pa.array(language, pa.string()), pa.array(score, from_pandas=True), pa.array(margin, from_pandas=True), pa.array(coverage, from_pandas=True), pa.array(ok)], ["doc_id", "language", "score", "margin", "coverage", "accepted"])

    return C.map_arrow(slim, run, f"doc_id {dict(slim.dtypes)['doc_id']}, language string, score double, margin double, coverage double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", min_coverage: float | None = None, label_col: str | None = None) -> DataFrame:
    """``docs`` without the rejected rows; nothing is shuffled. Where the string column ``label_col`` is null, it gets the language found."""
    held, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    label = None if label_col is None else docs.columns.index(label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            language, _, _, _, ok = predict(b.column(place), held.value, min_coverage)
            if label is not None:
                filled = pc.coalesce(b.column(label), pa.array(language, pa.string()).cast(b.column(label).type))
                b = b.set_column(label, b.schema.field(label), filled)
            yield b.filter(pa.array(ok))

    return C.map_arrow(docs, run, docs.schema)

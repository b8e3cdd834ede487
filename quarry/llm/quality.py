"""Quality classifier on random-indexing word vectors.

Tokens are runs of letters and digits or runs of other visible characters,
lower-cased. A word's vector has two parts. The index part is the sum of sparse
ternary index vectors: the word's own and those of its prefixes of ``PREFIXES``
bytes, so that words of one stem lie near each other; they follow from the
hashes, for any number of words. The context part comes from a pass over the
whole corpus, which adds to each of ``CONTEXT_SLOTS`` slots the index vectors of
the tokens up to ``WINDOW`` places away. The same pass counts the texts that
hold each word and prefix, in ``SLOTS`` slots. A text is pooled as the sum of its
tokens' vectors, weighted by inverse document frequency, with little weight for
those too rare to have a reliable vector, and scaled to unit weight. A two-layer
numpy network gives logits for quality and toxicity, whose probabilities are
calibrated by a temperature each, fitted on held-out rows.

Cases
-----
* Null texts and texts without a token: probabilities are null, not kept.
* Labels that are null train nothing; an id with several label rows trains
  with the first by value; repeated rows of a text are scored each.
* The labelled sample is bounded by ``max_train`` rows, those with the
  smallest id hash; corpus statistics cover all rows.
* Without labels of both kinds a head gives the share of its positive labels
  (1/2 without any). A probability of exactly ``min_quality`` or ``max_toxic``
  is kept.
* Texts of any length are read whole. An empty table gives an empty result.
  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common as C

SLOTS = 1 << 18
CONTEXT_SLOTS = 1 << 14
CONTEXT_DIM = 32
OWN_DIM = 8192
NONZERO = 8
PREFIXES = (4, 6)
WINDOW = 2
HIDDEN = 32
MAX_TRAIN = 6000
EPOCHS = 60
BATCH = 256
RARE = 5e-3
_ROWS = 256

_CLASS = np.where(C._WORD, 1, 2).astype(np.uint8)
_CLASS[:33] = 0
_CLASS[127] = 0


def context_index(seed: int = 1) -> np.ndarray:
    """Sparse ternary vectors of the context slots."""
    rng = np.random.default_rng(seed)
    width = CONTEXT_DIM // NONZERO
    place = np.sort(rng.integers(0, width, (CONTEXT_SLOTS, NONZERO)) + np.arange(NONZERO) * width, axis=1)
    out = np.zeros((CONTEXT_SLOTS, CONTEXT_DIM), np.int16)
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.int16), (CONTEXT_SLOTS, NONZERO)), axis=1)
    return out


def own_index(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ``NONZERO`` entries of each feature's index vector."""
    g = C.mix(hashes[:, None] + np.arange(1, NONZERO + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (g % np.uint64(OWN_DIM)).astype(np.int64), np.where(g >> np.uint64(63), np.float32(1), np.float32(-1))


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every token, in order, and of every prefix of one."""
    if not len(buf):
        z, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return h, z, h, z
    kind = _CLASS[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    edge[1:-1] |= kind[1:] != kind[:-1]
    edge[0] = edge[-1] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    ok = kind[starts] > 0
    starts, ends = starts[ok], ends[ok]
    row = np.searchsorted(offs, starts, "right") - 1
    longer = [ends - starts > n for n in PREFIXES]
    heads = [C.mix(C.span_hashes(buf, starts[k], starts[k] + n) + np.uint64(n)) for n, k in zip(PREFIXES, longer)]
    return C.span_hashes(buf, starts, ends), row, np.concatenate(heads), np.concatenate([row[k] for k in longer])


def _slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _chunks(arr: pa.Array):
    return C.text_chunks(pc.utf8_lower(arr.cast(pa.large_string())))


@dataclass
class Vectors:
    """What the corpus pass gathers."""

    context: np.ndarray  # (CONTEXT_SLOTS, CONTEXT_DIM) sums
    df: np.ndarray  # by slot
    n: int
    _ready: tuple = field(default=None, repr=False)

    def __getstate__(self):
        return {"context": self.context.astype(np.float32), "df": self.df.astype(np.int64), "n": self.n, "_ready": None}

    def ready(self) -> tuple[np.ndarray, np.ndarray]:
        """Normalised contexts and pooling weights, by slot."""
        if self._ready is None:
            context = self.context / np.maximum(np.linalg.norm(self.context, axis=1, keepdims=True), 1e-9)
            share = self.df / max(self.n, 1)
            weight = -np.log(np.maximum(share, 1e-9)) * share / (share + RARE)
            self._ready = context.astype(np.float32), np.maximum(weight, 1e-3).astype(np.float32)
        return self._ready


def corpus_vectors(docs: DataFrame, text_col: str = "text") -> Vectors:
    """One pass over all texts; every task sends one row for each number that isn't 0, and these are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = context_index()
        total, df, n = np.zeros((CONTEXT_SLOTS, CONTEXT_DIM), np.int64), np.zeros(SLOTS, np.int64), 0
        for b in batches:
            for _, buf, offs in _chunks(b.column(0)):
                word, row, head, of = features(buf, offs)
                if not len(word):
                    continue
                pairs = np.unique(np.concatenate((row * SLOTS + _slot(word, SLOTS), of * SLOTS + _slot(head, SLOTS))))
                df += np.bincount(pairs % SLOTS, minlength=SLOTS)
                n += len(np.unique(row))
                slot = _slot(word, CONTEXT_SLOTS)
                near = np.zeros((len(slot), CONTEXT_DIM), np.int16)
                for d in range(1, WINDOW + 1):
                    same = (row[d:] == row[:-d])[:, None]
                    near[d:] += index[slot[:-d]] * same
                    near[:-d] += index[slot[d:]] * same
                order = np.argsort(slot, kind="stable")
                first = np.flatnonzero(np.diff(slot[order], prepend=-1))
                total[slot[order][first]] += np.add.reduceat(near[order], first, axis=0, dtype=np.int64)
        every = np.concatenate((df, total.ravel(), [n]))  # numbered by place
        k = np.flatnonzero(every)
        for a in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(k[a : a + (1 << 16)].astype(np.int32)), pa.array(every[k[a : a + (1 << 16)]])], ["place", "v"])

    part = C.map_arrow(docs.select(F.col(text_col).alias("text")), run, "place int, v bigint")
    p = part.groupBy("place").agg(F.sum("v").alias("v")).toArrow()  # as many rows as there are slots, whatever the corpus
    every = np.zeros(SLOTS + CONTEXT_SLOTS * CONTEXT_DIM + 1, np.int64)
    every[p["place"].to_numpy()] = p["v"].to_numpy()
    return Vectors(every[SLOTS:-1].reshape(CONTEXT_SLOTS, CONTEXT_DIM).astype(np.float32), every[:SLOTS], int(every[-1]))


def pool(arr: pa.Array, vectors: Vectors) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, pooled vectors, number of tokens) of runs of texts: the index part, then the context part."""
    context, weight = vectors.ready()
    for first, buf, offs in _chunks(arr):
        word, row, head, of = features(buf, offs)
        whole = np.bincount(row, minlength=len(offs) - 1)
        key, at = np.concatenate((word, head)), np.concatenate((row, of))
        order = np.lexsort((key, at))
        key, at = key[order], at[order]
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])))) if len(key) else np.zeros(0, np.int64)
        w = weight[_slot(key[new], SLOTS)] * (1 + np.log(np.diff(np.append(new, len(key))))).astype(np.float32)
        is_word = (order < len(word))[new]
        key, at = key[new], at[new]
        norm = np.sqrt(np.bincount(at, w.astype(float) ** 2, len(offs) - 1))
        w = (w / np.maximum(norm, 1e-9)[at]).astype(np.float32)
        for a in range(0, len(offs) - 1, _ROWS):
            n = min(_ROWS, len(offs) - 1 - a)
            lo, hi = np.searchsorted(at, [a, a + n])
            out = np.zeros((n, OWN_DIM + CONTEXT_DIM), np.float32)
            flat = np.zeros(n * OWN_DIM)
            for c in range(lo, hi, 1 << 16):
                e = min(hi, c + (1 << 16))
                place, sign = own_index(key[c:e])
                flat += np.bincount((((at[c:e] - a) * OWN_DIM)[:, None] + place).ravel(), (sign * w[c:e, None]).ravel(), n * OWN_DIM)
            out[:, :OWN_DIM] = flat.reshape(n, OWN_DIM)
            k = lo + np.flatnonzero(is_word[lo:hi])
            np.add.at(out[:, OWN_DIM:], at[k] - a, w[k, None] * context[_slot(key[k], CONTEXT_SLOTS)])
            yield first + a, out, whole[a : a + n]


@dataclass
class Network:
    """Standardisation, two layers and a temperature per head."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [np.tanh((x[a : a + _ROWS] - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2 for a in range(0, len(x), _ROWS)]
        return np.concatenate(parts) if parts else np.zeros((0, self.w2.shape[1]))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _nll(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least held-out loss."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 200))
    return float(grid[np.argmin([_nll(z / t, y) for t in grid])]) if len(y) else 1.0


def fit(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 7, decay: float = 1e-3) -> Network:
    """Adam in batches on four fifths of the rows, temperatures on the fifth that is left."""
    rng = np.random.default_rng(seed)
    held = np.arange(len(x)) % 5 == 4
    mean = x.mean(axis=0, dtype=np.float32)
    spread = np.sqrt(max(0.0, sum(float((x[a : a + 256].astype(float) ** 2).sum()) for a in range(0, len(x), 256)) / x.size - float(mean.mean()) ** 2))
    scale = np.full(x.shape[1], spread + 1e-6, np.float32)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.1, (hidden, y.shape[1])), np.zeros(y.shape[1])]
    p = [a.astype(np.float32) for a in p]
    m, v, k = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    share = y.mean(axis=0)
    if not ((share > 0) & (share < 1)).any():
        epochs = 0
    a, t = np.flatnonzero(~held), y.astype(np.float32)  # the matrix isn't copied
    for epoch in range(epochs):
        rate = 0.003 * (1 - epoch / epochs)
        for part in np.array_split(a[rng.permutation(len(a))], max(1, len(a) // BATCH)):
            xs = (x[part] - mean) / scale
            h = np.tanh(xs @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -60, 60))) - t[part]) / len(part)
            back = (g @ p[2].T) * (1 - h * h)
            k += 1
            for i, gr in enumerate([xs.T @ back + decay * p[0], back.sum(axis=0), h.T @ g + decay * p[2], g.sum(axis=0)]):
                m[i] += 0.1 * (gr - m[i])
                v[i] += 0.001 * (gr * gr - v[i])
                p[i] -= rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.999**k)) + 1e-8)
    for c in np.flatnonzero((share <= 0) | (share >= 1)):
        p[2][:, c], p[3][c] = 0, 60 if share[c] >= 1 else -60
    net = Network(mean, scale, *p, np.ones(y.shape[1]))
    z = net.logits(x[held])
    net.temperature = np.array([calibrate(z[:, c], y[held][:, c]) if 0 < share[c] < 1 else 1.0 for c in range(y.shape[1])])
    return net


def train(docs: DataFrame, labels: DataFrame, vectors: Vectors, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Network | None:
    """Fit on at most ``max_train`` labelled rows; their pooled vectors are fetched a partition at a time, not texts."""
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("id").agg(F.min(F.struct("quality", "toxic")).alias("y")).select("id", "y.quality", "y.toxic").orderBy(F.xxhash64("id"), "id").limit(max_train)
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(known), "id")  # max_train rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, x, n in pool(C.column(b, "text"), held.value):
                part = b.slice(first, len(x))
                own, where = np.nonzero(x[n > 0])
                size = np.bincount(own, minlength=int((n > 0).sum()))
                cut = np.cumsum(size)[:-1]
                part = part.filter(pa.array(n > 0))
                value = x[n > 0][own, where].astype("<f2")
                yield pa.RecordBatch.from_arrays(
                    [C.column(part, "id").cast(pa.string()), C.column(part, "quality"), C.column(part, "toxic"), pa.array([v.tobytes() for v in np.split(where.astype("<u2"), cut)] if len(size) else [], pa.binary()), pa.array([v.tobytes() for v in np.split(value, cut)] if len(size) else [], pa.binary())],
                    ["id", "quality", "toxic", "places", "vector"],
                )

    found = C.map_arrow(rows, run, "id string, quality int, toxic int, places binary, vector binary")
    found = C.cut(found.groupBy("id").agg(F.min(F.struct("places", "vector", "quality", "toxic")).alias("r")).select("id", "r.*"))
    ids = sorted(r.id for r in found.select("id").collect())
    n = len(ids)
    if not n:
        return None
    place = {i: int(k) for i, k in zip(ids, np.random.default_rng(1).permutation(n))}
    x, y = np.zeros((n, OWN_DIM + CONTEXT_DIM), np.float16), np.zeros((n, 2), np.int64)
    for r in found.toLocalIterator():
        k = place[r.id]
        x[k, np.frombuffer(bytes(r.places), "<u2")] = np.frombuffer(bytes(r.vector), "<f2")
        y[k] = r.quality, r.toxic
    return fit(x, y)


def score(docs: DataFrame, vectors: Vectors, net: Network | None, id_col: str = "doc_id", text_col: str = "text", min_quality: float = 0.5, max_toxic: float = 0.5) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep) of every row."""
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, trained = held.value
            for first, x, n in pool(C.column(b, "text"), vec):
                part = b.slice(first, len(x))
                p = trained.probabilities(x) if trained else np.full((len(x), 2), 0.5)
                p[n == 0] = np.nan
                keep = (n > 0) & (p[:, 0] >= min_quality) & ~(p[:, 1] > max_toxic)
                yield pa.RecordBatch.from_arrays([C.column(part, "doc_id"), pa.array(p[:, 0], from_pandas=True), pa.array(p[:, 1], from_pandas=True), pa.array(keep)], ["doc_id", "p_quality", "p_toxic", "keep"])

    return C.map_arrow(slim, run, f"doc_id {dict(slim.dtypes)['doc_id']}, p_quality double, p_toxic double, keep boolean")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Gather, fit and score."""
    vectors = corpus_vectors(docs, text_col)
    return score(docs, vectors, train(docs, labels, vectors, id_col, text_col), id_col, text_col)

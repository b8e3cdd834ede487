"""Embedders: functions from a list of texts to a list of vectors, applied to a column in batches."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def hashed(dimensions: int = 64) -> Embedder:
    """Signed token hashes; no model and no service."""
    return lambda texts: [text.embed_text(t, dimensions) for t in texts]


def none(dimensions: int = 0) -> Embedder:
    """Zero vectors, where semantic search is switched off."""
    return lambda texts: [[0.0] * dimensions for _ in texts]


def http(url: str, timeout: float = 30.0) -> Embedder:
    """A service that takes ``{"inputs": [...]}`` and answers with ``embeddings``, or ``data`` of objects that have one each."""

    def run(texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        body = json.dumps({"inputs": texts, "input": texts}).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=timeout) as r:
            got = json.load(r)
        if got.get("error"):
            raise ValueError(f"the embedding service failed: {got['error']}")
        return got.get("embeddings") or [x["embedding"] for x in got.get("data") or []]

    return run


def embed(df: DataFrame, embedder: Embedder, id_col: str = "doc_id", text_col: str = "content", batch_size: int = 64, pause: float = 0.0, skip_errors: bool = False) -> DataFrame:
    """(id, values): each text's vector, ``batch_size`` texts a call, null texts as empty ones.

    An embedder that raises, or returns another number of vectors, fails the
    task, which Spark repeats; with ``skip_errors`` the batch gets null vectors.
    ``pause`` seconds lie between the calls of a task.
    """
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = 0.0
        for batch in batches:
            for a in range(0, batch.num_rows, batch_size):
                part = batch.slice(a, batch_size)
                if pause and (wait := last + pause - time.monotonic()) > 0:
                    time.sleep(wait)
                last = time.monotonic()
                try:
                    got = embedder([x or "" for x in part.column(1).to_pylist()])
                    if len(got) != part.num_rows:
                        raise ValueError(f"{len(got)} vectors for {part.num_rows} texts")
                    values = [[float(x) for x in v] for v in got]
                except Exception:
                    if not skip_errors:
                        raise
                    values = [None] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.list_(pa.float64()))], [id_col, "values"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, values array<double>")

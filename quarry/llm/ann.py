"""Nearest neighbours of a query set with a hash-prefix forest.

Each of ``trees`` trees gives every vector a string of ``BITS`` random
hyperplane signs; sorted, the vectors that share a prefix are one range of the
array. A query descends to its longest match in every tree; then all trees
ascend together, one bit at a time, until their ranges hold ``candidates``
vectors in total. The candidates are ranked by exact cosine similarity. The
similarity of the k-th then tells how likely a better vector shares ``x`` bits
in none of the trees; where that exceeds ``miss``, the trees ascend on to the
deepest level at which it doesn't. Clustered vectors stop early; vectors without
near neighbours are compared with a large part of the table, which is what
recall asks for there.

The points stay where they are: every task keeps sorted arrays of up to
``BLOCK`` of its points at a time, and the ranges of all tasks together are the
range of the forest, so their sizes are added up before a level is chosen. The
queries are broadcast in blocks of at most ``QUERY_BYTES``, each of which takes
its own passes; a task returns at most ``k`` rows for a query and a pass.

Cases
-----
* Rows with a null id, a null or empty vector, or a null or non-finite entry
  are no points. A zero vector has similarity 0 to all.
* Vectors are compared with those of the same dimension only.
* Repeated rows are one point. An id with several vectors is one query with
  the union of their neighbours, and is never its own neighbour.
* Equal similarities are ranked by neighbour id. With fewer than ``k`` other
  vectors a query gets them all.
* An empty table, or one without a query, gives an empty result. Other columns
  are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm import common as C

K = 10
TREES = 24
BITS = 24
CANDIDATES = 3000
MISS = 0.1
BLOCK = 8192
QUERY_BYTES = 16 << 20
_ROWS = 512
_SPARSE = 0.03


def hyperplanes(dim: int, trees: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, trees * BITS)).astype(np.float32)


def codes(x: np.ndarray, trees: int) -> np.ndarray:
    """(n, trees) hash strings as numbers, first bit highest."""
    bits = (x @ hyperplanes(x.shape[1], trees) > 0).reshape(len(x), trees, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _points(df: DataFrame, id_col: str, vec_col: str, asks: Column | None, trees: int) -> DataFrame:
    """(id, ask, dim, code, x): unit vectors with their hash strings, as bytes."""
    ask = F.lit(True) if asks is None else F.coalesce(asks, F.lit(False))
    slim = df.select(F.col(id_col).alias("id"), ask.alias("ask"), F.col(vec_col).cast("array<float>").alias("v")).where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = float('infinity'))").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = C.column(b, "v")
            flat, dims = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), pc.list_value_length(v).to_numpy(zero_copy_only=False)
            first = np.cumsum(dims) - dims
            for d in np.unique(dims):
                k = np.flatnonzero(dims == d)
                x = flat[first[k][:, None] + np.arange(d)]
                x = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).astype(np.float32)
                part = b.take(pa.array(k))
                yield pa.RecordBatch.from_arrays([C.column(part, "id"), C.column(part, "ask"), pa.array(np.full(len(k), d, np.int32)), _bytes(codes(x, trees).astype("<i4")), _bytes(x)], ["id", "ask", "dim", "code", "x"])

    return C.map_arrow(slim, run, f"id {dict(slim.dtypes)['id']}, ask boolean, dim int, code binary, x binary")


def _bytes(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1) if rows else np.zeros((0, 1), kind)


@dataclass
class Queries:
    """A block of queries, numbered; those of one dimension stand together."""

    ids: pa.Array
    dim: np.ndarray
    code: np.ndarray  # (n, trees)
    x: dict[int, np.ndarray]  # by dimension
    level: np.ndarray
    floor: np.ndarray  # similarities below it aren't wanted

    def of(self, dim: int) -> np.ndarray:
        return np.flatnonzero(self.dim == dim)


def _blocks(points: DataFrame, size: int) -> Iterator[Queries]:
    """The queries in blocks of at most ``size`` bytes, one at a time on the driver."""
    kind = to_arrow_type(points.schema["id"].dataType)
    held, total = [], 0

    def block() -> Queries:
        held.sort(key=lambda r: r[1])
        dim = np.array([r[1] for r in held])
        x = {int(d): np.frombuffer(b"".join(r[3] for r in held if r[1] == d), np.float32).reshape(-1, d) for d in np.unique(dim)}
        code = np.frombuffer(b"".join(r[2] for r in held), "<i4").reshape(len(held), -1).astype(np.int64)
        return Queries(pa.array([r[0] for r in held], kind), dim, code, x, np.zeros(len(held), np.int64), np.full(len(held), -2.0))

    for r in points.where("ask").select("id", "dim", "code", "x").toLocalIterator():
        held.append((r[0], r[1], bytes(r[2]), bytes(r[3])))
        total += len(r[2]) + len(r[3]) + 64
        if total > size:
            yield block()
            held, total = [], 0
    if held:
        yield block()


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(dimension, ids, codes, vectors) of up to ``BLOCK`` points."""
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            b = batch.slice(a, BLOCK)
            dims = C.column(b, "dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                yield int(d), C.column(part, "id"), _matrix(C.column(part, "code"), "<i4").astype(np.int64), _matrix(C.column(part, "x"), np.float32)


def _ranges(sorted_codes: np.ndarray, code: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Where the points that share the first ``level`` bits of each query begin and end."""
    low = (code >> (BITS - level)) << (BITS - level)
    return np.searchsorted(sorted_codes, low), np.searchsorted(sorted_codes, low + (np.int64(1) << (BITS - level)))


def _level_counts(points: DataFrame, held) -> np.ndarray:
    """(queries, BITS + 1): how many points the ranges of all trees hold at every level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = held.value
        total = np.zeros((len(q.dim), BITS + 1), np.int64)
        for dim, _, code, _ in _forests(batches):
            rows = q.of(dim)
            if not len(rows):
                continue
            for t in range(code.shape[1]):
                s = np.sort(code[:, t])
                for x in range(BITS + 1):
                    lo, hi = _ranges(s, q.code[rows, t], x)
                    total[rows, x] += hi - lo
        keep = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(keep.astype(np.int64)), *[pa.array(total[keep, x]) for x in range(BITS + 1)]], ["q", *[f"n{x}" for x in range(BITS + 1)]])

    part = C.map_arrow(points.select("id", "dim", "code", "x"), run, "q bigint, " + ", ".join(f"n{x} bigint" for x in range(BITS + 1)))
    p = part.groupBy("q").agg(*[F.sum(f"n{x}").alias(f"n{x}") for x in range(BITS + 1)]).toPandas()  # a row for each query of the block
    out = np.zeros((len(held.value.dim), BITS + 1), np.int64)
    out[p["q"]] = p[[f"n{x}" for x in range(BITS + 1)]]
    return out


def level_for(similarity: np.ndarray, trees: int, miss: float) -> np.ndarray:
    """The deepest level at which a vector of this similarity is in no tree's range with a chance of at most ``miss``."""
    p = 1 - np.arccos(np.clip(similarity, -1, 1)) / np.pi
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(np.log(1 - miss ** (1 / trees)) / np.log(np.clip(p, 1e-9, 1 - 1e-9)) + 1e-9), 0, BITS).astype(np.int64)


def _candidates(sorted_codes: list[np.ndarray], orders: list[np.ndarray], code: np.ndarray, level: np.ndarray) -> np.ndarray:
    """(queries, points): what stands in the range of any tree."""
    inside = np.zeros((len(code), len(orders[0])), bool)
    for t, order in enumerate(orders):
        lo, hi = _ranges(sorted_codes[t], code[:, t], level)
        by = np.lexsort((hi, lo))
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0))))
        for a, b in zip(cut, np.append(cut[1:], len(by))):  # queries of one prefix share a range
            l, h = lo[by[a]], hi[by[a]]
            if l < h:
                inside[np.ix_(by[a:b], order[l:h])] = True
    return inside


def _search(points: DataFrame, held, k: int) -> DataFrame:
    """(q, neighbor, similarity): the best ``k`` of every task's points for each query, within the ranges of its level."""
    kind = dict(points.dtypes)["id"]
    arrow = to_arrow_type(points.schema["id"].dataType)

    def best(t: pa.Table) -> pa.Table:
        """At most ``k`` rows for each query: most similar first, ties in order of id."""
        t = t.take(pc.sort_indices(t, sort_keys=[("q", "ascending"), ("similarity", "descending"), ("neighbor", "ascending")]))
        q = t["q"].to_numpy()
        first = np.flatnonzero(np.diff(q, prepend=-1))
        return t.take(pa.array(np.flatnonzero(np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = held.value
        found = pa.table({"q": pa.array([], pa.int64()), "neighbor": pa.array([], arrow), "similarity": pa.array([], pa.float64())})
        for dim, ids, code, x in _forests(batches):
            every = queries.of(dim)
            if not len(every):
                continue
            orders = [np.argsort(code[:, t], kind="stable") for t in range(code.shape[1])]
            ordered = [code[o, t] for t, o in enumerate(orders)]
            offset = every[0]
            for a in range(0, len(every), _ROWS):
                rows = every[a : a + _ROWS]
                inside = _candidates(ordered, orders, queries.code[rows], queries.level[rows])
                own = pc.index_in(queries.ids.take(pa.array(rows)), ids)
                for r, i in enumerate(own.to_pylist()):
                    if i is not None:
                        inside[r, np.asarray(pc.equal(ids, ids[i]).to_numpy(zero_copy_only=False), bool)] = False
                y = queries.x[dim][rows - offset]
                if inside.mean() > _SPARSE:
                    sim = y @ x.T
                    sim[~inside] = -np.inf
                    m = min(k, sim.shape[1])
                    last = np.partition(sim, sim.shape[1] - m, axis=1)[:, sim.shape[1] - m]
                    i, j = np.nonzero((sim >= np.maximum(last, queries.floor[rows].astype(np.float32))[:, None]) & inside)
                    s = sim[i, j]
                else:
                    i, j = np.nonzero(inside)
                    s = np.einsum("ij,ij->i", y[i], x[j])
                    ok = s >= queries.floor[rows][i].astype(np.float32)
                    i, j, s = i[ok], j[ok], s[ok]
                if len(i):
                    found = best(pa.concat_tables([found, pa.table({"q": pa.array(rows[i]), "neighbor": ids.take(pa.array(j)), "similarity": pa.array(s.astype(np.float64))})]))
        yield from found.combine_chunks().to_batches()

    return C.map_arrow(points.select("id", "dim", "code", "x"), run, f"q bigint, neighbor {kind}, similarity double")


def _best(found: DataFrame, k: int, by: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("similarity"), "neighbor")
    return found.groupBy(by, "neighbor").agg(F.max("similarity").alias("similarity")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, asks: Column | None = None, trees: int = TREES, candidates: int = CANDIDATES, miss: float = MISS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(vec_id, neighbor_id, rank, similarity): the ``k`` nearest of every row that meets ``asks``, among all rows."""
    spark = df.sparkSession
    points = C.cut(_points(df, id_col, vec_col, asks, trees))
    kind = dict(points.dtypes)["id"]
    parts = []
    for q in _blocks(points, query_bytes):
        counts = _level_counts(points, spark.sparkContext.broadcast(q)) - trees  # without the query itself
        # the deepest level at which the trees together hold enough; the root if none does
        q.level = np.maximum((counts >= candidates).sum(axis=1) - 1, 0)
        first = C.cut(_best(_search(points, spark.sparkContext.broadcast(q), k), k, "q"))
        edge = first.groupBy("q").agg(F.min("similarity").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).toPandas()  # a row for each query of the block
        level, had = np.zeros(len(q.dim), np.int64), q.level
        level[edge["q"]], q.floor[edge["q"]] = level_for(edge["floor"].to_numpy(), trees, miss), edge["floor"].to_numpy() - 1e-6
        again = np.flatnonzero(level < had)
        names = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(q.dim))), "vec_id": q.ids}), f"q bigint, vec_id {kind}")
        found = first.select("q", "neighbor", "similarity")
        if len(again):
            deeper = Queries(q.ids.take(pa.array(again)), q.dim[again], q.code[again], {d: x[np.isin(q.of(d), again)] for d, x in q.x.items()}, level[again], q.floor[again])
            number = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(again))), "was": pa.array(again)}), "q bigint, was bigint")
            more = _search(points, spark.sparkContext.broadcast(deeper), k).join(F.broadcast(number), "q").select(F.col("was").alias("q"), "neighbor", "similarity")
            found = found.unionByName(more)
        parts.append(C.cut(found.join(F.broadcast(names), "q").select("vec_id", "neighbor", "similarity")))  # as many rows as a block has queries
    if not parts:
        return spark.createDataFrame([], f"vec_id {kind}, neighbor_id {kind}, rank int, similarity double")
    return _best(reduce(DataFrame.unionByName, parts), k, "vec_id").select("vec_id", F.col("neighbor").alias("neighbor_id"), "rank", "similarity")

"""Cost-balanced packing of documents into training sequences.

The cost of a run of ``n`` tokens is ``linear * n + quadratic * n^2``, as
attention has it. Documents longer than the capacity are cut into pieces of
the capacity and a rest. Pieces are spread by hash over groups of about
``group_tokens`` tokens, which are packed independently: in descending cost,
each piece goes to the sequence of least cost that has room for its tokens. A
group starts with as many sequences as its tokens need, and opens another when
no sequence has room.

Cases
-----
* Null, empty and tokenless texts have no tokens and are in no sequence.
* Pieces of equal cost are placed in order of (id, piece), null ids first;
  sequences of equal cost are taken in order of number.
* Repeated rows are packed each; their copies are dealt out evenly to the
  groups, so that no group outgrows ``group_tokens`` by them. An empty table
  gives an empty result.
* Ids of any sortable type come out as they went in, whatever nulls are beside
  them: they are never converted.
* Very long documents are cut, never shortened. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common as C
from quarry.llm import token_output

CAPACITY = 4096
LINEAR = 1.0
QUADRATIC = 1.0 / 4096
GROUP_TOKENS = 4_000_000


def token_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = token_output.VOCABULARY) -> DataFrame:
    """(doc_id, text_hash, n_tokens) with the public vocabulary's token counts; null texts have none."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.expr(C.hash64(f"`{text_col}`")).alias("text_hash"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [0 if t.as_py() is None else len(token_output.tokenize(t.as_py(), path)) for t in C.column(b, "text")]
            yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), C.column(b, "text_hash"), pa.array(n, pa.int64())], ["doc_id", "text_hash", "n_tokens"])

    return C.map_arrow(slim, run, f"doc_id {dict(slim.dtypes)['doc_id']}, text_hash bigint, n_tokens bigint")


def place(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Sequence of every piece; ``sizes`` are in descending order and at most the capacity."""
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return out
    n = max(1, -(-int(sizes.sum()) // capacity))
    load, room = np.zeros(2 * n + len(sizes) // 2 + 1), np.full(2 * n + len(sizes) // 2 + 1, capacity, np.int64)
    costs = linear * sizes + quadratic * sizes.astype(float) ** 2
    for k, (size, cost) in enumerate(zip(sizes, costs)):
        c = np.where(room[:n] >= size, load[:n], np.inf)
        best = int(c.argmin())
        if c[best] == np.inf:
            best, n = n, n + 1
            if n > len(load):
                load, room = np.append(load, np.zeros(n)), np.append(room, np.full(n, capacity, np.int64))
        load[best] += cost
        room[best] -= size
        out[k] = best
    return out


def _expand(t: pa.Table) -> pa.Table:
    """One row per copy, in packing order; ids stay the Arrow values they are."""
    t = t.take(pa.array(np.repeat(np.arange(t.num_rows), t["copies"].to_numpy()))).drop_columns("copies")
    keys = [("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("text_hash", "ascending")]
    return t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_start"))


def pack_lengths(lengths: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Pack (doc_id, text_hash, n_tokens) rows; see :func:`pack`."""
    total = lengths.agg(F.sum("n_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    # equal rows are counted before anything is shuffled by group, and their copies dealt out to the groups in turn
    rows = lengths.where("n_tokens > 0").groupBy("doc_id", "text_hash", "n_tokens").agg(F.count("*").alias("c"))
    count = F.ceil(F.col("n_tokens") / capacity).cast("int")
    pieces = rows.select("doc_id", "text_hash", "n_tokens", "c", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    pieces = pieces.select("doc_id", "text_hash", "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - first).alias("n_tokens"), "c", F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.lit(groups)).alias("home"))
    turn = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("c", F.lit(groups)) - 1)).alias("turn")
    pieces = pieces.select("doc_id", "text_hash", "piece", "first_token", "n_tokens", "c", "home", turn)
    share = F.floor((F.col("c") - 1 - F.col("turn")) / groups) + 1
    pieces = pieces.select("doc_id", "text_hash", "piece", "first_token", "n_tokens", share.cast("bigint").alias("copies"), F.pmod(F.col("home") + F.col("turn"), F.lit(groups)).alias("group_id"))
    kind = dict(lengths.dtypes)["doc_id"]

    def run(t: pa.Table) -> pa.Table:
        t = _expand(t)
        n = t["n_tokens"].to_numpy()
        seq = place(n, capacity, linear, quadratic)
        by = np.argsort(seq, kind="stable")
        before = np.cumsum(n[by]) - n[by]
        start = np.flatnonzero(np.diff(seq[by], prepend=-1))
        offset = np.empty(len(n), np.int64)
        offset[by] = before - np.repeat(before[start], np.diff(np.append(start, len(n))))
        cost = linear * n + quadratic * n.astype(float) ** 2
        return t.select(["doc_id", "piece", "first_token", "n_tokens", "group_id"]).append_column("sequence_id", pa.array(seq)).append_column("sequence_offset", pa.array(offset)).append_column("cost", pa.array(cost))

    return pieces.groupBy("group_id").applyInArrow(run, f"doc_id {kind}, piece int, first_token bigint, n_tokens bigint, group_id bigint, sequence_id bigint, sequence_offset bigint, cost double")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = token_output.VOCABULARY, **options) -> DataFrame:
    """(doc_id, piece, first_token, n_tokens, group_id, sequence_id, sequence_offset, cost) of every piece.

    Only ids and lengths are shuffled; a sequence is named by group and number.
    """
    return pack_lengths(C.cut(token_lengths(docs, id_col, text_col, path)), **options)

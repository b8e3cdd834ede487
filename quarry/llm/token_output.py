"""Token ids as canonical, length-limited Huffman streams.

The texts are tokenised once with a public vocabulary; their ids are counted
over the whole table; package-merge turns the counts into code lengths of at
most ``max_bits``; canonical codes follow from the lengths alone. Every row
holds one bit stream and the bit offset at which each block of ``block`` ids
begins, so blocks decode independently: the decoder looks up the next
``max_bits`` bits in one table and advances all blocks of a batch together.

Cases
-----
* A null text gives null ``bits`` and ``n_tokens`` (and null ``checkpoints``).
* An empty text gives zero tokens, empty ``bits`` and no checkpoints.
* Texts of any length are encoded whole.
* One distinct id in the table still gets a one-bit code. Ids of equal count
  get their lengths in order of id, and equal lengths their codes.
* Repeated rows are encoded each; an empty table gives an empty result and an
  empty codebook. Other columns are ignored, whatever their names.
* A row with a null id is encoded as others; rows of the codebook are told from
  it by their ``token_id``.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common as C

#: A file that every executor has at the same path, as the installed package of vocabularies gives it.
VOCABULARY = os.environ.get("QUARRY_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
MAX_BITS = 20
BLOCK = 256

_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = _PATTERN.replace(r"|\s+(?!\S)", "")
_DOUBLE_SPACE = re.compile(r"\s\s")
_ENCODERS: dict[str, tuple] = {}


def _encoders(path: str) -> tuple:
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tuple(tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("full", _PATTERN), ("plain", _PLAIN)))
    return _ENCODERS[path]


def tokenize(text: str, path: str = VOCABULARY) -> list[int]:
    """Ids of ``text``. Without two white-space characters in a row the look-ahead of the pattern can't matter; the pattern without it is faster."""
    full, plain = _encoders(path)
    return (full if _DOUBLE_SPACE.search(text) else plain).encode_ordinary(text)


def _ids(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                ids = [None if t is None else np.array(tokenize(t, path), np.uint32).astype("<u4") for t in C.column(b, "text").to_pylist()]
                packed = pa.array([None if x is None else (x.astype("<u2") if not len(x) or x.max() < 65536 else x).tobytes() for x in ids], pa.binary())
                wide = pa.array([x is not None and len(x) > 0 and bool(x.max() >= 65536) for x in ids])
                yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), packed, wide], ["doc_id", "ids", "wide"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return C.map_arrow(slim, run, f"doc_id {dict(slim.dtypes)['doc_id']}, ids binary, wide boolean")


def _arrays(b: pa.RecordBatch) -> list[np.ndarray | None]:
    return [None if x is None else np.frombuffer(x, "<u4" if w else "<u2") for x, w in zip(C.column(b, "ids").to_pylist(), C.column(b, "wide").to_pylist())]


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, n) over all rows; every task sends one row for each id it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            got = [x for x in _arrays(b) if x is not None and len(x)]
            for a in range(0, len(got), 256):
                n = np.bincount(np.concatenate(got[a : a + 256]).astype(np.int64), minlength=len(total))
                n[: len(total)] += total
                total = n
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(total[k])], ["id", "n"])

    return C.map_arrow(ids.select("ids", "wide"), run, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; ``counts`` are positive."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    w = np.asarray(counts, np.float64)[order]
    levels: list[np.ndarray] = []  # for every level: which of its sorted items are leaves
    packages = np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate((w, packages))
        by = np.argsort(both, kind="stable")
        levels.append(by < n)
        both = both[by]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(levels):  # of the items taken, leaves count; packages take twice as many below
        leaves = int(leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    order = np.lexsort((ids, lengths))
    codes, code, last = np.zeros(len(ids), np.int64), 0, 0
    for k in order:
        code <<= int(lengths[k]) - last
        codes[k], last = code, int(lengths[k])
        code += 1
    return codes


class Codebook:
    """Ids with their code lengths; the codes and the decoding table follow from these."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, max_bits: int = MAX_BITS):
        self.ids, self.lengths, self.max_bits = np.asarray(ids, np.int64), np.asarray(lengths, np.int64), max_bits
        self.codes = canonical_codes(self.ids, self.lengths)
        size = int(self.ids.max()) + 1 if len(self.ids) else 0
        self.length_of, self.code_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.length_of[self.ids], self.code_of[self.ids] = self.lengths, self.codes

    @classmethod
    def from_counts(cls, counts: DataFrame, max_bits: int = MAX_BITS) -> Codebook:
        """One driver row per id of the vocabulary, whatever the size of the corpus."""
        p = counts.orderBy("id").toPandas()
        return cls(p["id"].to_numpy(), code_lengths(p["n"].to_numpy(), max_bits), max_bits)

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_tables"}

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Id and length for every value of the next ``max_bits`` bits."""
        if not hasattr(self, "_tables"):
            self._tables = self._make_tables()
        return self._tables

    def _make_tables(self) -> tuple[np.ndarray, np.ndarray]:
        sym, length = np.zeros(1 << self.max_bits, np.int32), np.zeros(1 << self.max_bits, np.uint8)
        order = np.lexsort((self.ids, self.lengths))
        span = 1 << (self.max_bits - self.lengths[order])
        at = int(span.sum())
        sym[:at], length[:at] = np.repeat(self.ids[order], span), np.repeat(self.lengths[order], span)
        return sym, length

    def encode(self, rows: list[np.ndarray], block: int) -> list[tuple[bytes, list[int]]]:
        """Stream and block offsets of each row; every stream begins on a byte."""
        sizes = np.array([len(r) for r in rows], np.int64)
        ids = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
        n, code = self.length_of[ids], self.code_of[ids]
        first = np.concatenate(([0], np.cumsum(sizes)))
        total = np.concatenate(([0], np.cumsum(n)))
        bits = total[first[1:]] - total[first[:-1]]
        start = np.concatenate(([0], np.cumsum((bits + 7) // 8))) * 8
        at = total[:-1] + np.repeat(start[:-1] - total[first[:-1]], sizes)
        byte, word = at >> 3, code << (32 - n - (at & 7))
        out = np.zeros(int(start[-1]) // 8 + 4)
        for k in range(4):
            out += np.bincount(byte + k, (word >> (24 - 8 * k)) & 255, len(out))
        data = out.astype(np.uint8).tobytes()
        return [(data[start[i] // 8 : start[i + 1] // 8], (at[first[i] : first[i + 1] : block] - start[i]).tolist()) for i in range(len(rows))]

    def decode(self, streams: list[bytes], sizes: list[int], checkpoints: list[list[int]], block: int) -> list[np.ndarray]:
        """Ids of each stream; every block is decoded from its own checkpoint, all of them side by side."""
        sym, length = self.tables()
        data = np.frombuffer(b"".join(streams) + bytes(8), np.uint8).astype(np.int64)
        base = np.concatenate(([0], np.cumsum([len(s) for s in streams])))[:-1] * 8
        at = np.concatenate([np.asarray(c, np.int64) + b for c, b in zip(checkpoints, base)] or [np.zeros(0, np.int64)]).astype(np.int64)
        left = np.concatenate([np.minimum(block, n - block * np.arange(len(c), dtype=np.int64)) for n, c in zip(sizes, checkpoints)] or [np.zeros(0, np.int64)]).astype(np.int64)
        place = np.concatenate(([0], np.cumsum(left)))[:-1].astype(np.int64)
        out, live = np.zeros(int(left.sum()), np.int64), np.arange(len(at))
        for step in range(block):
            live = live[left[live] > step]
            if not len(live):
                break
            a = at[live]
            q = a >> 3
            window = ((data[q] << 24 | data[q + 1] << 16 | data[q + 2] << 8 | data[q + 3]) >> (32 - self.max_bits - (a & 7))) & ((1 << self.max_bits) - 1)
            out[place[live] + step] = sym[window]
            at[live] = a + length[window]
        return np.split(out, np.cumsum(sizes)[:-1]) if len(sizes) else []


def _runs(batch: pa.RecordBatch, sizes: list[int | None], tokens: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``tokens`` tokens; a longer row is a run of its own."""
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + (n or 0) > tokens:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n or 0
    yield batch.slice(at)


def encode_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, max_bits: int = MAX_BITS, block: int = BLOCK) -> tuple[DataFrame, Codebook]:
    """(doc_id, n_tokens, n_bits, bits, checkpoints, verified) per row, and the codebook.

    Every stream is decoded again where it is made, block by block through the
    table; ``verified`` says whether that gave the ids.
    """
    if not 1 <= max_bits <= 24:
        raise ValueError("max_bits is from 1 to 24")
    ids = C.cut(_ids(docs, id_col, text_col, path))
    book = Codebook.from_counts(id_counts(ids), max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = pc.if_else(C.column(batch, "wide"), 4, 2)
            for b in _runs(batch, pc.divide(pc.binary_length(C.column(batch, "ids")), wide).to_pylist()):
                rows = _arrays(b)
                live = [x for x in rows if x is not None]
                streams = book.encode(live, block)
                back = book.decode([s for s, _ in streams], [len(x) for x in live], [c for _, c in streams], block)
                done = iter([(*s, np.array_equal(x, y)) for s, x, y in zip(streams, live, back)])
                out = [(None, None, None) if x is None else next(done) for x in rows]
                last = [None if x is None else int(book.length_of[x].sum()) for x in rows]
                yield pa.RecordBatch.from_arrays(
                    [C.column(b, "doc_id"), pa.array([None if x is None else len(x) for x in rows], pa.int64()), pa.array(last, pa.int64()), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.bool_())],
                    ["doc_id", "n_tokens", "n_bits", "bits", "checkpoints", "verified"],
                )

    return C.map_arrow(ids, run, f"doc_id {dict(ids.dtypes)['doc_id']}, n_tokens bigint, n_bits bigint, bits binary, checkpoints array<bigint>, verified boolean"), book


def with_codebook(encoded: DataFrame, book: Codebook) -> DataFrame:
    """``encoded`` with a row (token_id, code_length) for each id of the codebook: all that decoding needs, in one table."""
    rows = encoded.sparkSession.createDataFrame(list(zip(book.ids.tolist(), book.lengths.tolist())), "token_id int, code_length int")
    return encoded.unionByName(rows, allowMissingColumns=True)


def decode_stored(table: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids) of the rows of a table that :func:`with_codebook` gave, from that table alone."""
    book = table.where("token_id IS NOT NULL").select("token_id", "code_length").orderBy("token_id").toPandas()  # a row per id of the vocabulary
    return decode_tokens(table.where("token_id IS NULL"), Codebook(book["token_id"].to_numpy(), book["code_length"].to_numpy(), max_bits), block)


def decode_tokens(encoded: DataFrame, book: Codebook, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids) of the rows that :func:`encode_tokens` gave; null streams give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _runs(batch, C.column(batch, "n_tokens").to_pylist()):
                s, n, c = (C.column(b, k).to_pylist() for k in ("bits", "n_tokens", "checkpoints"))
                live = [i for i, x in enumerate(s) if x is not None]
                got = dict(zip(live, book.decode([s[i] for i in live], [n[i] for i in live], [c[i] for i in live], block)))
                yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), pa.array([got.get(i) for i in range(len(s))], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return C.map_arrow(encoded, run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<bigint>")

"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised to lower-case words with one blank between
them. An item of ``n`` bytes has an error budget of ``k = error_rate * n``
edits and is split into ``k + 1`` pieces; if it occurs in a text with at most
``k`` edits, one of the pieces occurs there unchanged. Piece hits are found for
all items in one pass over the bytes: a bit table over the hash of every window
of 8 bytes (of as many as a shorter piece has), then the piece itself. The
region around a hit is verified with Myers' bit-parallel distance, the item
against any substring of the region.

Cases
-----
* A null or empty text contains nothing. A null item, or one without a word, is
  never searched. Items of any other length are; ``min_bytes`` leaves shorter
  ones out, by default none.
* An item too short to have an error budget has to stand in the text as whole
  words, or it would be found within words of clean texts.
* Very long texts and items are searched whole.
* Items of equal text are reported each. Repeated rows are reported each in
  :func:`find_contamination`, and all removed by :func:`decontaminate`.
* Rows with a null id are searched as others; an item with a null id is
  reported under it.
* An empty test set removes nothing; an empty table gives an empty result.
* Edits are counted in UTF-8 bytes of the normalised texts.
* Other columns are ignored by :func:`find_contamination` and carried untouched
  by :func:`decontaminate`, whatever their names.

The test set is read to the driver a pass at a time: what is broadcast holds at
most ``ITEM_BYTES_PER_PASS`` of items (or one longer item) and about twice that
for its pieces. A larger test set takes more passes over the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.llm import common as C

ERROR_RATE = 0.08
WINDOW = 8
ITEM_BYTES_PER_PASS = 16 << 20
_TABLE_BITS = 22
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normalize(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of lower-cased texts, each after one blank; every text also ends with one."""
    if not len(buf):
        return np.full(len(offs) - 1, 32, np.uint8), np.arange(len(offs), dtype=np.int64)
    word = C._WORD[buf]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    start = word & (~before | edge[:-1])
    size = word.astype(np.int64) + start
    at = np.concatenate(([0], np.cumsum(size)))
    extra = np.arange(len(offs), dtype=np.int64)
    row = np.searchsorted(offs, np.flatnonzero(word), "right") - 1
    out = np.full(int(at[-1]) + len(offs) - 1, 32, np.uint8)
    out[at[1:][word] - 1 + row] = buf[word]
    return out, at[offs] + extra


def normalize_text(text: str | None) -> bytes:
    raw = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    return normalize(raw, np.array([0, len(raw)]))[0].tobytes().strip()


def pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """``k + 1`` consecutive pieces, as equal as possible, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def budget(n: int, error_rate: float) -> int:
    """Edits that an item of ``n`` bytes may have; a piece keeps one byte at least."""
    return max(0, min(int(error_rate * n), n - 1))


def myers(item: bytes, text: bytes) -> int:
    """Least edit distance of ``item`` to any substring of ``text``."""
    m, peq = len(item), defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq[c]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return best


def _windows(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number; zeros follow the end."""
    buf = np.concatenate((buf, np.zeros(2 * WINDOW, np.uint8)))
    out = np.empty(len(buf) - 2 * WINDOW, np.uint64)
    for k in range(min(WINDOW, len(out))):
        part = buf[k:]
        out[k::WINDOW] = part[: len(part) // WINDOW * WINDOW].view("<u8")[: len(out[k::WINDOW])]
    return out


class _Pieces:
    """Pieces whose first ``width`` bytes are looked up, sorted by these."""

    def __init__(self, width: int, rows: list[tuple[int, int, int, int]]):
        key, item, off, size = (np.array(c, np.uint64 if i == 0 else np.int64) for i, c in enumerate(zip(*rows)))
        order = np.argsort(key, kind="stable")
        self.mask, self.item, self.off, self.size = np.uint64((1 << 8 * width) - 1), item[order].astype(np.int32), off[order].astype(np.int32), size[order].astype(np.int32)
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[(self.keys * _MULT) >> np.uint64(64 - _TABLE_BITS)] = True

    def hits(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a piece may begin, and the place of its window among ``keys``."""
        w = windows if self.mask == np.uint64(2**64 - 1) else windows & self.mask
        hit = np.flatnonzero(self.table[(w * _MULT) >> np.uint64(64 - _TABLE_BITS)])
        slot = np.minimum(np.searchsorted(self.keys, w[hit]), len(self.keys) - 1)
        ok = self.keys[slot] == w[hit]
        return hit[ok], slot[ok]


class Matcher:
    """The pieces of a set of items, ready to search."""

    def __init__(self, items: list[tuple[object, bytes]], error_rate: float):
        self.ids, texts = [i for i, _ in items], [t for _, t in items]
        self.budgets = [budget(len(t), error_rate) for t in texts]
        self.texts = [t if k else b" " + t + b" " for t, k in zip(texts, self.budgets)]
        by_width: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for i, (t, k) in enumerate(zip(self.texts, self.budgets)):
            for at, piece in pieces(t, k):
                width = min(WINDOW, len(piece))
                by_width[width].append((int.from_bytes(piece[:width], "little"), i, at, len(piece)))
        self.parts = [_Pieces(w, rows) for w, rows in sorted(by_width.items(), reverse=True)]

    def search(self, arr: pa.Array) -> list[dict[int, int]]:
        """For every text the items it contains, with the least distance."""
        found: list[dict[int, int]] = [{} for _ in range(len(arr))]
        if not self.parts:
            return found
        for first, raw, raw_offs in C.text_chunks(pc.utf8_lower(arr.cast(pa.large_string()))):
            buf, offs = normalize(raw, raw_offs)
            windows, data = _windows(buf), None
            seen: dict[tuple[int, int], int] = {}
            for part in self.parts:
                hit, slot = part.hits(windows)
                if not len(hit):
                    continue
                data = buf.tobytes() if data is None else data
                ends = np.append(part.first, len(part.item))
                for at, row, lo, hi in zip(hit.tolist(), (np.searchsorted(offs, hit, "right") - 1).tolist(), ends[slot].tolist(), ends[slot + 1].tolist()):
                    for p in range(lo, hi):
                        i, off, size = int(part.item[p]), int(part.off[p]), int(part.size[p])
                        best, begin = found[first + row].get(i), at - off
                        if best == 0 or seen.get((row, i)) == begin:
                            continue
                        if data[at : at + size] == self.texts[i][off : off + size]:
                            seen[row, i] = begin
                            self._verify(data, begin, i, int(offs[row]), int(offs[row + 1]), found[first + row])
        return found

    def _verify(self, data: bytes, begin: int, i: int, start: int, stop: int, found: dict[int, int]) -> None:
        """Note item ``i`` if the text from ``start`` to ``stop`` holds it about ``begin`` within its budget."""
        item, k = self.texts[i], self.budgets[i]
        d = 0 if begin >= start and data[begin : begin + len(item)] == item else myers(item, data[max(start, begin - k) : min(stop, begin + len(item) + k)]) if k else 1
        if d <= min(k, found.get(i, k)):
            found[i] = d


def _passes(benchmark: DataFrame, id_col: str, text_col: str, error_rate: float, min_bytes: int) -> Iterator[Matcher]:
    """Matchers for the items, ``ITEM_BYTES_PER_PASS`` each, so that what the driver and a task hold is bounded."""
    held, size = [], 0
    for item_id, text in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col), F.col(text_col)).toLocalIterator():
        t = normalize_text(text)
        if len(t) < max(min_bytes, 1):
            continue
        if held and size + len(t) > ITEM_BYTES_PER_PASS:
            yield Matcher(held, error_rate)
            held, size = [], 0
        held.append((item_id, t))
        size += len(t)
    if held:
        yield Matcher(held, error_rate)


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, min_bytes: int = 0) -> DataFrame:
    """(doc_id, item_id, distance) for every item that a row contains within its budget."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(slim.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)[item_col]}, distance int"
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for m in _passes(benchmark, item_col, item_text, error_rate, min_bytes):
        held = docs.sparkSession.sparkContext.broadcast(m)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = held.value
            for b in batches:
                got = [(r, matcher.ids[i], d) for r, f in enumerate(matcher.search(C.column(b, "text"))) for i, d in sorted(f.items())]
                rows, ids, dist = zip(*got) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([C.column(b, "doc_id").take(pa.array(rows, pa.int64())), pa.array(ids, kind), pa.array(dist, pa.int32())], ["doc_id", "item_id", "distance"])

        part = C.map_arrow(slim, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, min_bytes: int = 0) -> DataFrame:
    """``docs`` without the rows that contain a test item; nothing is shuffled."""
    for m in _passes(benchmark, item_col, item_text, error_rate, min_bytes):
        held = docs.sparkSession.sparkContext.broadcast(m)
        place = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], held=held, place=place) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not f for f in held.value.search(b.column(place))], pa.bool_()))

        docs = C.map_arrow(docs, run, docs.schema)
    return docs

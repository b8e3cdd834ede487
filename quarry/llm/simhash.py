"""SimHash near-duplicate detection over a segment-popcount embedding.

Each text becomes a 256-bit SimHash of its lower-cased words, weighted by one
plus the log of their count. A fingerprint is embedded as the bit counts of its
128 two-bit segments. The Manhattan distance of two such vectors never exceeds
the Hamming distance of the fingerprints, so near fingerprints lie near each
other in this space, and it rules pairs out before the exact Hamming test.

An exact range join on a grid of these counts would compare most pairs of the
table: with a limit of 40 in 256 bits, some of g groups of segments lies within
40 / g, which in any group of 32 bits one random pair in 500 does, and in one of
8 bits nearly every second. The join is therefore approximate: every table is a
grid of width one over a random set of segments, and fingerprints of one cell,
in any table, are compared. :func:`grid` chooses the dimensions of the grid
from the number of fingerprints, so that cells stay small, and as many tables as
give a pair at the limit of ``MAX_HAMMING`` bits a chance above 0.9, and nearer
pairs more (0.99 at 32 bits, 1.0 at 28).

Within a cell only a spanning forest of the confirmed pairs is emitted, so
thousands of copies give thousands of edges, not millions. A cell of more than
about ``HOT`` fingerprints is cut in blocks, each pair of which is compared in a
task of its own. Groups are the connected components. Fingerprints stand for
themselves throughout, so none is taken for another by its hash.

Cases
-----
* Null, empty and blank texts have no fingerprint and are never duplicates.
* A text without any word byte is fingerprinted as one feature.
* Texts of any length are fingerprinted whole.
* Ties: the row with the smallest ``(doc_id, hash of the text)`` is kept, null
  ids first.
* Repeated rows (same id and text) collapse to one.
* Rows that share an id but not a text are separate documents.
* An empty table gives an empty result; other columns are carried untouched,
  whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common as C

BITS = 256
MAX_HAMMING = 40
SEGMENT_BITS = 2
SEGMENTS_PER_TABLE = 11
TABLES = 100
GRID_ROWS = 1 << 24
HOT = 1 << 14
HOT_CELLS = 100_000
_SAMPLE = 16
_SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def fingerprints(arr: pa.Array) -> list[bytes | None]:
    """SimHash of each text; None for null, empty and blank ones."""
    arr = pc.utf8_lower(arr.cast(pa.large_string()))
    out: list[bytes | None] = []
    for _, buf, offs in C.text_chunks(arr):
        rows = len(offs) - 1
        starts, ends, doc = C.word_spans(buf, offs)
        h = C.span_hashes(buf, starts, ends) >> np.uint64(16)
        for a in range(0, rows, 1 << 15):
            out += _fingerprints(buf, offs, h, doc, a, min(rows, a + (1 << 15)))
    return out


def _fingerprints(buf, offs, h, doc, first, last) -> list[bytes | None]:
    lo, hi = np.searchsorted(doc, [first, last])
    key = np.sort(((doc[lo:hi] - first).astype(np.uint64) << np.uint64(48)) | h[lo:hi])
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    weight = np.rint(16 * (1 + np.log(count))).astype(np.float32)
    key = key[new]
    feature = key & np.uint64((1 << 48) - 1)
    bounds = np.searchsorted(key >> np.uint64(48), np.arange(last - first + 1, dtype=np.uint64))
    out: list[bytes | None] = []
    for i in range(last - first):
        f, w = feature[bounds[i] : bounds[i + 1]], weight[bounds[i] : bounds[i + 1]]
        if not len(f):
            raw = buf[offs[first + i] : offs[first + i + 1]]
            if not bytes(raw).strip():
                out.append(None)
                continue
            f, w = C.span_hashes(raw, np.array([0]), np.array([len(raw)])), np.ones(1, np.float32)
        total = np.zeros(BITS, np.float32)
        for a in range(0, len(f), 4096):
            words = C.mix(f[a : a + 4096, None] ^ _SEEDS[None, :])
            total += w[a : a + 4096] @ np.unpackbits(words.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32)
        out.append(np.packbits(total > w.sum() / 2).tobytes())
    return out


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) per row with a fingerprint."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.expr(C.hash64(f"`{text_col}`")).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array(fingerprints(C.column(b, "text")), pa.binary())
            yield pa.RecordBatch.from_arrays([C.column(b, "doc_id"), C.column(b, "text_hash"), fp], ["doc_id", "text_hash", "fp"]).filter(pc.is_valid(fp))

    kind = dict(slim.dtypes)["doc_id"]
    return C.map_arrow(slim, run, f"doc_id {kind}, text_hash bigint, fp binary")


def table_segments(tables: int, per_table: int, seed: int = 20250101) -> np.ndarray:
    """(tables, per_table) segment numbers; tables cut from one permutation share no segment."""
    rng, n, rows = np.random.default_rng(seed), BITS // SEGMENT_BITS, []
    while len(rows) < tables:
        p = rng.permutation(n)
        rows += [p[i : i + per_table] for i in range(0, n - per_table + 1, per_table)]
    return np.array(rows[:tables])


def embed(fps: np.ndarray) -> np.ndarray:
    """Per-segment bit counts, (n, 128) from (n, 32) bytes."""
    return np.unpackbits(fps, axis=1).reshape(len(fps), -1, SEGMENT_BITS).sum(axis=2, dtype=np.uint8)


def grid(n: int, tables: int = TABLES, per_table: int = SEGMENTS_PER_TABLE) -> tuple[int, int]:
    """Tables and dimensions for ``n`` fingerprints.

    Two random ones agree in a segment with a chance of 3/8, a pair at the limit
    with one of 0.724: beyond ``GRID_ROWS``, every further dimension makes cells
    of 8/3 as many rows as small, and takes 1.38 times the tables for the same recall.
    """
    more = max(0, int(np.ceil(np.log(max(n, 1) / GRID_ROWS) / np.log(8 / 3))))
    return int(np.ceil(tables * 0.724**-more)), min(per_table + more, BITS // SEGMENT_BITS)


def _cells(nodes: DataFrame, tables: int, per_table: int, hot: int = HOT) -> DataFrame:
    """(cell, fp): a row for each table, and one for each pair of blocks where the cell is hot."""
    picks = table_segments(tables, per_table)
    radix = np.uint64(SEGMENT_BITS + 1) ** np.arange(per_table, dtype=np.uint64)
    spread = C.mix(np.arange(1, tables + 1, dtype=np.uint64))

    def numbers(fps: np.ndarray) -> np.ndarray:
        v = embed(fps)
        return np.concatenate([(C.mix(v[:, p].astype(np.uint64) @ radix ^ spread[t]) >> np.uint64(2)).astype(np.int64) for t, p in enumerate(picks)])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array(numbers(_matrix(C.column(batch.slice(a, 500), "fp"))))], ["cell"])

    blocks: dict[int, int] = {}
    if nodes.limit(hot + 1).count() > hot:
        # which cells are hot decides about the work's distribution only, so a sample of the rows is enough
        some = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(_SAMPLE)) == 0).select("fp")
        n = C.map_arrow(some, counted, "cell bigint").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > max(1, hot // _SAMPLE))
        blocks = {c: -(-k * _SAMPLE // hot) for c, k in n.orderBy(F.desc("n"), "cell").limit(HOT_CELLS).collect()}
    known, parts = np.array(sorted(blocks), np.int64), np.array([blocks[c] for c in sorted(blocks)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                b = batch.slice(a, 500)
                fps = _matrix(C.column(b, "fp"))
                ids, take = numbers(fps), np.tile(np.arange(len(fps)), len(picks))
                if len(known):
                    ids, take = split_hot(ids, take, C.mix(fps.view(np.uint64)[:, 0] ^ fps.view(np.uint64)[:, 1]), known, parts)
                for c in range(0, len(ids), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[c : c + (1 << 16)]), C.column(b, "fp").take(pa.array(take[c : c + (1 << 16)]))], ["cell", "fp"])

    return C.map_arrow(nodes.select("fp"), run, "cell bigint, fp binary")


def split_hot(ids: np.ndarray, take: np.ndarray, own: np.ndarray, known: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put every row of a hot cell in the cells of all pairs of blocks that its block is in; any two rows share one of them."""
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    hot = np.flatnonzero(known[at] == ids)
    if not len(hot):
        return ids, take
    n = parts[at[hot]]
    cell, row, other = np.repeat(ids[hot], n), np.repeat(take[hot], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    mine = (own[row] % np.repeat(n, n).astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(mine, other).astype(np.uint64) << np.uint64(32)) | np.maximum(mine, other).astype(np.uint64)
    made = -1 - (C.mix(C.mix(pair + np.uint64(1)) ^ cell.astype(np.uint64)) >> np.uint64(2)).astype(np.int64)
    cold = np.delete(np.arange(len(ids)), hot)
    return np.concatenate((ids[cold], made)), np.concatenate((take[cold], row))


def _matrix(arr: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(arr.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _near(x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray, limit: int) -> np.ndarray:
    """Which pairs of rows are within ``limit`` bits; the bit counts' Manhattan distance rules pairs out first."""
    bound = np.abs(cx - cy).sum(axis=-1) <= limit
    near = np.zeros(bound.shape, bool)
    k = np.flatnonzero(bound)
    if len(k):
        x = x if x.ndim == 1 else x[k]
        near[k] = np.bitwise_count(x ^ y[k]).sum(axis=-1, dtype=np.int16) <= limit
    return near


def forest(cell: np.ndarray, fp: np.ndarray, limit: int, small: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the near rows of each run of equal cells (rows sorted by cell).

    Short runs compare every pair. Long ones grow one component at a time:
    each new member is compared with the rows not yet reached, so every row is
    compared with all others unless both are already known to belong together.
    """
    n = len(cell)
    words = np.ascontiguousarray(fp).view(np.uint64)
    counts = np.bitwise_count(words).astype(np.int16)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    us, vs = [], []
    left = np.repeat(first + size, size) - np.arange(n)  # rows from here to the end of the run
    left[np.repeat(size > small, size)] = 0
    live, d = np.flatnonzero(left > 1), 1
    while len(live):
        k = live[_near(words[live], words[live + d], counts[live], counts[live + d], limit)]
        us.append(k)
        vs.append(k + d)
        d += 1
        live = live[left[live] > d]
    for a, m in zip(first[size > small], size[size > small]):
        rest = np.arange(a, a + m)
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                hit = _near(words[i], words[rest], counts[i], counts[rest], limit)
                if hit.any():
                    got = rest[hit]
                    us.append(np.full(len(got), i))
                    vs.append(got)
                    queue += list(got)
                    rest = rest[~hit]
    if not us:
        z = np.zeros(0, np.int64)
        return z, z
    return np.concatenate(us), np.concatenate(vs)


def _edges(cells: DataFrame, limit: int) -> DataFrame:
    """(u, v), near fingerprints, the smaller first."""
    ordered = cells.repartition("cell").sortWithinPartitions("cell")

    def emit(cell, fp):
        u, v = forest(cell, fp, limit)
        return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(BITS // 8), len(k), [None, pa.py_buffer(fp[k].tobytes())]).cast(pa.binary()) for k in (u, v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            cell, fp = C.column(b, "cell").to_numpy(), _matrix(C.column(b, "fp"))
            end = int(np.searchsorted(cell, cell[-1]))  # the last run may go on in the next batch
            if end:
                held.append((cell[:end], fp[:end]))
                yield emit(*map(np.concatenate, zip(*held)))
                held = []
            held.append((cell[end:], fp[end:]))
        if held:
            yield emit(*map(np.concatenate, zip(*held)))

    pairs = C.map_arrow(ordered, run, "u binary, v binary")
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternates large-star and small-star steps, which need a number of rounds
    logarithmic in the longest path; each round is cut through the checkpoint
    folder, and the loop ends when a round changes nothing.
    """
    e = C.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = C.cut(small)
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_HAMMING, tables: int = TABLES, per_table: int = SEGMENTS_PER_TABLE, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, keep_id, keep_hash) for every fingerprinted row of a group, keepers included."""
    sig = C.cut(signatures(docs, id_col, text_col))
    nodes = C.cut(sig.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count("*").alias("n")))
    groups = components(_edges(_cells(nodes, *grid(nodes.count(), tables, per_table), hot), limit))
    placed = nodes.join(C.broadcast_if_small(groups), nodes["fp"] == groups["node"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    keep = placed.groupBy("root").agg(F.min("rep").alias("keep"), F.sum("n").alias("rows")).where("rows > 1")
    member = C.cut(placed.join(keep, "root").select("fp", "keep"))
    return sig.join(C.broadcast_if_small(member), "fp").select("doc_id", "text_hash", F.col("keep.doc_id").alias("keep_id"), F.col("keep.text_hash").alias("keep_hash"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row ``(doc_id, duplicate_of)`` per row that goes; repeats of one row beyond the first are listed too."""
    d = duplicates(docs, id_col, text_col, **options)
    per = d.groupBy("doc_id", "text_hash", "keep_id", "keep_hash").agg(F.count("*").alias("n"))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("text_hash").eqNullSafe(F.col("keep_hash"))
    return per.withColumn("n", F.when(same, F.col("n") - 1).otherwise(F.col("n"))).where("n > 0").select("doc_id", F.col("keep_id").alias("duplicate_of"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_k")).drop("_k")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group; rows without a fingerprint stay."""
    d = duplicates(docs, id_col, text_col, **options)
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("text_hash").eqNullSafe(F.col("keep_hash"))
    per = C.cut(d.groupBy("doc_id", "text_hash").agg(F.first(same).alias("kept"), F.count("*").alias("n")))
    lost = per.where("NOT kept").select("doc_id", "text_hash")
    twice = per.where("kept AND n > 1").select("doc_id", "text_hash")
    h, columns = C.fresh(docs, "hash"), docs.columns
    row = docs.withColumn(h, F.expr(C.hash64(f"`{text_col}`")))
    on = lambda k: row[id_col].eqNullSafe(k["doc_id"]) & (row[h] == k["text_hash"])
    lost = C.broadcast_if_small(lost)
    row = row.join(lost, on(lost), "left_anti")
    if twice.isEmpty():
        return row.select(*[f"`{c}`" for c in columns])
    twice = C.broadcast_if_small(twice)
    once = row.join(twice, on(twice), "left_anti")
    again = row.join(twice, on(twice), "left_semi").dropDuplicates([id_col, h])
    return once.unionByName(again).select(*[f"`{c}`" for c in columns])

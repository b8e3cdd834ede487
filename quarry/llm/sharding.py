"""Consistent hashing with virtual nodes and bounded loads.

Every shard owns ``virtual`` points of a ring of 2^52 positions; a key belongs
to the first point clockwise of its own position. No shard takes more than
``ceil((1 + slack) * keys / shards)`` keys. A shard fills from its own arcs in
ring order; the keys of an arc beyond its room, those furthest along, continue
clockwise to the next points whose shards have room. Only the arcs' key counts
(``shards * virtual`` numbers) reach the driver, which plans the overflow as
rank ranges; ranks are computed for overflowing arcs alone.

Cases
-----
* A null key is a key of its own. Repeated keys share a position; each row
  counts and is placed by itself, and equal rows are interchangeable.
* Ties in position are ordered by key. An empty table gives an empty result.
* Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 64
VIRTUAL = 128
SLACK = 0.05
SPACE = 1 << 52


def position(key: Column) -> Column:
    """The key's place on the ring: the first 52 bits of the MD5 of its text, and of whether it is null."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.when(key.isNull(), "|1").otherwise("|0"))), 1, 13), 16, 10).cast("bigint")


def ring(shards: int, virtual: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions of the virtual nodes and the shard of each."""
    points = sorted({int(hashlib.md5(f"{s}#{v}".encode()).hexdigest()[:13], 16): s for s in range(shards) for v in range(virtual)}.items())
    return np.array([p for p, _ in points], np.int64), np.array([s for _, s in points], np.int64)


def plan(counts: dict[int, int], owner: np.ndarray, shards: int, slack: float) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, end rank, shard) for every arc with keys; ranks start at 0."""
    n = sum(counts.values())
    room = [math.ceil((1 + slack) * n / shards)] * shards
    out, over = [], []
    for arc in sorted(counts):
        take = min(counts[arc], room[owner[arc]])
        room[owner[arc]] -= take
        if take:
            out.append((arc, 0, take, int(owner[arc])))
        if take < counts[arc]:
            over.append((arc, take))
    for arc, at in over:
        k = arc
        while at < counts[arc]:
            k = (k + 1) % len(owner)
            take = min(counts[arc] - at, room[owner[k]])
            if take:
                room[owner[k]] -= take
                out.append((arc, at, at + take, int(owner[k])))
                at += take
    return out


def assign(docs: DataFrame, key_col: str = "doc_id", shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = SLACK) -> DataFrame:
    """(doc_id, primary_shard, shard) of every row."""
    spark = docs.sparkSession
    points, owner = ring(shards, virtual)
    key = F.col(key_col)
    placed = docs.select(key.alias("doc_id"), position(key).cast("double").alias("pos"))
    arcs = Bucketizer(splits=[-math.inf, *(points + 1).astype(float), math.inf], inputCol="pos", outputCol="bucket").transform(placed)
    arcs = arcs.select("doc_id", "pos", F.pmod(F.col("bucket").cast("int"), F.lit(len(points))).alias("arc"))
    counts = {r["arc"]: r["n"] for r in arcs.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    rows = [(a, lo, hi, int(owner[a]), s) for a, lo, hi, s in plan(counts, owner, shards, slack)]
    ranges = spark.createDataFrame(rows, "arc int, lo bigint, hi bigint, primary_shard int, shard int")
    split = F.col("parts") > 1
    parts = ranges.groupBy("arc").agg(F.count("*").alias("parts"), F.max("hi").alias("end"))
    ranges = ranges.join(F.broadcast(parts), "arc")  # both have at most two rows a virtual node
    whole = arcs.join(F.broadcast(ranges.where(~split).drop("lo", "hi", "end", "parts")), "arc").select("doc_id", "primary_shard", "shard")
    ranked = arcs.join(F.broadcast(parts.where(split).select("arc")), "arc").withColumn("rank", F.row_number().over(Window.partitionBy("arc").orderBy("pos", "doc_id")) - 1)
    cut = ranked.join(F.broadcast(ranges.where(split).drop("end", "parts")), "arc").where("rank >= lo AND rank < hi").select("doc_id", "primary_shard", "shard")
    return whole.unionByName(cut)


_PLACE = "CAST('0x' || substring(md5({0}), 1, 13) AS BIGINT)"
#: The same in DuckDB: shards fill from their own arcs, then a walk over the ring places what is over, a point a step.
ORACLE = f"""
WITH RECURSIVE node AS (SELECT s, {_PLACE.format("CAST(s AS VARCHAR) || '#' || CAST(v AS VARCHAR)")} AS p FROM range(0, {SHARDS}) a(s), range(0, {VIRTUAL}) b(v)),
point AS (SELECT p, max(s) AS owner, row_number() OVER (ORDER BY p) - 1 AS arc FROM node GROUP BY p),
placed AS (SELECT doc_id, {_PLACE.format("coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN doc_id IS NULL THEN '|1' ELSE '|0' END")} AS pos FROM documents),
keyed AS (SELECT k.doc_id, k.pos, coalesce(t.arc, 0) AS arc, row_number() OVER (PARTITION BY coalesce(t.arc, 0) ORDER BY k.pos, k.doc_id NULLS FIRST) - 1 AS rank FROM placed k ASOF LEFT JOIN point t ON k.pos <= t.p),
room AS (SELECT CAST(ceil((1 + {SLACK}) * count(*) / {SHARDS}) AS BIGINT) AS cap FROM keyed),
arcs AS (SELECT arc, count(*) AS n FROM keyed GROUP BY arc),
own AS (SELECT a.arc, a.n, t.owner, coalesce(sum(a.n) OVER (PARTITION BY t.owner ORDER BY a.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM arcs a JOIN point t ON a.arc = t.arc),
filled AS (SELECT arc, n, owner, CAST(greatest(0, least(n, cap - before)) AS BIGINT) AS take FROM own, room),
spill AS (SELECT arc, n, take, row_number() OVER (ORDER BY arc) AS i FROM filled WHERE take < n),
init AS (SELECT list(CAST(cap - coalesce(used, 0) AS BIGINT) ORDER BY s) AS left_ FROM range(0, {SHARDS}) a(s) LEFT JOIN (SELECT owner, sum(take) AS used FROM filled GROUP BY owner) f ON f.owner = s, room),
walk AS (
  SELECT o.i, o.arc, o.n, o.arc AS k, o.take AS lo, o.take AS hi, -1 AS shard, left_ FROM spill o, init WHERE o.i = 1
  UNION ALL
  SELECT i, arc, n, k, lo, hi, shard, list_transform(left_, lambda x, j: CASE WHEN j = shard + 1 THEN x - (hi - lo) ELSE x END)
  FROM (
    SELECT o.i, o.arc, o.n, t.arc AS k, CASE WHEN w.hi = w.n THEN o.take ELSE w.hi END AS lo, CASE WHEN w.hi = w.n THEN o.take ELSE w.hi END + least(o.n - CASE WHEN w.hi = w.n THEN o.take ELSE w.hi END, w.left_[t.owner + 1]) AS hi, t.owner AS shard, w.left_
    FROM walk w JOIN spill o ON o.i = CASE WHEN w.hi = w.n THEN w.i + 1 ELSE w.i END
    JOIN point t ON t.arc = (CASE WHEN w.hi = w.n THEN o.arc ELSE w.k END + 1) % (SELECT count(*) FROM point))),
moved AS (SELECT arc, lo, hi, shard FROM walk WHERE hi > lo)
SELECT k.doc_id, CAST(f.owner AS INT) AS primary_shard, CAST(CASE WHEN k.rank < f.take THEN f.owner ELSE m.shard END AS INT) AS shard
FROM keyed k JOIN filled f ON k.arc = f.arc LEFT JOIN moved m ON k.arc = m.arc AND k.rank >= m.lo AND k.rank < m.hi
"""

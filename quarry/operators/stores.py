"""Filters, rank orders, paging and upserts of document, symbol and posting tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def filters(repository: str = "", branch: str = "", path_prefix: str = "", language: str = "", document: str = "", kinds: Sequence[int] = (), tiers: Sequence[str] = (), metadata: Mapping[str, str] | None = None) -> Column:
    """One conjunction; an empty value means no restriction."""
    out = F.lit(True)
    for column, value in (("repository_id", repository), ("branch", branch), ("language", language), ("doc_id", document)):
        if value:
            out = out & (F.col(column) == value)
    if path_prefix:
        out = out & F.col("path").startswith(path_prefix)
    if kinds:
        out = out & F.col("kind").isin(list(kinds))
    if tiers:
        out = out & F.col("tier").isin(list(tiers))
    for k, v in (metadata or {}).items():
        out = out & (F.col("metadata")[k] == v)
    return out


def document_rank(query: str, path: Column, content: Column) -> Column:
    """0 for the path itself, 1 for a part of the path, 2 for the content, else 3."""
    q = query.lower()
    return F.when(F.lower(path) == q, 0).when(F.lower(path).contains(q), 1).when(F.lower(content).contains(q), 2).otherwise(3)


def shard_document_score(query: str, path: Column, content: Column) -> Column:
    """4 for the path and 2 for the content, added up."""
    q = query.lower()
    return F.lower(path).contains(q).cast("int") * 4 + F.lower(content).contains(q).cast("int") * 2


def symbol_rank(query: str, name: Column, container: Column, signature: Column) -> Column:
    """0 equal, 1 prefix, 2 within the name, 3 within the container, 4 within the signature, else 5."""
    q = query.lower()
    n = F.lower(name)
    return F.when(n == q, 0).when(n.startswith(q), 1).when(n.contains(q), 2).when(F.lower(container).contains(q), 3).when(F.lower(signature).contains(q), 4).otherwise(5)


def shard_symbol_score(query: str, name: Column, container: Column) -> Column:
    """4 equal, 3 prefix, 2 within the name or its container, else 0: the ranking over several shards."""
    q = query.lower()
    n = F.lower(name)
    return F.when(n == q, 4).when(n.startswith(q), 3).when(n.contains(q) | F.lower(container).contains(q), 2).otherwise(0)


def glob_to_regex(pattern: str) -> str | None:
    """The expression of a path glob, in which ``*`` and ``?`` stay within a directory; None for a malformed one."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out += "\\" + pattern[i] if not pattern[i].isalnum() else pattern[i]
        elif c == "[":
            end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] == "^" else i + 1)
            if end <= i + 1:
                return None
            out += pattern[i : end + 1]
            i = end
        else:
            out += "\\" + c if c in ".+()|{}^$" else c
        i += 1
    return f"^{out}$"


def page(df: DataFrame, order: Sequence[str | Column], cursor: str = "", size: int = 100) -> DataFrame:
    """``size`` rows after the cursor, a decimal offset."""
    at = int(cursor) if cursor else 0
    if at < 0 or size <= 0:
        raise ValueError("a cursor isn't negative, and a page holds something")
    return df.orderBy(*order).offset(at).limit(size)


def page_after(df: DataFrame, key: Sequence[str], after: Sequence, size: int) -> DataFrame:
    """The same by key: rows beyond the last key seen, which needs no pass over the earlier pages."""
    return df.where(F.struct(*key) > F.struct(*[F.lit(v).alias(k) for k, v in zip(key, after)])).orderBy(*key).limit(size)


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of every key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def union_by_id(parts: Sequence[DataFrame], key: str, *order: Column) -> DataFrame:
    """The rows of several shards, one for each id: the first in ``order``, any where that leaves a choice."""
    both = reduce(DataFrame.unionByName, parts)
    return latest(both, [key], list(order)) if order else both.dropDuplicates([key])


def upsert(current: DataFrame, changes: DataFrame, key: str = "doc_id", created: str | None = None) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those of the same key; the first creation time stays."""
    if created:
        changes = keep_created(current, changes, key, created)
    return delete(current, changes.select(key), key).unionByName(changes)


def keep_created(current: DataFrame, changes: DataFrame, key: str, created: str) -> DataFrame:
    """``changes`` with the creation times that ``current`` has of their keys."""
    old = current.select(F.col(key).alias("__k"), F.col(created).alias("__c"))
    return changes.join(old, changes[key] == F.col("__k"), "left").withColumn(created, F.coalesce("__c", created)).drop("__k", "__c")


def delete(current: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti").select(*current.columns)


DEPENDENCY_ORDER = ("project_id", "workspace_id", "repository", "lockfile_path", "ecosystem", "name", "version", "direct", "dev", "indexed_at")


def findings_order(path_col: str = "path") -> list[Column]:
    """Severity first, then advisory, package, file, line, type, and where they come from."""
    return [F.desc("severity"), *map(F.asc, ("advisory_id", "package", path_col, "line", "type", "project_id", "workspace_id", "id"))]


def summary(docs: DataFrame, embeddings: DataFrame | None = None, size: str = "size", updated: str = "updated_at") -> DataFrame:
    """(files, bytes, embeddings, updated_at): the totals of an index, in one row."""
    out = docs.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.max(updated).alias(updated))
    n = F.lit(0).cast("bigint").alias("embeddings") if embeddings is None else F.col("embeddings")
    both = out if embeddings is None else out.crossJoin(F.broadcast(embeddings.agg(F.count("*").alias("embeddings"))))  # a row each
    return both.select("files", "bytes", n, updated)


def status(docs: DataFrame, language: str = "language", size: str = "size") -> DataFrame:
    """(language, files, bytes): totals by language, and of all in the row without one."""
    lang = F.when(F.coalesce(F.col(language), F.lit("")) == "", "unknown").otherwise(F.col(language))
    rows = docs.select(lang.alias("language"), F.col(size).alias("size"))
    return rows.rollup("language").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def newer(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of ``changes`` that no row of ``current`` of their key is ahead of in ``order``; a null there is behind all."""
    old = current.select(F.col(key).alias("__k"), F.col(order).alias("__o")).groupBy("__k").agg(F.max("__o").alias("__o"))
    held = changes.join(old, changes[key] == F.col("__k"), "left")
    return held.where(F.col("__o").isNull() | (F.col(order) >= F.col("__o"))).select(*[changes[c] for c in changes.columns])


class Table:
    """A versioned Parquet table in buckets by the hash of its key.

    A change is a layer over the buckets it touches: a new folder of its rows,
    and one of the keys whose rows in lower layers hold no longer, so that it
    writes little and moves no row that stays. A pointer file names the layers
    of each bucket. A bucket of more than ``LAYERS`` layers, or most of whose
    rows are gone, is written anew as one. Readers take the gone keys out by an
    anti-join. Readers of an old version aren't disturbed, and a failed write
    leaves the pointer as it was. The pointer goes through the file system that
    the path names, and is replaced by one rename, which has to be atomic
    there. A batch number can be stored with it: what a stream has applied is
    known from the same file that makes it visible.
    """

    #: Layers of a bucket, and bytes of gone keys up to which a reader holds them in memory.
    LAYERS, HELD = 8, 64 << 20

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # ---- the pointer

    def _hadoop(self, name: str = ""):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def state(self) -> dict:
        """``parts``, the layers of every bucket from the lowest, and ``batch``, the last batch applied (-1 for none).

        A pointer of an older version has one folder a bucket; its rows weren't counted.
        """
        path, fs = self._hadoop("CURRENT")
        if not fs.exists(path):
            return {"parts": {}, "batch": -1, "exists": False}
        stream = fs.open(path)
        try:
            found = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        parts = {b: [{"at": 0, "rows": p, "n": 0}] if isinstance(p, str) else p for b, p in found["parts"].items()}
        return found | {"parts": parts, "exists": True}

    def _agree(self, key: str | None) -> dict:
        """The state, once it is known that ``key`` is the one that the buckets are made by."""
        state = self.state()
        if state["exists"]:
            self.key, self.buckets = state["key"], state["buckets"]
            if key and key != self.key:
                raise ValueError(f"the table is kept by {self.key}, not by {key}")
        elif key:
            self.key = key
        return state

    def _point(self, parts: dict[str, list[dict]], batch: int) -> None:
        jvm, (target, fs) = self.spark._jvm, self._hadoop("CURRENT")
        made, _ = self._hadoop(f".CURRENT-{uuid.uuid4().hex}")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps({"parts": parts, "batch": batch, "key": self.key, "buckets": self.buckets}).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, target, over)

    # ---- rows

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self._bucket(self.key)).distinct().collect()}  # a row for each bucket at most

    def _write(self, df: DataFrame, partition_by: Sequence[str] = (), placed: bool = False) -> tuple[str, dict[str, tuple[str, int, int]]]:
        """Write the rows to a new folder: its name, and the folder, rows and bytes of keys of each bucket there is.

        Rows that go to one place meet in a task only as far as the advisory
        partition size of adaptive execution; what is beyond goes to further tasks and files.
        ``placed`` rows come from a table in the same buckets and stay where they are.
        """
        folder = f"v-{uuid.uuid4().hex}"
        rows = df.withColumn("__bucket", self._bucket(self.key))
        rows = rows if placed else rows.hint("rebalance", "__bucket", *partition_by)
        rows.write.partitionBy("__bucket", *partition_by).parquet(f"{self.path}/{folder}")
        path, fs = self._hadoop(folder)
        names = [n for x in fs.listStatus(path) if (n := x.getPath().getName()).startswith("__bucket=")]
        if not names:
            return folder, {}
        size = F.sum(F.coalesce(F.octet_length(F.col(self.key).cast("string")), F.lit(0)) + 32)
        counts = self.spark.read.parquet(f"{self.path}/{folder}").groupBy("__bucket").agg(F.count("*"), size).collect()
        return folder, {str(b): (f"{folder}/__bucket={b}", n, size) for b, n, size in counts}

    def _store(self, df: DataFrame, at: int, partition_by: Sequence[str] = (), placed: bool = False) -> dict[str, dict]:
        """A layer of these rows for each bucket that they are in."""
        folder, made = self._write(df, partition_by, placed)
        self._schema(folder, df)
        return {b: {"at": at, "rows": f, "n": n} for b, (f, n, _) in made.items()}

    def _schema(self, folder: str, df: DataFrame) -> None:
        path, fs = self._hadoop("SCHEMA")
        if not fs.exists(path):
            out = fs.create(path, True)
            out.write(bytearray(df.schema.json().encode()))
            out.close()

    def _rows(self, parts: dict[str, list[dict]], only: Sequence[int] | set[int] | None = None) -> DataFrame | None:
        """The rows that hold, of all or some buckets; None where there is no layer of rows."""
        layers = [x for b, p in sorted(parts.items()) if only is None or int(b) in only for x in p]

        def scans(what: str) -> list[DataFrame]:
            """One scan for each folder, with the number of its layer."""
            roots: dict[tuple[int, str], list[str]] = {}
            for x in layers:
                if what in x:
                    roots.setdefault((x["at"], x[what].split("/")[0]), []).append(f"{self.path}/{x[what]}")
            return [self.spark.read.option("basePath", f"{self.path}/{v}").parquet(*p).drop("__bucket").withColumn("__at", F.lit(at)) for (at, v), p in sorted(roots.items())]

        rows, gone = scans("rows"), scans("gone")
        if not rows:
            return None
        out = reduce(DataFrame.unionByName, rows)
        if gone:
            keys = reduce(DataFrame.unionByName, gone).select(F.col(self.key).alias("__k"), F.col("__at").alias("__gone"))
            small = sum(x.get("gone_bytes", 0) for x in layers) <= self.HELD  # else it is left to a shuffled join
            out = out.join(F.broadcast(keys) if small else keys, (F.col(self.key) == F.col("__k")) & (F.col("__gone") > F.col("__at")), "left_anti")
        return out.drop("__at")

    def read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None for a table never written."""
        state = self.state()
        if not state["exists"]:
            return None
        if (rows := self._rows(state["parts"], only)) is not None:
            return rows
        path, fs = self._hadoop("SCHEMA")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return self.spark.createDataFrame([], StructType.fromJson(json.loads(text)))

    def write(self, df: DataFrame, partition_by: Sequence[str] = (), batch: int = -1, placed: bool = False) -> DataFrame | None:
        """Make ``df`` the whole table; the rows as written, as :meth:`put` gives them."""
        made = {b: [x] for b, x in self._store(df, 1, partition_by, placed).items()}
        self._point(made, batch)
        return self._rows(made)

    def _lay(self, state: dict, rows: DataFrame | None, gone: DataFrame | None, own: bool = False, batch: int | None = None, placed: bool = False) -> DataFrame | None:
        """Lay ``rows`` over the table, in which those of the keys in ``gone``, and with ``own`` of the keys of ``rows``, hold no longer; the rows as written."""
        parts, key = dict(state["parts"]), self.key
        at = 1 + max((x["at"] for p in parts.values() for x in p), default=0)
        made = {} if rows is None else self._store(rows, at, placed=placed)
        written = self._rows({b: [x] for b, x in made.items()})
        keys = ([written.select(key)] if own and written is not None else []) + ([] if gone is None else [gone.select(key)])
        if keys and parts:
            touched = ({*map(int, made)} if own else set()) | (set() if gone is None else self._touched(gone))
            if (now := self._rows(parts, touched)) is not None:
                lost = now.select(key).join(reduce(DataFrame.unionByName, keys), key, "left_semi").distinct()  # keys that aren't there need no mark
                for b, (f, n, size) in self._write(lost)[1].items():
                    made[b] = {"at": at} | made.get(b, {}) | {"gone": f, "gone_n": n, "gone_bytes": size}
        for b, x in made.items():
            parts[b] = [*parts.get(b, []), x]
        total = lambda b, what: sum(x.get(what, 0) for x in parts[b])
        worn = {int(b) for b in made if len(parts[b]) > self.LAYERS or 2 * total(b, "gone_n") > total(b, "n")}
        if worn and (now := self._rows(parts, worn)) is not None:
            parts = {b: p for b, p in parts.items() if int(b) not in worn} | {b: [x] for b, x in self._store(now, at + 1).items()}
        self._point(parts, state["batch"] if batch is None else batch)
        return written

    def put(self, changes: DataFrame, key: str | None = None, created: str | None = None, order: str | None = None, removed: DataFrame | None = None, batch: int | None = None) -> DataFrame | None:
        """Rows of ``changes`` take the place of those of their key, and the keys of ``removed`` go.

        ``created`` names a time that stays that of the first version, ``order``
        a column in which a change must not be behind the row it replaces.
        Gives the rows as written, None for none: what is derived from them needn't work out ``changes`` again.
        """
        state = self._agree(key)
        key = self.key
        if not state["exists"]:
            return self.write(changes, batch=-1 if batch is None else batch)
        now = self._rows(state["parts"], self._touched(changes)) if created or order else None
        if now is not None:
            changes = newer(now, changes, key, order) if order else changes
            kept = now if removed is None else delete(now, removed, key)
            changes = keep_created(kept, changes, key, created) if created else changes
        return self._lay(state, changes, removed, own=True, batch=batch)

    def put_all_of(self, rows: DataFrame, of: DataFrame, key: str | None = None, placed: bool = False) -> None:
        """Replace every row of the keys in ``of`` by those in ``rows``: a table with many rows of a key.

        ``placed`` tells that ``rows`` are made of what a table in the same
        buckets holds, each beside its source: they aren't moved then.
        """
        state = self._agree(key)
        if not state["exists"]:
            self.write(rows, placed=placed)
        else:
            self._lay(state, rows, of, placed=placed)

    def remove(self, keys: DataFrame, key: str | None = None) -> None:
        state = self._agree(key)
        if state["exists"]:
            self._lay(state, None, keys)

    def vacuum(self) -> int:
        """Drop the folders that the pointer doesn't name; returns how many. No reader of an older version may be left."""
        used = {x[what].split("/")[0] for p in self.state()["parts"].values() for x in p for what in ("rows", "gone") if what in x}
        path, fs = self._hadoop()
        old = [x.getPath() for x in fs.listStatus(path) if x.getPath().getName().startswith("v-") and x.getPath().getName() not in used]
        for p in old:
            fs.delete(p, True)
        return len(old)

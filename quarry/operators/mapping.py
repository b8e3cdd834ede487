"""Row functions whose failures are kept apart, and the indexing job built on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def map_rows(df: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """What ``f`` makes of every row, with ``error`` null; or a row of nulls with the error's text (Arrow).

    Rows come in no order. The result has ``schema`` and ``error``.
    """
    shape = StructType.fromDDL(f"{schema}, error string")
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in b.to_pylist():
                try:
                    rows.append({**f(row), "error": None})
                except Exception as e:
                    rows.append({"error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in arrow.names} for r in rows], schema=arrow)

    return df.mapInArrow(run, shape)


def map_collect(df: DataFrame, f: Callable[[dict], dict], schema: str) -> tuple[DataFrame, DataFrame]:
    """The results of the rows that went well, and the errors of the others."""
    both = map_rows(df, f, schema)
    return both.where("error IS NULL").drop("error"), both.where("error IS NOT NULL").select("error")


def map_reduce(df: DataFrame, f: Callable[[dict], dict], schema: str, by: Sequence[str], *totals: Column) -> DataFrame:
    """Results aggregated by key, partly before the shuffle; rows that fail are passed over."""
    return map_collect(df, f, schema)[0].groupBy(*by).agg(*totals)


@dataclass(frozen=True)
class Stats:
    processed: int
    errored: int
    bytes: int


class Hook:
    """What an indexing job reports to; ``on_files`` gets a table, as files are never listed on the driver."""

    def on_start(self) -> None: ...

    def on_files(self, results: DataFrame) -> None:
        """(path, error) of every file; error is null where it went well."""

    def on_complete(self, stats: Stats) -> None: ...


def run_index(files: DataFrame, transform: Callable[[dict], dict], schema: str, sink: Callable[[DataFrame], None], hooks: Sequence[Hook] = (), folder: str | None = None) -> Stats:
    """Transform every file (path, content, …), give the sink those that went well, and count in the same pass.

    ``transform`` may be any row function to ``schema``; a file that fails is
    counted and reported, and the job goes on. With hooks, the results are kept
    in ``folder`` so that they aren't computed again for the report.
    """
    for h in hooks:
        h.on_start()
    keep = StructType.fromDDL(f"__path string, __bytes bigint, {schema}").simpleString().removeprefix("struct<").removesuffix(">")

    def one(row: dict) -> dict:
        return {**transform(row), "__path": row["path"], "__bytes": len((row["content"] or "").encode())}

    seen = map_rows(files, _with_path(one), f"{keep}")
    if folder is not None:
        seen.write.mode("overwrite").parquet(folder)
        seen = files.sparkSession.read.parquet(folder)
    counted = Observation()
    done = seen.observe(counted, F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("errored"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("__bytes"))), F.lit(0)).alias("bytes"))
    sink(done.where("error IS NULL").drop("__path", "__bytes", "error"))
    stats = Stats(**counted.get)
    for h in hooks:
        h.on_files(seen.select(F.col("__path").alias("path"), "error"))
        h.on_complete(stats)
    return stats


class _Failed(Exception):
    pass


def _with_path(f: Callable[[dict], dict]) -> Callable[[dict], dict]:
    def run(row: dict) -> dict:
        try:
            return f(row)
        except Exception as e:
            raise _Failed(f"{row.get('path')}: {type(e).__name__}: {e}") from e

    return run

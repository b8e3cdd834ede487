"""Change feeds and advisory polls as Structured Streaming jobs.

A batch is applied under its id, which the table's pointer holds beside the
folders that the batch wrote: one that Spark repeats after a failure finds its
id there and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.stores import Table, delete, upsert


def last_change(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last change of every key in a batch."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return batch.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def replay(current: DataFrame | None, batch: DataFrame, key: str = "path", order: str = "sequence") -> DataFrame:
    """What a table of ``current`` rows holds after a batch of changes."""
    final = last_change(batch, key, order)
    rows = final.where("change_type <> 'deleted'").drop("change_type", order)
    return rows if current is None else upsert(delete(current, final.where("change_type = 'deleted'"), key), rows, key)


def apply_changes(table: Table, batch: DataFrame, key: str = "path", order: str = "sequence", transform: Callable[[DataFrame], DataFrame] | None = None, batch_id: int | None = None) -> None:
    """Added and modified rows replace those of their key; deleted keys go. ``change_type`` and the order stay out of the table."""
    final = last_change(batch, key, order)
    rows = final.where("change_type <> 'deleted'").drop("change_type", order)
    table.put(transform(rows) if transform else rows, key, removed=final.where("change_type = 'deleted'").select(key), batch=batch_id)


def _applied(table: Table, batch_id: int) -> bool:
    return table.state()["batch"] >= batch_id


def _started(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool, every: str, on_error: Callable[[int, Exception], None] | None) -> StreamingQuery:
    """With ``on_error``, a batch that fails is handed to it, and the stream goes on with the next; else the query fails and the batch is repeated."""

    def run(batch: DataFrame, batch_id: int) -> None:
        try:
            step(batch, batch_id)
        except Exception as e:
            if on_error is None:
                raise
            on_error(batch_id, e)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def watch(changes: DataFrame, table: Table, checkpoint: str, key: str = "path", order: str = "sequence", transform: Callable[[DataFrame], DataFrame] | None = None, once: bool = True, every: str = "10 seconds", on_error: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Start a query that keeps ``table`` up to date with the stream of ``changes``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if not _applied(table, batch_id):
            apply_changes(table, batch, key, order, transform, batch_id)

    return _started(changes, step, checkpoint, once, every, on_error)


def poll(spark: SparkSession, folder: str, normalize: Callable[[DataFrame], DataFrame], table: Table, checkpoint: str, batch_files: int = 100, once: bool = True, every: str = "5 minutes", on_error: Callable[[int, Exception], None] | None = None) -> StreamingQuery:
    """Read new feed files as they come, ``batch_files`` at a time; the newest version of an advisory counts, in whatever batch it comes.

    The checkpoint is the high-water mark, and moves only when a batch is in the table.
    """
    rows = spark.readStream.format("text").option("maxFilesPerTrigger", batch_files).load(folder)

    def step(batch: DataFrame, batch_id: int) -> None:
        if not _applied(table, batch_id):
            table.put(last_change(normalize(batch), "id", "modified"), "id", order="modified", batch=batch_id)

    return _started(rows, step, checkpoint, once, every, on_error)

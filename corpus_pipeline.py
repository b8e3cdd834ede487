"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``. The first four return the columns
of ``documents``; the last returns the packing of what they kept.

Cases, of all stages
--------------------
* An empty table stays empty. Further columns are carried untouched through the
  first four stages, whatever their names.
* Rows with a null id are rows like others. Texts of any length are read whole.
* A null, empty or blank text goes in :func:`language_id`, which finds no letter
  in it; the later stages, run without it, keep such a row (:func:`pack` has no
  tokens of it to place).
* Null labels train nothing, null sources are no site.
* Repeated rows: :func:`near_dedup` keeps one of them, all other stages treat
  each by itself. Ties there go to the smallest ``(doc_id, hash of the text)``,
  null ids first.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common as C
from quarry.llm import decontam, langid, linededup, packing, simhash

#: DuckDB can't express kernel scoring, SimHash groups, edit matching or greedy packing.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their own labels, places in a language; a null label becomes the language found."""
    return langid.keep_identified(docs, langid.train(docs), label_col="lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from their site's documents; no document goes.

    Near copies count as one page, or the lines of a group of copies would be
    boilerplate and the group lost before :func:`near_dedup` can keep one of
    it. A document of which nothing would be left keeps its text.
    """
    copies = C.cut(simhash.duplicates(docs).groupBy("text_hash").agg(F.min(F.xxhash64("keep_id", "keep_hash")).alias("group")))
    texts = docs.select("source", "text", F.expr(C.hash64("text")).alias("text_hash"))
    pages = texts.join(C.broadcast_if_small(copies), "text_hash", "left").withColumn("page", F.coalesce("group", "text_hash"))
    bad = linededup.boilerplate(pages, F.col("source"), F.col("text"), page=F.col("page"))
    lost = C.fresh(docs, "dropped")
    clean = linededup.drop_boilerplate(docs, F.col("source"), n_dropped=lost, bad=bad, keep_emptied=True)
    return clean.withColumn("n_chars", F.when(F.col(lost) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).drop(lost)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: every piece of every document kept, with its place."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]


def _folder(spark: SparkSession) -> str:
    """A new folder under the one all executors share; a temporary one only where none is set."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="quarry-pipeline-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The folder of the intermediate tables stays until the caller drops it."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs

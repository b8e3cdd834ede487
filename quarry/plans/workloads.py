"""The single-component workloads that the survey lists, at their stated sizes, for comparing rounds.

Each takes a session and returns a table whose materialisation is the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import fuzzy, regex, text
from quarry.operators import mapping, search
from quarry.plans.engine import Engine
from quarry.sources import files

_WORDS = "alpha beta gamma checkout request handler service router context value".split()


def _text(n: int, seed: int = 0, lines: int = 12) -> str:
    words = [_WORDS[(seed * 7 + i * i) % len(_WORDS)] for i in range(n // 6)]
    return "\n".join(" ".join(words[i::lines]) for i in range(lines))[:n]


def _corpus(spark: SparkSession, docs: int, blocks: int, needle: str = "HandleCheckoutRequest") -> DataFrame:
    block = f"func {needle}(ctx Context) error {{\n\treturn nil\n}}\n"
    rows = [(f"d{i}", f"src/file{i}.go" if i % 2 else f"src/file{i}.py", "go" if i % 2 else "python", "r", "main", block * blocks if i % 3 == 0 else _text(60 * blocks, i)) for i in range(docs)]
    return spark.createDataFrame(rows, "doc_id string, path string, language string, repository_id string, branch string, content string")


def _one(spark: SparkSession, body: str) -> DataFrame:
    return spark.createDataFrame([("d", body)], "doc_id string, content string")


def _fuzzy(spark: SparkSession, body: list[str], pattern: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in body], "t string").select(fuzzy.score_rows(F.col("t"), pattern))


def _index(spark: SparkSession, docs: int) -> DataFrame:
    out: list[DataFrame] = []
    mapping.run_index(_corpus(spark, docs, 4), lambda r: {"doc_id": r["doc_id"], "n": len(regex.trigrams(r["content"].encode()))}, "doc_id string, n int", lambda df: out.append(df) or df.write.format("noop").mode("overwrite").save())
    return out[0]


def _hits(spark: SparkSession, docs: int) -> DataFrame:
    return search.bm25(_corpus(spark, docs, 4), ["alpha", "beta", "gamma"])


def _shards(spark: SparkSession, docs: int) -> DataFrame:
    d = _corpus(spark, docs, 4)
    return search.merge_shards(search.scan_candidates(d.where("doc_id < 'd5'"), "HandleCheckout").unionByName(search.scan_candidates(d.where("doc_id >= 'd5'"), "HandleCheckout")))


WORKLOADS: dict[str, Callable[[SparkSession], DataFrame]] = {
    "extract trigrams, 10 KiB": lambda s: text.trigram_postings(_one(s, _text(10240)), "doc_id", "content"),
    "trigram search, 1000 files x 6 blocks": lambda s: search.scan_candidates(_corpus(s, 1000, 6), "HandleCheckoutRequest").orderBy(F.desc("matched"), "doc_id").limit(25),
    "build trigram index, 100 docs x 8 blocks": lambda s: Engine(_corpus(s, 100, 8)).index(),
    "exact match, 10 KiB": lambda s: search.exact_counts(_one(s, _text(10240)), "request"),
    "exact match without case, 10 KiB": lambda s: search.contains_any(_one(s, _text(10240)), "REQUEST", ["content"]),
    "exact search, 1000 docs x 32 lines": lambda s: _corpus(s, 1000, 11).select("doc_id", F.inline(text.occurrences(F.col("content"), "Checkout"))),
    "fuzzy match, 1000 characters": lambda s: _fuzzy(s, [_text(1000)], "ckreq"),
    "fuzzy search, 1000 paths": lambda s: _fuzzy(s, [f"src/handlers/checkout_{i}/HandleCheckoutRequest.go" for i in range(1000)], "hndlchktrq"),
    "fuzzy score, 1000 characters": lambda s: _fuzzy(s, [_text(1000, 3)], "alphareq"),
    "bm25, 1 doc": lambda s: _hits(s, 1),
    "rank, 1000 docs, 3 terms": lambda s: _hits(s, 1000).orderBy(F.desc("score"), "doc_id"),
    "normalise 1000 scores": lambda s: s.range(1000).select(F.lit("b").alias("backend"), F.col("id").cast("double").alias("score")).select(search.min_max(F.col("score"), ["backend"]).alias("n")),
    "unified search, 100 docs": lambda s: Engine(_corpus(s, 100, 4)).request("Checkout", limit=20),
    "scoped search, 100 docs, half go": lambda s: Engine(_corpus(s, 100, 4)).search("Checkout", where=F.col("language") == "go", limit=20),
    "detect language, 100 paths": lambda s: files.detect_language(s.range(100).select(F.concat(F.lit("a/f"), F.col("id").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in "go py rs ts js java rb c sql md".split()]), (F.col("id") % 10 + 1).cast("int"))).alias("path"))),
    "is binary, 4 inputs": lambda s: s.createDataFrame([(bytearray(b"text"),), (bytearray(b"a\0b"),), (bytearray(b""),), (bytearray(b"x" * 2000),)], "c binary").select(text.is_binary(F.col("c"))),
    "write shard, 1000 docs": lambda s: Engine(_corpus(s, 1000, 2)).index().sortWithinPartitions("trigram"),
    "search shard, 1000 docs": lambda s: search.candidates(Engine(_corpus(s, 1000, 2)).index(), regex.plan("HandleCheckout").codes),
    "merge 2 shards, 500 + 500 docs": lambda s: _shards(s, 1000),
    "index job, 100 files": lambda s: _index(s, 100),
    "index job, 1 file": lambda s: _index(s, 1),
}

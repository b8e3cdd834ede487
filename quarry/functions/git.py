"""Commit trailers, co-authors and repository names; git facts of a working copy."""

from __future__ import annotations

import re
import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TRAILER = re.compile(r"\s*([A-Za-z0-9-]+)\s*:\s*(\S.*?)\s*")


def trailers(message: str) -> list[tuple[str, str]]:
    """The key and value lines that end the message, in order."""
    out: list[tuple[str, str]] = []
    for line in reversed(message.replace("\r\n", "\n").rstrip().split("\n")):
        m = _TRAILER.fullmatch(line)
        if not m:
            break
        out.insert(0, (m[1], m[2]))
    return out


def co_authors(message: str) -> list[tuple[str, str]]:
    """(name, email) of every co-author trailer that has both."""
    out = []
    for key, value in trailers(message):
        a, b = value.rfind("<"), value.rfind(">")
        if key.lower() == "co-authored-by" and 0 <= a < b and (name := value[:a].strip()) and (mail := value[a + 1 : b].strip()):
            out.append((name, mail))
    return out


def trailers_of(message: Column) -> Column:
    """array<struct<key, value>> of each message (Arrow)."""

    @F.pandas_udf("array<struct<key: string, value: string>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[{"key": k, "value": v} for k, v in trailers(m or "")] for m in s])

    return run(message)


def co_authors_of(message: Column) -> Column:
    """array<struct<name, email>> of each message (Arrow)."""

    @F.pandas_udf("array<struct<name: string, email: string>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[{"name": n, "email": e} for n, e in co_authors(m or "")] for m in s])

    return run(message)


def repository_name(url: Column) -> Column:
    """The last two parts of a remote's URL, without ``.git``."""
    plain = F.regexp_replace(url, r"\.git$", "")
    return F.when(url.startswith("git@"), F.regexp_replace(plain, "^[^:]*:", "")).when(plain.contains("/"), F.regexp_extract(plain, "([^/]*/[^/]*)$", 1)).otherwise(plain)


def history(spark: SparkSession, folder: str) -> DataFrame:
    """(path, commit, author, author_email, committed, message): the newest commit of each file, from one walk of the log on the driver."""
    mark = "\x1e"
    text = subprocess.run(["git", "-C", folder, "log", f"--format={mark}%H%x1f%an%x1f%ae%x1f%ct%x1f%B%x1f", "--name-only"], capture_output=True, text=True, check=True).stdout
    seen: dict[str, tuple] = {}
    for entry in text.split(mark)[1:]:
        sha, name, mail, when, message, files = entry.split("\x1f")
        for path in filter(None, files.strip().split("\n")):
            seen.setdefault(path, (path, sha, name, mail, int(when), message.strip()))
    rows = spark.createDataFrame(list(seen.values()), "path string, commit string, author string, author_email string, committed bigint, message string")
    return rows.withColumn("committed", F.timestamp_seconds("committed"))


def with_facts(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """``docs`` with what :func:`history` knows of their path, under the names that result filters use; a file without history keeps its row."""
    message = F.col("__f.message")
    known = facts.select(F.struct(*facts.columns).alias("__f"))
    return docs.join(known, F.col("path") == F.col("__f.path"), "left").select(
        *[docs[c] for c in docs.columns], F.coalesce("__f.author_email", F.lit("")).alias("commit_author"), F.coalesce("__f.author", F.lit("")).alias("commit_author_name"), F.coalesce(message, F.lit("")).alias("commit_message"), F.col("__f.committed").alias("commit_date"),
        F.coalesce(F.transform(co_authors_of(F.coalesce(message, F.lit(""))), lambda a: a["email"]), F.array().cast("array<string>")).alias("commit_coauthors"),
    )

"""Boilerplate lines by their frequency within a site.

Rows are grouped by host. A line's share is the number of the host's distinct
pages that hold it over the number of the host's distinct pages; lines on more
than one page whose share exceeds ``max_ratio`` are dropped wherever they stand
on that host. Lines are compared without blanks at their ends, through a 64-bit
hash, and counted over all pages.

Cases
-----
* A null text stays null and isn't a page. A null host is no site: its pages
  keep all lines.
* Blank lines are never counted nor dropped. A page of which every line goes
  has the empty text.
* The ratio holds at every size of a host; a line on a single page repeats
  nothing and stays, so a host of one page loses nothing. A share equal to
  ``max_ratio`` doesn't exceed it.
* Repeated rows and copies of one text are one page of their host, or their
  lines would pass for boilerplate. A line repeated on one page counts once
  and is dropped everywhere on it. An empty table stays empty.
* Texts of any length are counted and cleaned whole. Other columns are carried
  untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common as C

MAX_RATIO = 0.05


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.transform(_lines(text), F.trim), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _pages(docs: DataFrame, host: Column, text: Column, page: Column | None) -> DataFrame:
    page = F.xxhash64(text) if page is None else page
    return docs.select(host.alias("host"), text.alias("text"), page.alias("page")).where("host IS NOT NULL AND text IS NOT NULL")


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, page: Column | None = None) -> DataFrame:
    """(host, line): the hashes of every host's boilerplate lines. Rows of equal ``page`` count as one, by default those of equal text."""
    pages = _pages(docs, host, text, page)
    total = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = pages.select("host", "page", F.explode(_hashes(F.col("text"))).alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where("n > 1")
    # a host makes one row of the totals, so the join is on the small sides of both aggregates
    return seen.join(total, "host").where(F.col("n") > max_ratio * F.col("pages")).select("host", "line")


def drop_boilerplate(docs: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO, n_lines: str | None = None, n_dropped: str | None = None, bad: DataFrame | None = None, keep_emptied: bool = False, broadcast_rows: int = C.BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the text cleaned, and the numbers of lines before and dropped where named.

    ``bad`` is what :func:`boilerplate` gives, if already known. With
    ``keep_emptied``, a text that would lose all but blanks keeps every line.
    Up to ``broadcast_rows`` boilerplate lines are broadcast by host. Beyond, they are
    joined to the pages' line hashes, and the texts with the lines that they
    lose by (host, page), so that no host gathers its texts in one task.
    """
    bad = C.cut(boilerplate(docs, host, F.col(text_col), max_ratio) if bad is None else bad)
    lines, site, page = C.fresh(docs, "lines"), C.fresh(docs, "site"), C.fresh(docs, "page")
    parts = _lines(F.col(text_col))
    if bad.limit(broadcast_rows + 1).count() <= broadcast_rows:
        side = bad.groupBy("host").agg(F.collect_set("line").alias(lines)).select(F.col("host").alias(site), lines)
        out = docs.join(F.broadcast(side), host == F.col(site), "left")
    else:
        held = _pages(docs, host, F.col(text_col), None).select("host", "page", F.explode(_hashes(F.col("text"))).alias("line")).distinct()
        side = held.join(bad, ["host", "line"]).groupBy("host", "page").agg(F.collect_set("line").alias(lines)).select(F.col("host").alias(site), F.col("page").alias(page), lines)
        out = docs.join(side, (host == F.col(site)) & (F.xxhash64(F.col(text_col)) == F.col(page)), "left")
    kept = F.when(F.col(lines).isNull(), parts).otherwise(F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(lines), F.xxhash64(F.trim(x)))))
    clean = C.fresh(docs, "clean")
    out = out.withColumn(clean, kept)
    if keep_emptied:
        out = out.withColumn(clean, F.when(F.exists(clean, lambda x: F.trim(x) != ""), F.col(clean)).otherwise(parts))
    columns = [F.array_join(clean, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    before = F.coalesce(F.size(parts), F.lit(0)) if (n_lines or n_dropped) else None
    if n_lines:
        columns.append(F.when(F.col(text_col).isNull(), 0).otherwise(before).alias(n_lines))
    if n_dropped:
        columns.append(F.when(F.col(text_col).isNull(), 0).otherwise(before - F.size(clean)).alias(n_dropped))
    return out.select(*columns)


ORACLE = """
WITH pages AS (SELECT source, text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
total AS (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, text FROM pages) GROUP BY source),
seen AS (
  SELECT source, line, count(*) AS n
  FROM (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x)))) AS line FROM (SELECT DISTINCT source, text FROM pages))
  WHERE line <> '' GROUP BY source, line HAVING count(*) > 1),
bad AS (
  SELECT s.source, list(s.line) AS lines FROM seen s JOIN total t ON s.source = t.source
  WHERE s.n > {max_ratio} * t.pages GROUP BY s.source),
cut AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS parts,
    CASE WHEN b.lines IS NULL THEN string_split(d.text, chr(10))
         ELSE list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(b.lines, trim(x))) END AS kept
  FROM documents d LEFT JOIN bad b ON d.source = b.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN len(kept) = 0 THEN '' ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(len(parts), 0) AS INT) AS n_lines, CAST(coalesce(len(parts) - len(kept), 0) AS INT) AS n_dropped
FROM cut
"""

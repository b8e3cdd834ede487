"""Lexical, exact, phrase, fuzzy and symbol search, rank fusion and relevance ranking.

Ad-hoc searches scan once and stay narrow: required trigrams and the regular
expression are filters of the scan, hit lines are taken from array functions.
Over an index, candidates come from the posting table first.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import fuzzy, regex, text

K1, B = 1.2, 0.75
RRF_K = 60.0


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def verify(docs: DataFrame, pattern: str, text_col: str = "content") -> DataFrame:
    """Documents that ``pattern`` matches. The trigrams it needs are tested first, as substrings."""
    p = regex.plan(pattern)
    grams = [F.col(text_col).contains(g.decode()) for g in p.trigrams[:8] if g.isascii()]
    return docs.where(_all(grams) & F.col(text_col).rlike(regex.to_java(pattern)))


def lexical(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(id, line, snippet, n_lines): the first matching line of every document, and how many match."""
    hits = verify(docs, pattern, text_col).withColumn("__hits", text.matching_lines(F.col(text_col), pattern)).where(F.size("__hits") > 0)
    return hits.select(id_col, F.col("__hits")[0]["line"].alias("line"), F.col("__hits")[0]["snippet"].alias("snippet"), F.size("__hits").alias("n_lines"))


def grep(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(id, line, snippet) of every matching line."""
    return verify(docs, pattern, text_col).select(id_col, F.inline(text.matching_lines(F.col(text_col), pattern)))


def contains_any(docs: DataFrame, query: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring search over several columns."""
    q = query.lower()
    return docs.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False)) for c in columns]))


def candidates(postings: DataFrame, grams: Sequence[int], id_col: str = "doc_id") -> DataFrame:
    """(id, matched, candidate, score): how many of the query's trigrams each document holds."""
    if not grams:
        raise ValueError("the query has no trigrams")
    hits = postings.where(F.col("trigram").isin(list(grams)))  # reaches the scan of a table sorted by trigram
    n = len(set(grams))
    matched = F.size(F.collect_set("trigram"))  # no more than the query's trigrams; a posting that is there twice counts once
    return hits.groupBy(id_col).agg(matched.alias("matched")).withColumn("candidate", F.lit(n)).withColumn("score", F.col("matched") / F.col("candidate"))


def top_candidates(found: DataFrame, limit: int, id_col: str = "doc_id") -> DataFrame:
    """The ``10 * limit`` candidates that hold most trigrams, ties in order of id: what a search with a limit looks at."""
    return found.orderBy(F.desc("matched"), id_col).limit(10 * limit)


def scoped(postings: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The postings of the documents that a scope leaves."""
    return postings.join(docs.select(id_col).distinct(), id_col, "left_semi")


def posting_lists(postings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(trigram, doc_ids): the sorted, distinct documents of each trigram. A list is as long as its trigram is common: narrow the postings first."""
    return postings.groupBy("trigram").agg(F.array_sort(F.collect_set(id_col)).alias("doc_ids"))


def scan_candidates(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """The same counts without an index: substring tests in one narrow pass."""
    grams = sorted(regex.trigrams(query.encode()))
    if not grams:
        raise ValueError("the query has no trigrams")
    matched = reduce(lambda a, b: a + b, [F.col(text_col).contains(g.decode()).cast("int") for g in grams])
    return docs.select(id_col, matched.alias("matched"), F.lit(len(grams)).alias("candidate")).where("matched > 0").withColumn("score", F.col("matched") / F.col("candidate"))


def merge_shards(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Candidates of several shards as one: matched counts add up, the candidate count is the largest."""
    return parts.groupBy(id_col).agg(F.sum("matched").alias("matched"), F.max("candidate").alias("candidate"))


def exact_counts(docs: DataFrame, literal: str, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    hits = docs.where(F.col(text_col).contains(literal))
    return hits.select(id_col, text.count_overlapping(F.col(text_col), literal).cast("bigint").alias("n"))


def phrases(docs: DataFrame, phrase: str, id_col: str = "doc_id", text_col: str = "content") -> DataFrame:
    """(id, line, before, after) of every line with the phrase, at its first place."""
    rows = docs.where(F.col(text_col).contains(phrase)).select(id_col, F.inline(text.lines_with(F.col(text_col), phrase)))
    before, after = text.before_and_after(F.col("snippet"), phrase)
    return rows.select(id_col, "line", before.alias("before"), after.alias("after"))


def fuzzy_search(df: DataFrame, pattern: str, id_col: str, text_col: str, case_sensitive: bool = False, greedy: bool = False) -> DataFrame:
    """(id, text, start, end, score, positions) of every row that matches."""
    rows = df.where(fuzzy.prefilter(F.col(text_col), pattern, case_sensitive)).select(id_col, text_col)
    return rows.withColumn("m", fuzzy.score_rows(F.col(text_col), pattern, case_sensitive, greedy)).select(id_col, text_col, "m.*").where("start >= 0")


# --------------------------------------------------------------------------- fusion


def _ranked(rows: DataFrame, bucket: Column, order: Sequence[Column]) -> DataFrame:
    """``rows`` with their rank in their backend's list, in two levels: within buckets that follow each other, and over the buckets' totals.

    No task sorts a backend's whole list, only a bucket of it.
    """
    cut = rows.withColumn("__b", bucket)
    totals = cut.groupBy("backend", "__b").agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy("backend").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    before = totals.select("backend", "__b", F.coalesce(ahead, F.lit(0)).alias("__before"))
    inner = cut.withColumn("__in", F.row_number().over(Window.partitionBy("backend", "__b").orderBy(*order)))
    return inner.join(before, ["backend", "__b"]).withColumn("rank", (F.col("__before") + F.col("__in")).cast("int")).drop("__b", "__before", "__in")


def positions(hits: DataFrame, buckets: int = 256) -> DataFrame:
    """Hits (backend, doc_id, score) with their ``position``: best score first, ties by id. Hits of one score stay in one bucket."""
    bounds = hits.groupBy("backend").agg(F.array_distinct(F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 10_000)).alias("__q"))
    near = hits.join(F.broadcast(bounds), "backend")  # a row for each backend
    above = F.size(F.filter("__q", lambda q: q > F.col("score")))
    return _ranked(near, above, [F.desc("score"), F.asc("doc_id")]).drop("__q").withColumnRenamed("rank", "position")


def _first_per_document(hits: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """Hits (backend, position, doc_id, score, …) without repeats of a document, ranked again; empty ids keep their place."""
    w = Window.partitionBy("backend", "doc_id").orderBy("position")
    own = F.when(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == "", F.col("position"))
    first = hits.withColumn("__n", F.row_number().over(w)).where((F.col("__n") == 1) | own.isNotNull()).drop("__n")
    return _ranked(first, F.floor(F.col("position") / bucket), [F.asc("position")])


def _fused(scored: DataFrame) -> DataFrame:
    real = scored.where("CAST(doc_id AS STRING) <> ''")
    return real.groupBy("doc_id").agg(F.sum("part").alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("backend", F.col("score").alias("s"))))).alias("backend_scores"))


def reciprocal_rank_fusion(hits: DataFrame, k: float = RRF_K) -> DataFrame:
    """(doc_id, score, backend_scores) with the sum of 1 / (k + rank) over the backends."""
    k = k if k > 0 else RRF_K
    return _fused(_first_per_document(hits).withColumn("part", 1.0 / (F.lit(float(k)) + F.col("rank"))))


def min_max(score: Column, by: Sequence[str]) -> Column:
    """0 to 1 within the group; 1 where all scores are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def z_score(score: Column, by: Sequence[str]) -> Column:
    """Distance to the mean in population deviations; 0 where all scores are equal."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(score).over(w)
    return F.when(sd == 0, 0.0).otherwise((score - F.avg(score).over(w)) / sd)


def weighted_fusion(hits: DataFrame, weights: Mapping[str, float], normalize=min_max) -> DataFrame:
    """(doc_id, score, backend_scores) with the weighted sum of normalised scores."""
    weight = F.coalesce(*[F.when(F.col("backend") == b, F.lit(float(w))) for b, w in weights.items()], F.lit(0.0))
    return _fused(_first_per_document(hits).withColumn("part", weight * normalize(F.col("score"), ["backend"])))


# --------------------------------------------------------------------------- ranking


def term_counts(text_col: Column, terms: Sequence[str]) -> list[Column]:
    """How often each term occurs, without overlap: what the text gets shorter by when it is taken out."""
    empty = F.lit("")
    return [F.coalesce(((F.length(text_col) - F.length(F.replace(text_col, F.lit(t), empty))) / len(t)).cast("int"), F.lit(0)) if t else F.lit(0) for t in terms]


def bm25(docs: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "content", k1: float = K1, b: float = B, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, score) of every document that holds a term; a document's length is its number of lines.

    One pass over the texts makes a narrow row of counts for each document; the
    corpus statistics (a row of them) and the scores follow from these. ``cut``
    may keep the narrow rows (as a table or a checkpoint) where reading the
    texts twice costs more than writing them.
    """
    low = F.lower(F.col(text_col))
    tf = docs.select(id_col, text.line_count(F.col(text_col)).alias("len"), *[c.alias(f"tf{i}") for i, c in enumerate(term_counts(low, terms))])
    tf = cut(tf) if cut else tf
    stats = tf.agg(F.count("*").alias("N"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    held = tf.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
    both = held.crossJoin(F.broadcast(stats))  # one row
    length = F.lit(k1) * (1 - b + b * F.col("len") / F.col("avgdl"))

    def part(i: int) -> Column:
        df, n = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.greatest(F.log((F.col("N") - df + 0.5) / (df + 0.5)), F.lit(0.0))
        return F.when(df > 0, idf * (n * (k1 + 1)) / (n + length)).otherwise(0.0)

    return both.select(id_col, reduce(lambda x, y: x + y, [part(i) for i in range(len(terms))]).alias("score"))


def code_boost(definition: Column, exported: Column, references: Column, imports: Column, depth: Column, modified: Column) -> Column:
    """What code signals add to a document's score."""
    zero = F.lit(0.0)
    return (
        F.when(definition, 3.0).otherwise(zero)
        + F.when(exported, 1.5).otherwise(zero)
        + F.when(references > 0, 0.5 * F.log1p(references)).otherwise(zero)
        + F.when(imports > 0, 0.3 * F.log1p(imports)).otherwise(zero)
        - F.when(depth > 0, 0.05 * depth).otherwise(zero)
        + F.when(modified > 0, 0.1).otherwise(zero)
    )

"""The search engine over a document table: search in all modes, symbols and status; and the folder that keeps it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import cel, regex, text, vectors
from quarry.operators import search, stores, symbols

DEFAULT_LIMIT = 100


class Engine:
    """Searches over documents (doc_id, path, language, repository_id, branch, content).

    ``postings`` is an optional trigram index of the same documents and
    ``embed`` maps a text to its vector; with it, semantic and hybrid searches
    are possible over ``embeddings`` (doc_id, values).
    """

    def __init__(self, docs: DataFrame, postings: DataFrame | None = None, embeddings: DataFrame | None = None, embed: Callable[[str], Sequence[float]] | None = None, known_symbols: DataFrame | None = None):
        self.docs, self.postings, self.embeddings, self.embed, self.known_symbols = docs, postings, embeddings, embed, known_symbols

    def search(self, query: str, mode: str = "", limit: int = DEFAULT_LIMIT, where: Column | None = None, filter: str = "", filter_first: bool = False) -> DataFrame:
        """(doc_id, path, language, line, snippet, matches, score), best first.

        ``matches`` are the byte ranges within the snippet. ``filter`` is
        applied to the hits found, so there may be fewer than ``limit``; with
        ``filter_first`` it narrows the documents instead.
        """
        docs = self.docs if where is None else self.docs.where(where)
        condition = cel.compile_filter(filter, cel.RESULT, self._variables())
        if filter and filter_first:
            docs = docs.where(condition)
        mode = mode or ("hybrid" if self.embed and self.embeddings is not None else "lexical")
        hits = {"lexical": self._lexical, "semantic": self._semantic, "hybrid": self._hybrid}[mode](docs, query, limit)
        out = hits.join(docs, "doc_id")
        if filter and not filter_first:
            out = out.where(condition)
        return out.select("doc_id", "path", "language", "line", "snippet", "matches", "score").orderBy(F.desc("score"), "doc_id")

    def _variables(self) -> dict[str, Column]:
        path = F.col("path")
        known = {"file_path": path, "file_extension": text.extension(text.strip_branch(path)), "repository": F.col("repository_id"), "branch": F.col("branch"), "language": F.col("language"), "project_id": F.col("repository_id"), "file_size": F.octet_length("content").cast("bigint")}
        empty = {"string": F.lit(""), "int": F.lit(0).cast("bigint"), "bool": F.lit(False), "list": F.array().cast("array<string>"), "timestamp": F.lit(None).cast("timestamp")}
        own = {c.lower() for c in self.docs.columns}
        return {k: F.col(k) if k in own else known.get(k, empty[kind]) for k, kind in cel.RESULT.items()}

    def _lexical(self, docs: DataFrame, query: str, limit: int) -> DataFrame:
        """Documents that the expression matches, or, if none does or it has no required trigram, those that hold it as it stands.

        A hit's score is the share of the query's trigrams that it holds.
        """
        p = regex.plan(query)
        if not p.trigrams:
            return self._substring(docs, query, limit)
        if self.postings is not None:
            matched = search.candidates(self.postings, p.codes).where(F.col("matched") == F.col("candidate")).select("doc_id", F.col("score").alias("__score"))
            hits = search.lexical(docs.join(matched, "doc_id", "left_semi"), query).join(matched, "doc_id").withColumnRenamed("__score", "score")
        else:
            hits = search.lexical(docs, query).withColumn("score", F.lit(1.0))  # a match holds all required trigrams
        top = hits.orderBy(F.desc("score"), "doc_id").limit(limit).drop("n_lines")
        if top.isEmpty():
            return self._substring(docs, query, limit)
        return top.withColumn("matches", text.match_ranges(F.col("snippet"), query))

    def _substring(self, docs: DataFrame, query: str, limit: int) -> DataFrame:
        """The first documents by rank, path and id that hold the query as it stands in a line, case aside."""
        q = query.lower()
        ranked = docs.withColumn("__rank", stores.document_rank(query, F.col("path"), F.col("content"))).where("__rank < 3").orderBy("__rank", "path", "doc_id").limit(limit)
        found = ranked.withColumn("__h", F.filter(text.numbered(F.col("content")), lambda x: F.lower(x["snippet"]).contains(q))).where(F.size("__h") > 0)
        first = found.select("doc_id", F.col("__h")[0]["line"].alias("line"), F.col("__h")[0]["snippet"].alias("snippet"))
        return first.select("doc_id", "line", "snippet", F.lit(1.0).alias("score"), text.first_range(F.col("snippet"), query).alias("matches"))

    def _semantic(self, docs: DataFrame, query: str, limit: int) -> DataFrame:
        if self.embed is None or self.embeddings is None:
            raise ValueError("semantic search needs embeddings and a way to embed the query")
        near = vectors.knn(self.embeddings.join(docs.select("doc_id"), "doc_id", "left_semi"), self.embed(query), limit, "cosine", "doc_id")
        return near.join(docs, "doc_id").select("doc_id", F.lit(1).alias("line"), text.first_nonempty_line(F.col("content")).alias("snippet"), "score", F.array().cast(text.RANGES).alias("matches"))

    def _hybrid(self, docs: DataFrame, query: str, limit: int) -> DataFrame:
        lists = {"lexical": self._lexical(docs, query, limit), "semantic": self._semantic(docs, query, limit)}
        w = Window.partitionBy("backend").orderBy(F.desc("score"), "doc_id")
        both = lists["lexical"].withColumn("backend", F.lit("lexical")).unionByName(lists["semantic"].withColumn("backend", F.lit("semantic")))
        ranked = both.withColumn("position", F.row_number().over(w))  # two lists of at most ``limit`` rows
        fused = search.reciprocal_rank_fusion(ranked)
        shown = both.groupBy("doc_id").agg(F.min_by(F.struct("line", "snippet", "matches"), "backend").alias("h"))
        return fused.join(shown, "doc_id").select("doc_id", "h.line", "h.snippet", "h.matches", "score").orderBy(F.desc("score"), "doc_id").limit(limit)

    def request(self, query: str, mode: str = "", limit: int = DEFAULT_LIMIT, names: DataFrame | None = None) -> DataFrame:
        """A query whose mode follows from its spelling: regex, symbol, fuzzy or exact; every matching place is a row."""
        mode = mode or regex.detect_mode(query)
        if mode == "regex":
            return search.grep(self.docs, query).orderBy("doc_id", "line").limit(limit)
        if mode == "exact":
            rows = self.docs.where(F.col("content").contains(query)).select("doc_id", F.inline(text.occurrences(F.col("content"), query)))
            return rows.orderBy("doc_id", "offset").limit(limit)
        names = self.symbols() if names is None else names
        if mode == "symbol":
            return names.where(F.col("name") == query).orderBy("path", "start_line").limit(limit)
        return search.fuzzy_search(names, query, "path", "name").orderBy(F.desc("score"), "path", "name").limit(limit)

    def symbols(self) -> DataFrame:
        return symbols.extract_symbols(self.docs) if self.known_symbols is None else self.known_symbols

    def index(self) -> DataFrame:
        """The trigram postings, to be written sorted by trigram."""
        return text.trigram_postings(self.docs, "doc_id", "content")

    def status(self) -> DataFrame:
        return stores.status(self.docs.withColumn("size", F.octet_length("content")))

    def symbol_search(self, query: str, references: DataFrame | None = None, limit: int = DEFAULT_LIMIT, by_shard: bool = False) -> DataFrame:
        """Symbols by rank, name and place, with their first line as snippet and the number of their references.

        A symbol whose document is gone keeps its row without a snippet.
        ``references`` has (path, name) of each use, under the definition's
        path. ``by_shard`` ranks as a search over several shards does.
        """
        found = self.symbols()
        rank = stores.shard_symbol_score(query, F.col("name"), F.col("container")) if by_shard else stores.symbol_rank(query, F.col("name"), F.col("container"), F.lit(""))
        found = found.withColumn("rank", rank).where(F.col("rank") > 0 if by_shard else F.col("rank") < 5)
        top = found.orderBy(F.desc("rank") if by_shard else F.col("rank"), "name", "path", "start_line").limit(limit)
        return symbols.with_snippets(top if references is None else symbols.with_references(top, references), self.docs)


class Store:
    """What an engine keeps in a folder: documents, postings, symbols and embeddings, each a :class:`stores.Table`."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[str], Sequence[float]] | None = None, dimensions: int = 64, buckets: int = 16):
        self.spark, self.embed, self.dimensions = spark, embed, dimensions
        self.tables = {n: stores.Table(spark, f"{folder.rstrip('/')}/{n}", "doc_id", buckets) for n in ("documents", "postings", "symbols", "embeddings")}

    def index(self, changes: DataFrame, created: str | None = None) -> None:
        """Add or replace documents, and everything derived from them: nothing of an older version stays in any table."""
        written = self.tables["documents"].put(changes, created=created)
        rows = changes.limit(0) if written is None else written  # in the buckets that all tables have, where what is made of them stays
        ids = rows.select("doc_id")
        held = self.tables["postings"].read()
        flat = held is not None and "trigram" in held.columns  # a store of an older version, with a row for each trigram
        grams = text.trigram_postings if flat else text.trigram_lists
        self.tables["postings"].put_all_of(grams(rows, "doc_id", "content"), ids, placed=True)
        self.tables["symbols"].put_all_of(_symbols_of(rows), ids, placed=True)
        if self.embed is not None:
            self.tables["embeddings"].put_all_of(rows.select("doc_id", text.hash_embedding(F.col("content"), self.dimensions).alias("values")), ids, placed=True)

    def remove(self, ids: DataFrame) -> None:
        for t in self.tables.values():
            t.remove(ids)

    def engine(self) -> Engine:
        """The engine over the tables as they are now."""
        found = {n: t.read() for n, t in self.tables.items()}
        if found["documents"] is None:
            raise ValueError("nothing is indexed yet")
        if "trigrams" in found["postings"].columns:
            found["postings"] = found["postings"].select(F.explode("trigrams").alias("trigram"), "doc_id")
        return Engine(found["documents"], found["postings"], found["embeddings"] if self.embed else None, self.embed, found["symbols"])


def _symbols_of(docs: DataFrame) -> DataFrame:
    """Symbols with the id of their document."""
    return symbols.extract_symbols(docs, carry="doc_id")

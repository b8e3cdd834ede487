"""Queries over the driver's tables, one for each operator, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import cel, semver, text, vectors
from quarry.operators import search, stores, symbols, vulnerabilities
from quarry.plans.engine import Engine

WORD, PATTERN, PHRASE, QUERY = "tionth", "t(?:io|ha)n[a-z]+s", "of the", "ther"
TERMS = ["the", "ther", "zu", "ouon"]


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as source files: the source is the repository, the path is made of both ids."""
    d = _read(spark, sf, "documents")
    path = F.concat(F.lit("src/"), F.coalesce("source", F.lit("")), F.lit("/d"), (F.col("doc_id") % 10).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("")))
    return d.select("doc_id", path.alias("path"), F.col("lang").alias("language"), F.col("source").alias("repository_id"), F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("main").alias("branch"), F.col("text").alias("content"))


FILES = "files AS (SELECT doc_id, 'src/' || coalesce(source, '') || '/d' || CAST(doc_id % 10 AS VARCHAR) || '/f' || CAST(doc_id AS VARCHAR) || '.' || coalesce(lang, '') AS path, lang AS language, source AS repository_id, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'main' END AS branch, text AS content FROM documents)"
LINES = "lines AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS snippet, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def take(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return take


_FIRST = "SELECT doc_id, CAST(min(line) AS INT) AS line, arg_min(snippet, line) AS snippet, CAST(count(*) AS INT) AS n_lines FROM lines WHERE {} GROUP BY doc_id"


@_register(f"WITH {FILES}, {LINES} " + _FIRST.format(f"contains(snippet, '{WORD}')"))
def lexical_literal(spark, sf):
    return search.lexical(documents(spark, sf), WORD)


@_register(f"WITH {FILES}, {LINES} " + _FIRST.format(f"regexp_matches(snippet, '{PATTERN}')"))
def lexical_regex(spark, sf):
    return search.lexical(documents(spark, sf), PATTERN)


@_register(f"WITH {FILES} SELECT doc_id, path FROM files WHERE contains(lower(path), 'f12') OR contains(lower(content), 'f12') OR contains(lower(repository_id), 'f12') OR contains(lower(language), 'f12')")
def lexical_fallback(spark, sf):
    return search.contains_any(documents(spark, sf), "F12", ["path", "content", "repository_id", "language"]).select("doc_id", "path")


@_register(f"WITH {FILES}, {LINES} SELECT doc_id, CAST(line AS INT) AS line, snippet FROM lines WHERE regexp_matches(snippet, '{PATTERN}')")
def grep_all_lines(spark, sf):
    return search.grep(documents(spark, sf), PATTERN)


_GRAMS = [WORD[i : i + 3] for i in range(len(WORD) - 2)]


@_register(f"WITH {FILES}, m AS (SELECT doc_id, CAST({' + '.join(f'''CAST(contains(content, '{g}') AS INT)''' for g in sorted(set(_GRAMS)))} AS INT) AS matched FROM files) SELECT doc_id, matched, {len(set(_GRAMS))} AS candidate, matched / {len(set(_GRAMS))}.0::DOUBLE AS score FROM m WHERE matched > 0")
def trigram_candidates(spark, sf):
    return search.scan_candidates(documents(spark, sf), WORD)


_HEX = "h AS (SELECT doc_id, regexp_extract_all(hex(encode(content)), '..') AS b FROM files), g AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(range(1, len(b) - 1), lambda i: b[i] || b[i + 1] || b[i + 2]), lambda t: t[1:2] NOT IN ('00', '0A') AND t[3:4] NOT IN ('00', '0A') AND t[5:6] NOT IN ('00', '0A')))) AS t FROM h)"


@_register(f"WITH {FILES}, {_HEX} SELECT CAST('0x' || t AS INT) AS trigram, count(*) AS documents FROM g GROUP BY t")
def trigram_document_frequency(spark, sf):
    """Size of every posting list of a full index."""
    return Engine(documents(spark, sf)).index().groupBy("trigram").agg(F.count("*").alias("documents"))


@_register(f"WITH {FILES}, m AS (SELECT doc_id % 4 AS shard, doc_id % 100 AS doc, contains(content, 'tio') AS a, contains(content, 'nth') AS b FROM files), s AS (SELECT shard, doc, sum(CAST(a AS INT) + CAST(b AS INT)) AS matched, 2 AS candidate FROM m WHERE a OR b GROUP BY shard, doc) SELECT doc, CAST(sum(matched) AS BIGINT) AS matched, max(candidate) AS candidate FROM s GROUP BY doc")
def shard_merge(spark, sf):
    m = documents(spark, sf).select((F.col("doc_id") % 4).alias("shard"), (F.col("doc_id") % 100).alias("doc"), F.col("content").contains("tio").alias("a"), F.col("content").contains("nth").alias("b")).where("a OR b")
    parts = m.groupBy("shard", "doc").agg(F.sum(F.col("a").cast("int") + F.col("b").cast("int")).alias("matched"), F.lit(2).alias("candidate"))
    return search.merge_shards(parts, "doc")


@_register(f"WITH {FILES} SELECT doc_id, CAST((length(content) - length(replace(content, 'the', ''))) / 3 AS BIGINT) AS n FROM files WHERE contains(content, 'the')")
def exact_count(spark, sf):
    return search.exact_counts(documents(spark, sf), "the")


@_register(f"WITH {FILES}, {LINES}, o AS (SELECT doc_id, line, snippet, unnest(list_filter(range(1, length(snippet) + 1), lambda i: substring(snippet, i, {len(WORD)}) = '{WORD}')) AS pos FROM lines WHERE contains(snippet, '{WORD}')) SELECT doc_id, CAST(line AS INT) AS line, CAST(strlen(substring(snippet, 1, pos - 1)) AS INT) AS \"column\", snippet AS text FROM o")
def exact_lines(spark, sf):
    docs = documents(spark, sf).where(F.col("content").contains(WORD))
    return docs.select("doc_id", F.inline(text.occurrences(F.col("content"), WORD))).select("doc_id", "line", "column", "text")


@_register(f"WITH {FILES}, {LINES} SELECT doc_id, CAST(line AS INT) AS line, substring(snippet, 1, instr(snippet, '{PHRASE}') - 1) AS before, substring(snippet, instr(snippet, '{PHRASE}') + {len(PHRASE)}) AS after FROM lines WHERE contains(snippet, '{PHRASE}')")
def phrase_context(spark, sf):
    return search.phrases(documents(spark, sf), PHRASE)


@_register(f"WITH {FILES}, {LINES}, h AS ({_FIRST.format(f'''contains(snippet, '{WORD}')''')}) SELECT h.doc_id, h.line, array_to_string(list_slice(string_split(f.content, chr(10)), greatest(h.line - 2, 1), h.line + 2), chr(10)) AS context FROM h JOIN files f ON h.doc_id = f.doc_id")
def context_lines(spark, sf):
    docs = documents(spark, sf).withColumn("h", F.get(text.lines_with(F.col("content"), WORD), F.lit(0))).where("h IS NOT NULL")
    return docs.select("doc_id", "h.line", text.context(F.col("content"), F.col("h.line"), 2).alias("context"))


@_register(f"WITH {FILES}, r AS (SELECT doc_id, path, CASE WHEN lower(path) = '{QUERY}' THEN 0 WHEN contains(lower(path), '{QUERY}') THEN 1 WHEN contains(lower(content), '{QUERY}') THEN 2 ELSE 3 END AS rank FROM files) SELECT doc_id, path, rank, row_number() OVER (ORDER BY rank, path, doc_id) AS place FROM r WHERE rank < 3 ORDER BY place LIMIT 100")
def doc_search_rank(spark, sf):
    """The first hundred: the operator's default limit."""
    r = documents(spark, sf).select("doc_id", "path", stores.document_rank(QUERY, F.col("path"), F.col("content")).alias("rank")).where("rank < 3")
    top = r.orderBy("rank", "path", "doc_id").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy("rank", "path", "doc_id")).cast("bigint"))


@_register(f"WITH {FILES}, r AS (SELECT doc_id, path, CASE WHEN contains(lower(path), 'src1') THEN 4 ELSE 0 END + CASE WHEN contains(lower(content), 'src1') THEN 2 ELSE 0 END AS score FROM files) SELECT * FROM r WHERE score > 0 ORDER BY score DESC, path, doc_id LIMIT 100")
def doc_search_shard_rank(spark, sf):
    r = documents(spark, sf).select("doc_id", "path", F.coalesce(stores.shard_document_score("src1", F.col("path"), F.col("content")), F.lit(4)).alias("score")).where("score > 0")
    return r.orderBy(F.desc("score"), "path", "doc_id").limit(100)


_Q = [round(((i * 37) % 64 - 31.5) / 64, 6) for i in range(64)]
_QS = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q) + "]"
_DOT = f"list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * ({_QS})[i]))"
_NX, _NQ = "sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))", sum(x * x for x in _Q) ** 0.5


def _knn_sql(distance: str, score: str) -> str:
    return f"WITH d AS (SELECT vec_id, {distance} AS distance FROM embeddings), r AS (SELECT vec_id, distance, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM d) SELECT vec_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank, round({score}, 6) AS score FROM r WHERE rank <= 10"


def _knn(spark, sf, metric):
    d = vectors.knn(_read(spark, sf, "embeddings"), _Q, 10, metric, "vec_id", "embedding")
    return d.select("vec_id", F.round("distance", 6).alias("distance"), "rank", F.round("score", 6).alias("score"))


@_register(_knn_sql(f"1 - {_DOT} / ({_NX} * {_NQ!r})", "1 - distance"))
def knn_cosine(spark, sf):
    return _knn(spark, sf, "cosine")


@_register(_knn_sql(f"-{_DOT}", "-distance"))
def knn_dot(spark, sf):
    return _knn(spark, sf, "dot_product")


@_register(_knn_sql(f"sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(embedding[i] AS DOUBLE) - ({_QS})[i]) * (CAST(embedding[i] AS DOUBLE) - ({_QS})[i]))))", "1 / (1 + distance)"))
def knn_euclidean(spark, sf):
    return _knn(spark, sf, "euclidean")


_HITS_SQL = f"{FILES}, c AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, (length(content) - length(replace(content, 'the', ''))) / 3 AS a, (length(content) - length(replace(content, 'on', ''))) / 2 AS b FROM files), hits AS (SELECT 'lexical' AS backend, doc_id, CAST(a AS DOUBLE) AS score, row_number() OVER (ORDER BY a DESC, doc_id) AS rank FROM c WHERE a > 0 UNION ALL SELECT 'semantic', doc_id, CAST(b AS DOUBLE), row_number() OVER (ORDER BY b DESC, doc_id) FROM c WHERE b > 0)"


def _hits(spark, sf):
    d, c = documents(spark, sf), F.col("content")
    both = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.inline(F.array(F.struct(F.lit("lexical").alias("backend"), text.count_disjoint(c, "the").cast("double").alias("score")), F.struct(F.lit("semantic").alias("backend"), text.count_disjoint(c, "on").cast("double").alias("score"))))).where("score > 0")
    return search.positions(both.persist())  # narrow rows, read more than once


@_register(f"WITH {_HITS_SQL} SELECT doc_id, round(sum(1.0 / (60.0 + rank)), 9) AS score FROM hits GROUP BY doc_id")
def fusion_rrf(spark, sf):
    return search.reciprocal_rank_fusion(_hits(spark, sf)).select("doc_id", F.round("score", 9).alias("score"))


@_register(f"WITH {_HITS_SQL}, n AS (SELECT *, min(score) OVER (PARTITION BY backend) AS lo, max(score) OVER (PARTITION BY backend) AS hi FROM hits) SELECT doc_id, round(sum(CASE backend WHEN 'lexical' THEN 0.7 ELSE 0.3 END * CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END), 9) AS score FROM n GROUP BY doc_id")
def fusion_weighted(spark, sf):
    return search.weighted_fusion(_hits(spark, sf), {"lexical": 0.7, "semantic": 0.3}).select("doc_id", F.round("score", 9).alias("score"))


@_register("SELECT c_custkey, round(CASE WHEN max(c_acctbal) OVER w = min(c_acctbal) OVER w THEN 1.0 ELSE (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) END, 9) AS score FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def normalize_minmax(spark, sf):
    return _read(spark, sf, "customer").select("c_custkey", F.round(search.min_max(F.col("c_acctbal"), ["c_nationkey"]), 9).alias("score"))


@_register("SELECT c_custkey, round(CASE WHEN stddev_pop(c_acctbal) OVER w = 0 THEN 0.0 ELSE (c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w END, 7) AS score FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def normalize_zscore(spark, sf):
    return _read(spark, sf, "customer").select("c_custkey", F.round(search.z_score(F.col("c_acctbal"), ["c_nationkey"]), 7).alias("score"))


_TF = ", ".join(f"CAST((length(lower(content)) - length(replace(lower(content), '{t}', ''))) / {len(t)} AS BIGINT) AS tf{i}" for i, t in enumerate(TERMS))
_NLINES = "len(string_split(CASE WHEN content LIKE '%' || chr(10) THEN content[1:-2] ELSE content END, chr(10)))"
_PART = " + ".join(f"CASE WHEN df{i} > 0 THEN greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 0) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avgdl)) ELSE 0 END" for i in range(len(TERMS)))


@_register(f"WITH {FILES}, t AS (SELECT doc_id, {_NLINES} AS len, {_TF} FROM files), s AS (SELECT count(*) AS n, avg(len) AS avgdl, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(len(TERMS)))} FROM t) SELECT doc_id, round({_PART}, 7) AS score FROM t, s WHERE {' OR '.join(f'tf{i} > 0' for i in range(len(TERMS)))}")
def bm25(spark, sf):
    return search.bm25(documents(spark, sf), TERMS, cut=DataFrame.persist).select("doc_id", F.round("score", 7).alias("score"))


@_register("SELECT doc_id, round(CASE WHEN quality = 1 THEN 3.0 ELSE 0 END + CASE WHEN toxic = 0 THEN 1.5 ELSE 0 END + CASE WHEN doc_id % 7 > 0 THEN 0.5 * ln(1 + doc_id % 7) ELSE 0 END + CASE WHEN doc_id % 5 > 0 THEN 0.3 * ln(1 + doc_id % 5) ELSE 0 END - 0.05 * (doc_id % 4) + CASE WHEN doc_id % 2 > 0 THEN 0.1 ELSE 0 END, 9) AS score FROM labels")
def rank_boosts(spark, sf):
    i = F.col("doc_id")
    return _read(spark, sf, "labels").select("doc_id", F.round(search.code_boost(F.col("quality") == 1, F.col("toxic") == 0, i % 7, i % 5, i % 4, i % 2), 9).alias("score"))


@_register(f"WITH {FILES} SELECT doc_id, path FROM files WHERE language IN ('en', 'de') AND starts_with(path, 'src/src1') AND NOT contains(repository_id, '7') AND (branch = 'main' OR octet_length(encode(content)) > 2000) AND regexp_matches(path, 'f[0-9]*[02468][.]')")
def cel_filter(spark, sf):
    expression = "language in ['en', 'de'] && file_path.startsWith('src/src1') && !repository.contains('7') && (branch == \"main\" || file_size > 2000) && file_path.matches('f[0-9]*[02468][.]')"
    docs = documents(spark, sf)
    return cel.apply_filter(docs, expression, cel.RESULT, Engine(docs)._variables()).select("doc_id", "path")


@_register("SELECT p_partkey, p_name FROM part WHERE ((p_size > 20 AND starts_with(p_name, 'b')) OR p_type LIKE '%MO') AND p_partkey % 2 = 0")
def cel_symbol_filter(spark, sf):
    columns = {"name": F.col("p_name"), "type": F.col("p_type"), "line": F.col("p_size").cast("bigint"), "refs": F.col("p_partkey").cast("bigint")}
    return cel.apply_filter(_read(spark, sf, "part"), "(line > 20 && name.startsWith('b') || type.endsWith('MO')) && refs % 2 == 0", cel.SYMBOL, columns).select("p_partkey", "p_name")


@_register(f"WITH {FILES} SELECT doc_id, path, language FROM files WHERE repository_id = 'src3' AND branch = 'main' AND starts_with(path, 'src/src3/d') AND language = 'en'")
def store_filter(spark, sf):
    return documents(spark, sf).where(stores.filters(repository="src3", branch="main", path_prefix="src/src3/d", language="en")).select("doc_id", "path", "language")


@_register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_offset(spark, sf):
    return stores.page(_read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], "100", 50)


@_register(f"WITH {FILES}, s AS (SELECT CASE WHEN coalesce(language, '') = '' THEN 'unknown' ELSE language END AS language, octet_length(encode(content)) AS size FROM files) SELECT language, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY ROLLUP (language)")
def index_status(spark, sf):
    return Engine(documents(spark, sf)).status()


ADVISORIES = [
    {"id": "ADV-1", "severity": 4, "patterns": [{"type": "trigram", "query": "password"}, {"type": "regex", "query": "[a-z]+[.][a-z]+@[a-z]+[.][a-z]+"}, {"type": "regex", "query": "ing[.]\\nTh[a-z]+"}], "iocs": []},
    {"id": "ADV-2", "severity": 2, "patterns": [{"type": "structural", "query": "x"}, {"type": "regex", "query": "("}], "iocs": [{"value": "AKIA"}, {"value": "license"}, {"value": "\\E"}]},
    {"id": "ADV-3", "severity": 0, "patterns": [{"type": "trigram", "query": "the"}], "iocs": []},
]
_TESTS = r"tests AS (SELECT * FROM (VALUES ('ADV-1', 4, 'pattern', 'password', false), ('ADV-1', 4, 'pattern', '[a-z]+[.][a-z]+@[a-z]+[.][a-z]+', true), ('ADV-1', 4, 'pattern', 'ing[.]\nTh[a-z]+', true), ('ADV-2', 2, 'ioc', 'AKIA', false), ('ADV-2', 2, 'ioc', 'license', false), ('ADV-2', 2, 'ioc', '\E', false)) t(advisory_id, severity, type, pattern, rx))"
#: Every match of the whole text gets a mark; the lines are counted afterwards.
_MARKED = r"marked AS (SELECT doc_id, path, content, advisory_id, severity, type, string_split(CASE WHEN rx THEN regexp_replace(content, pattern, chr(1) || '\0', 'g') ELSE replace(content, pattern, chr(1) || pattern) END, chr(10)) AS x FROM files, tests WHERE CASE WHEN rx THEN regexp_matches(content, pattern) ELSE contains(content, pattern) END)"
_FOUND = f"{FILES}, {_TESTS}, {_MARKED}, begun AS (SELECT doc_id, path, content, advisory_id, severity, type, unnest(x) AS marks, generate_subscripts(x, 1) AS line FROM marked), found AS (SELECT doc_id, path, content, advisory_id, severity, type, CAST(line AS INT) AS line, unnest(range(length(marks) - length(replace(marks, chr(1), '')))) AS hit FROM begun WHERE contains(marks, chr(1)))"
_SNIPPET = "array_to_string(list_slice(string_split({0}content, chr(10)), greatest({0}line - 2, 1), {0}line + 2), chr(10))"


def _findings(spark, sf):
    return vulnerabilities.scan_content(documents(spark, sf), ADVISORIES, id_col="doc_id")


@_register(f"WITH {_FOUND} SELECT doc_id, advisory_id, severity, type, line, {_SNIPPET.format('')} AS snippet FROM found")
def pattern_scan(spark, sf):
    return _findings(spark, sf)


@_register(f"WITH {_FOUND} SELECT doc_id, advisory_id, severity, type, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, advisory_id ORDER BY line, type) AS n FROM found) WHERE n = 1")
def finding_dedup(spark, sf):
    return vulnerabilities.deduplicate(_findings(spark, sf), "doc_id").drop("snippet")


@_register(f"WITH {_FOUND}, s AS (SELECT CASE severity WHEN 4 THEN 'critical' ELSE 'medium' END AS severity, type, doc_id % 2 = 0 AS fixable, doc_id % 10 AS project FROM found) SELECT 'total' AS dimension, 'all' AS value, count(*) AS n FROM s HAVING count(*) > 0 UNION ALL SELECT 'severity', severity, count(*) FROM s GROUP BY severity UNION ALL SELECT 'type', type, count(*) FROM s GROUP BY type UNION ALL SELECT 'fixable', CAST(fixable AS VARCHAR), count(*) FROM s GROUP BY fixable UNION ALL SELECT 'projects', 'distinct', count(DISTINCT project) FROM s HAVING count(*) > 0")
def finding_summary(spark, sf):
    f = _findings(spark, sf).withColumn("fixable", F.col("doc_id") % 2 == 0).withColumn("project_id", (F.col("doc_id") % 10).cast("string"))
    return vulnerabilities.summarize(f)


_NUM = "(CAST(v[1] AS INT) * 10000 + CAST(v[2] AS INT) * 100 + CAST(v[3] AS INT))"


def _advisories(spark):
    one = lambda name, lo, hi, last: (f"ADV-{name[-2:]}", 3, 7.5, "t", "d", [("npm", name, lo, hi, last), ("npm", name, "", "", "0.1.0")], {name: "9.9.9"}, [])
    schema = "id string, severity int, cvss double, title string, description string, affected array<struct<ecosystem:string,name:string,introduced:string,fixed:string,last_affected:string>>, fixed_versions map<string,string>, fix_templates array<struct<type:string,package:string,pattern:string,replacement:string>>"
    return spark.createDataFrame([one("Brand#11", "1.0.0", "3.2.0", ""), one("Brand#12", "", "", "2.5.1"), one("Brand#13", "2.0.0", "", ""), one("Brand#21", "x.y", "3.0.0", "")], schema)


@_register("WITH d AS (SELECT p_partkey AS part, p_brand AS name, [p_partkey % 5, p_size % 10, p_partkey % 7] AS v, p_partkey % 11 = 0 AS dev FROM part), e AS (SELECT part, name, v[1] || '.' || v[2] || '.' || v[3] AS version, v[1] * 10000 + v[2] * 100 + v[3] AS k FROM d WHERE NOT dev) SELECT part, name, version, 'ADV-' || right(name, 2) AS advisory_id, CASE WHEN name = 'Brand#11' AND k >= 10000 AND k < 30200 THEN '3.2.0' ELSE '9.9.9' END AS fixed_in FROM e WHERE (name IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21') AND k <= 100) OR (name = 'Brand#11' AND k >= 10000 AND k < 30200) OR (name = 'Brand#12' AND k <= 20501) OR (name = 'Brand#13' AND k >= 20000)")
def dependency_range_join(spark, sf):
    k = F.col("p_partkey")
    deps = _read(spark, sf, "part").select(k.alias("part"), F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.concat_ws(".", (k % 5).cast("string"), (F.col("p_size") % 10).cast("string"), (k % 7).cast("string")).alias("version"), (k % 11 == 0).alias("dev"))
    return vulnerabilities.scan_dependencies(deps, _advisories(spark)).select("part", "name", "version", "advisory_id", "fixed_in")


@_register("WITH v AS (SELECT p_partkey AS part, p_partkey % 5 AS a, p_size % 10 AS b, p_partkey % 3 AS p FROM part) SELECT part, CASE WHEN a * 100 + b < 203 THEN -1 WHEN a * 100 + b > 203 THEN 1 WHEN p = 0 THEN 0 ELSE -1 END AS cmp FROM v")
def semver_compare(spark, sf):
    k = F.col("p_partkey")
    v = F.concat(F.lit("v"), (k % 5).cast("string"), F.lit("."), (F.col("p_size") % 10).cast("string"), F.when(k % 3 == 1, "-rc.1").when(k % 3 == 2, "-beta").otherwise(""))
    return _read(spark, sf, "part").select(k.alias("part"), semver.compare(v, F.lit("2.3.0")).alias("cmp"))


@_register("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 5 <= 0 THEN 0 WHEN l_quantity / 5 < 4 THEN 1 WHEN l_quantity / 5 < 7 THEN 2 WHEN l_quantity / 5 < 9 THEN 3 ELSE 4 END AS severity FROM lineitem")
def severity_from_cvss(spark, sf):
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", semver.severity_from_cvss(F.col("l_quantity") / 5).alias("severity"))


@_register(f"WITH {FILES}, l AS (SELECT doc_id, string_split(CASE WHEN content LIKE '%' || chr(10) THEN content[1:-2] ELSE content END, chr(10)) AS x FROM files WHERE content NOT IN ('', chr(10))), w AS (SELECT doc_id, x, unnest(range(0, CAST(ceil(greatest(len(x) - 8, 0) / 6.0) AS BIGINT) + 1)) * 6 + 1 AS a FROM l) SELECT doc_id, CAST(a AS INT) AS start_line, CAST(least(a + 7, len(x)) AS INT) AS end_line, array_to_string(list_slice(x, a, least(a + 7, len(x))), chr(10)) AS chunk FROM w")
def chunk_window(spark, sf):
    return text.chunk_windows(documents(spark, sf).select("doc_id", "content"), "content", 8, 2).drop("content")


@_register("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def dedupe_latest(spark, sf):
    return stores.latest(_read(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "user_id", "event_type", "value")


@_register("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_anti(spark, sf):
    gone = _read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return stores.delete(_read(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@_register("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, 'old' AS created FROM customer WHERE c_custkey % 6 <> 0 UNION ALL SELECT c_custkey, -1.0, 'old' FROM customer WHERE c_custkey % 6 = 0 UNION ALL SELECT -c_custkey - 1, -1.0, 'new' FROM customer WHERE c_custkey % 6 = 0")
def upsert_documents(spark, sf):
    c = _read(spark, sf, "customer")
    now = c.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("c_acctbal"), F.lit("old").alias("created"))
    changed = c.where("c_custkey % 6 = 0").select(F.explode(F.array(F.col("c_custkey"), -F.col("c_custkey") - 1)).alias("c_custkey"), F.lit(-1.0).alias("c_acctbal"), F.lit("new").alias("created"))
    return stores.upsert(now, changed, "c_custkey", "created")


@_register("WITH r AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'al' THEN 0 WHEN starts_with(lower(p_name), 'al') THEN 1 WHEN contains(lower(p_name), 'al') THEN 2 WHEN contains(lower(p_brand), 'al') THEN 3 WHEN contains(lower(p_type), 'al') THEN 4 ELSE 5 END AS rank FROM part) SELECT * FROM r WHERE rank < 5")
def symbol_search_rank(spark, sf):
    r = _read(spark, sf, "part").select("p_partkey", "p_name", stores.symbol_rank("al", F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("rank"))
    return r.where("rank < 5")


@_register(f"WITH {FILES} SELECT doc_id, path FROM files WHERE regexp_matches(path, '^src/src1[^/]*/d[2-4]/f[^/]*\\.en$')")
def path_glob(spark, sf):
    return documents(spark, sf).where(F.col("path").rlike(stores.glob_to_regex("src/src1*/d[2-4]/f*.en"))).select("doc_id", "path")


@_register("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1 FROM documents")
def checksums(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"))


@_register(f"WITH {FILES} SELECT doc_id, coalesce(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '')[1], '') AS first_line, coalesce(string_split(content, chr(10))[2], '') AS second_line FROM files")
def line_pick(spark, sf):
    c = F.col("content")
    return documents(spark, sf).select("doc_id", text.first_nonempty_line(c).alias("first_line"), text.line_at(c, 2).alias("second_line"))


FUZZY = "alrd"


def _fuzzy_sql(greedy: bool) -> str:
    """The alignment's recurrence, a column of the text at a time, with a set of state columns for each pattern character."""
    n = len(FUZZY)
    white = "chr(9), chr(10), chr(11), chr(12), chr(13), ' '"
    kind = f"CASE WHEN c IN ({white}) THEN 0 WHEN c IN ('/', ',', ':', ';', '|') THEN 2 WHEN c BETWEEN 'a' AND 'z' THEN 3 WHEN c BETWEEN 'A' AND 'Z' THEN 4 WHEN c BETWEEN '0' AND '9' THEN 6 ELSE 1 END"
    bonus = "CASE WHEN k[j] >= 2 AND coalesce(k[j - 1], 0) = 0 THEN 10 WHEN k[j] >= 2 AND k[j - 1] = 2 THEN 9 WHEN k[j] >= 2 AND k[j - 1] = 1 THEN 8 WHEN (k[j - 1] = 3 AND k[j] = 4) OR (k[j - 1] <> 6 AND k[j] = 6) THEN 7 WHEN k[j] = 1 OR k[j] = 2 THEN 8 WHEN k[j] = 0 THEN 10 ELSE 0 END"
    firsts, at = [], "0"
    for i, c in enumerate(FUZZY):
        find = f"(CASE WHEN instr(substring(t, {at} + 1), '{c}') > 0 THEN {at} + instr(substring(t, {at} + 1), '{c}') ELSE NULL END)"
        firsts.append((f"f{i}", find))
        at = f"f{i}"
    ctes = [f"w0 AS (SELECT p_partkey, p_name, lower(p_name) AS t, list_transform(string_split(p_name, ''), lambda c: {kind}) AS k FROM part)"]
    for i, (name, find) in enumerate(firsts):
        ctes.append(f"w{i + 1} AS (SELECT *, CAST({find} AS INT) AS {name} FROM w{i})")
    ctes.append(f"w AS (SELECT *, list_transform(range(1, length(t) + 1), lambda j: {bonus}) AS b, CAST(length(t) + 1 - instr(reverse(t), '{FUZZY[-1]}') AS INT) AS hi FROM w{n} WHERE f{n - 1} IS NOT NULL)")
    if greedy:
        back, at = [], f"f{n - 1} + 1"
        for i in reversed(range(n)):  # the last place of each character before the one that follows it
            back.append(f"s{i}")
            ctes.append(f"v{i} AS (SELECT *, CAST({at} - instr(reverse(substring(t, 1, {at} - 1)), '{FUZZY[i]}') AS INT) AS s{i} FROM {'w' if i == n - 1 else f'v{i + 1}'})")
            at = f"s{i}"
        hit = f"q < {n} AND substring(t, j, 1) = substring('{FUZZY}', q + 1, 1)"
        lead = "CASE WHEN run = 0 THEN b[j] WHEN b[j] >= 8 AND b[j] > lead THEN b[j] ELSE lead END"
        gain = f"CASE WHEN run = 0 THEN b[j] ELSE greatest(b[j], 4, {lead}) END"
        ctes.append(f"walk AS (SELECT p_partkey, p_name, t, b, s0, f{n - 1} AS stop, s0 AS j, 0 AS q, 0 AS run, 0 AS lead, false AS gap, 0 AS score FROM v0 UNION ALL SELECT p_partkey, p_name, t, b, s0, stop, j + 1, CASE WHEN {hit} THEN q + 1 ELSE q END, CASE WHEN {hit} THEN run + 1 ELSE 0 END, CASE WHEN {hit} THEN {lead} ELSE 0 END, NOT ({hit}), score + CASE WHEN {hit} THEN 16 + ({gain}) * CASE WHEN q = 0 THEN 2 ELSE 1 END WHEN gap THEN -1 ELSE -3 END FROM walk WHERE j <= stop)")
        return "WITH RECURSIVE " + ", ".join(ctes) + ' SELECT p_partkey, p_name, s0 - 1 AS "start", stop AS "end", score FROM walk WHERE j = stop + 1'
    state, step = [], []
    for i, c in enumerate(FUZZY):
        hit, live = f"substring(t, j, 1) = '{c}'", f"j >= f{i}"
        skip = f"CASE WHEN j = f0 THEN 0 WHEN g{i} THEN h{i} - 1 ELSE h{i} - 3 END"
        if i == 0:
            h, r, g = f"CASE WHEN {hit} THEN 16 + 2 * b[j] ELSE greatest({skip}, 0) END", f"CASE WHEN {hit} THEN 1 ELSE 0 END", f"NOT ({hit})"
        else:
            length, head = f"(r{i - 1} + 1)", f"b[j - r{i - 1}]"
            fresh = f"({length} > 1 AND b[j] >= 8 AND b[j] > {head})"
            lead = f"CASE WHEN {length} > 1 AND NOT {fresh} THEN greatest(b[j], 4, {head}) ELSE b[j] END"
            base = f"(h{i - 1} + 16)"
            lost = f"({base} + {lead} < {skip})"
            take = f"CASE WHEN NOT ({hit}) OR j = f0 THEN 0 WHEN {lost} THEN {base} + b[j] ELSE {base} + {lead} END"
            h, r, g = f"greatest({take}, {skip}, 0)", f"CASE WHEN NOT ({hit}) OR j = f0 OR {lost} THEN 0 WHEN {fresh} THEN 1 ELSE {length} END", f"{take} < {skip}"
        state += [f"0 AS h{i}", f"0 AS r{i}", f"false AS g{i}"]
        step += [f"CASE WHEN {live} THEN {h} ELSE 0 END", f"CASE WHEN {live} THEN {r} ELSE 0 END", f"CASE WHEN {live} THEN {g} ELSE g{i} END"]
    own = "p_partkey, p_name, t, b, hi, " + ", ".join(f"f{i}" for i in range(n))
    ctes.append(f"dp AS (SELECT {own}, f0 AS j, {', '.join(state)} FROM w UNION ALL SELECT {own}, j + 1, {', '.join(step)} FROM dp WHERE j <= hi)")
    return "WITH RECURSIVE " + ", ".join(ctes) + f', best AS (SELECT p_partkey, p_name, max(h{n - 1}) AS score, CAST(arg_max(j, (h{n - 1}, -j)) - 1 AS INT) AS "end" FROM dp GROUP BY p_partkey, p_name) SELECT p_partkey, p_name, "end", score FROM best WHERE score > 0'


@_register(_fuzzy_sql(False))
def fuzzy_v2(spark, sf):
    return search.fuzzy_search(_read(spark, sf, "part"), FUZZY, "p_partkey", "p_name").select("p_partkey", "p_name", "end", "score")


@_register(_fuzzy_sql(True))
def fuzzy_v1(spark, sf):
    return search.fuzzy_search(_read(spark, sf, "part"), FUZZY, "p_partkey", "p_name", greedy=True).drop("positions")


_EMBED = "tok AS (SELECT doc_id, unnest(CASE WHEN len(regexp_extract_all(lower(content), '[a-z0-9_-]+')) > 0 THEN regexp_extract_all(lower(content), '[a-z0-9_-]+') WHEN trim(content) = '' THEN [] ELSE [trim(lower(content))] END) AS t FROM files), cnt AS (SELECT doc_id, t, sha1(t) AS h, count(*) AS n FROM tok GROUP BY doc_id, t), cell AS (SELECT doc_id, CAST('0x' || h[1:2] AS INT) % 64 AS place, sum(n * CASE WHEN CAST('0x' || h[3:4] AS INT) % 2 = 1 THEN -1 ELSE 1 END * greatest(strlen(t) / 8.0, 0.5)) AS v FROM cnt GROUP BY doc_id, place), m AS (SELECT doc_id, map_from_entries(list({{'k': place, 'v': v}})) AS m, sqrt(sum(v * v)) AS norm FROM cell GROUP BY doc_id), emb AS (SELECT f.doc_id, list_transform(range(0, 64), lambda i: CASE WHEN coalesce(norm, 0) = 0 THEN 0.0 ELSE coalesce(m[CAST(i AS INT)], 0.0) / norm END) AS v FROM files f LEFT JOIN m ON f.doc_id = m.doc_id)"


@_register(f"WITH {FILES}, {_EMBED.replace('{{', '{').replace('}}', '}')} SELECT doc_id, CAST(i AS INT) AS place, round(v[i + 1], 9) AS value FROM emb, range(0, 64) r(i) WHERE round(v[i + 1], 9) <> 0")
def hash_embed(spark, sf):
    v = documents(spark, sf).select("doc_id", F.posexplode(text.hash_embedding(F.col("content"))).alias("place", "value"))
    return v.select("doc_id", "place", F.round("value", 9).alias("value")).where("value <> 0")


_FUNCTIONS = "src AS (SELECT doc_id, list_transform(string_split(CASE WHEN content LIKE '%' || chr(10) THEN content[1:-2] ELSE content END, chr(10)), lambda x, i: CASE WHEN i % 5 = 4 THEN 'def f' || CAST(i - 1 AS VARCHAR) || '(): ' || x ELSE x END) AS x FROM files WHERE content NOT IN ('', chr(10)))"


@_register(f"WITH {FILES}, {_FUNCTIONS}, b AS (SELECT doc_id, x, list_concat(CASE WHEN len(x) > 0 AND NOT starts_with(x[1], 'def') THEN [1] ELSE [] END, list_filter(range(1, len(x) + 1), lambda i: i % 5 = 4)) AS s FROM src), c AS (SELECT doc_id, x, unnest(s) AS a, unnest(list_concat(s[2:], [len(x) + 1])) - 1 AS e FROM b) SELECT doc_id, CAST(a AS INT) AS start_line, CAST(e AS INT) AS end_line, array_to_string(x[a:e], chr(10)) AS chunk FROM c WHERE regexp_matches(array_to_string(x[a:e], chr(10)), '[^\\s]')")
def chunk_function(spark, sf):
    """Texts whose every fifth line is made the head of a function."""
    lines = F.transform(text.source_lines(F.col("content")), lambda x, i: F.when(i % 5 == 3, F.concat(F.lit("def f"), i.cast("string"), F.lit("(): "), x)).otherwise(x))
    docs = documents(spark, sf).where(~F.col("content").isin("", "\n")).select("doc_id", F.array_join(lines, "\n").alias("content"))
    return text.chunk_functions(docs, "content").drop("content")


_ASK = text.embed_text(WORD + " and the")
_ASKS = "[" + ", ".join(f"{x!r}::DOUBLE" for x in _ASK) + "]"
_BOTH = f"lex AS (SELECT doc_id, 1.0 AS score FROM files WHERE contains(content, '{WORD}') ORDER BY doc_id LIMIT 20), sem AS (SELECT doc_id, round(list_sum(list_transform(range(1, 65), lambda i: v[i] * ({_ASKS})[i])) / CASE WHEN list_sum(list_transform(v, lambda x: x * x)) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(v, lambda x: x * x))) END, 12) AS score FROM emb ORDER BY score DESC, doc_id LIMIT 20), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM lex UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM sem)"


@_register(f"WITH {FILES}, {_EMBED.replace('{{', '{').replace('}}', '}')}, {_BOTH} SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM ranked GROUP BY doc_id ORDER BY sum(1.0 / (60 + r)) DESC, doc_id LIMIT 20")
def engine_hybrid(spark, sf):
    """Both backends over the whole table, fused; the limit is the search's own."""
    docs = documents(spark, sf)
    vec = docs.select("doc_id", text.hash_embedding(F.col("content")).alias("values"))
    return Engine(docs, embeddings=vec, embed=lambda q: text.embed_text(q + " and the")).search(WORD, limit=20).select("doc_id", F.round("score", 9).alias("score"))


@_register("WITH n AS (SELECT count(*) AS d FROM documents) SELECT type, label, n FROM (SELECT 'vertex' AS type, 'metaData' AS label, 1 AS n UNION ALL SELECT 'vertex', 'project', 1 UNION ALL SELECT 'vertex', 'document', d FROM n UNION ALL SELECT 'vertex', 'range', 3 * d FROM n UNION ALL SELECT 'vertex', 'definitionResult', 3 * d FROM n UNION ALL SELECT 'edge', 'contains', 4 * d FROM n UNION ALL SELECT 'edge', 'textDocument/definition', 3 * d FROM n UNION ALL SELECT 'edge', 'item', 3 * d FROM n)")
def symbol_graph(spark, sf):
    """Index graph of the DDL that the table names of the corpus make, one statement a document."""
    src = F.concat(F.lit("-- "), F.col("source"), F.lit("\nCREATE TABLE s."), F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(" (id int, body text, PRIMARY KEY (id));"))
    files = _read(spark, sf, "documents").select(F.concat(F.lit("ddl/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("path"), src.alias("content"))
    return symbols.graph_stats(symbols.index_graph(symbols.extract_symbols(files)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quarry.plans import projects  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)

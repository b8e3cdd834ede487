"""Dependency and content scans against advisories, findings and their summaries.

Advisories: id, severity (0 to 4), cvss, title, description,
``affected array<struct<ecosystem, name, introduced, fixed, last_affected>>``,
``patterns array<struct<type, query>>``, ``iocs array<struct<value>>``,
``fixed_versions map``, ``fix_templates array<struct<package, …>>``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import regex, semver, text
from quarry.sources import lockfiles

LOW = 1
MANY = 64
SEVERITIES = ("unknown", "low", "medium", "high", "critical")


def sanitize(part: Column) -> Column:
    """The text as part of an id."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(part), r"[/\\ :@]", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "unknown").otherwise(clean)


def scan_dependencies(deps: DataFrame, advisories: DataFrame, min_severity: int = LOW, include_dev: bool = False) -> DataFrame:
    """Findings of an equi-join on package with the version range as its residual.

    ``deps`` has ecosystem, name, version, dev and whatever else; all of it is
    kept. An advisory is reported once for a dependency, by its first affected
    entry that holds. Which side is broadcast is left to the sizes Spark sees.
    """
    kept = deps if include_dev else deps.where(~F.coalesce(F.col("dev"), F.lit(False)))
    chosen = advisories.where(F.col("severity") >= min_severity).select(F.col("id").alias("advisory_id"), "severity", "cvss", "title", "description", "fixed_versions", "fix_templates", "affected")
    # an advisory meets a dependency once, by the package that its entries share; of these the first that holds is taken from the array
    packages = F.array_distinct(F.transform(F.filter("affected", lambda e: e["ecosystem"].isNotNull() & e["name"].isNotNull()), lambda e: F.struct(e["ecosystem"].alias("__ecosystem"), e["name"].alias("__name"))))
    entries = chosen.select("*", F.inline(packages))
    mine = F.filter("affected", lambda e: (e["ecosystem"] == F.col("__ecosystem")) & (e["name"] == F.col("__name")) & semver.within(F.col("version"), e["introduced"], e["fixed"], e["last_affected"]))
    hits = kept.join(entries, (F.col("ecosystem") == F.col("__ecosystem")) & (F.col("name") == F.col("__name")))
    single = hits.withColumn("a", F.get(mine, F.lit(0))).where("a IS NOT NULL")
    by_name = F.coalesce(F.col("fixed_versions")[F.col("name")], F.lit(""))
    fixed = F.when(F.coalesce(F.col("a.fixed"), F.lit("")) == "", by_name).otherwise(F.col("a.fixed"))
    template = F.get(F.filter("fix_templates", lambda t: (F.coalesce(t["package"], F.lit("")) == "") | (t["package"] == F.col("name"))), F.lit(0))
    return single.select(
        F.concat(F.lit("f-"), sanitize(F.col("advisory_id")), F.lit("-"), sanitize(F.col("name"))).alias("id"),
        "advisory_id", "severity", "cvss", "title", "description", F.lit("dependency").alias("type"),
        *kept.columns, fixed.alias("fixed_in"), (fixed != "").alias("fixable"), template.alias("fix_template"),
    )


#: A noncharacter that is put before every match; texts that hold it have it taken for another one.
_MARK = "\uffff"


def _tests(advisories: list[dict], min_severity: int) -> list[tuple[str, int, str, str, bool]]:
    """(advisory, severity, type, text, whether it is an expression) of every pattern and indicator that can be tested."""
    out = []
    for a in advisories:
        if a["severity"] < min_severity:
            continue
        for p in a.get("patterns", ()):
            if p["type"] == "trigram" and p["query"]:
                out.append((a["id"], a["severity"], "pattern", p["query"], False))
            elif p["type"] == "regex":
                try:
                    regex.plan(p["query"])
                    out.append((a["id"], a["severity"], "pattern", regex.to_java(p["query"]), True))
                except ValueError:
                    continue
        out += [(a["id"], a["severity"], "ioc", i["value"], False) for i in a.get("iocs", ()) if i["value"]]
    return out


def scan_content(docs: DataFrame, advisories: list[dict], min_severity: int = LOW, id_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, advisory_id, severity, type, line, snippet): a row for every place of a pattern or an indicator.

    The patterns are the driver's own list: they become one disjunction in the
    scan, and only documents that hold any are looked at closer. A pattern is
    matched against the whole text, so that it may run over line ends; its line
    is that of its first character. Matches count without overlap; a regular
    expression that doesn't parse and structural patterns are passed over.
    """
    tests = _tests(advisories, min_severity)
    content = F.col(text_col)
    if len(tests) > MANY:
        return _scan_many(docs, tests, id_col, text_col)
    if not tests:
        return docs.limit(0).select(F.col(id_col), *[F.lit(None).cast(t).alias(n) for n, t in (("advisory_id", "string"), ("severity", "int"), ("type", "string"), ("line", "int"), ("snippet", "string"))])
    some = docs.where(reduce(lambda a, b: a | b, [content.rlike(t) if is_regex else content.contains(t) for *_, t, is_regex in tests]))
    rows = some.select(F.col(id_col), F.translate(content, _MARK, "\ufffe").alias("__t")).withColumn("__l", text.lines(F.col("__t")))

    def hits(advisory: str, severity: int, kind: str, wanted: str, is_regex: bool) -> Column:
        """A struct for every line on which matches begin, with their number."""
        marked = F.regexp_replace("__t", wanted, _MARK + "$0") if is_regex else F.replace("__t", F.lit(wanted), F.lit(_MARK + wanted))
        begun = F.transform(text.lines(marked), lambda x, i: F.struct(F.lit(advisory).alias("advisory_id"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"), (i + 1).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(_MARK), F.lit("")))).alias("n")))
        return F.filter(begun, lambda h: h["n"] > 0)

    snippet = lambda h: F.array_join(F.slice("__l", F.greatest(h["line"] - 2, F.lit(1)), h["line"] + 2 - F.greatest(h["line"] - 2, F.lit(1)) + 1), "\n")
    every = F.transform(F.flatten(F.array(*[hits(*t) for t in tests])), lambda h: F.struct(h["advisory_id"].alias("advisory_id"), h["severity"].alias("severity"), h["type"].alias("type"), h["line"].alias("line"), snippet(h).alias("snippet"), F.sequence(F.lit(1), h["n"]).alias("each")))
    found = rows.select(F.col(id_col), F.inline(every))
    return found.withColumn("each", F.explode("each")).drop("each")


def _scan_many(docs: DataFrame, tests: list[tuple[str, int, str, str, bool]], id_col: str, text_col: str) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    words = sorted({t for *_, t, is_regex in tests if not is_regex})
    names = ["advisory_id", "severity", "type", "line", "snippet"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex as engine

        literals: dict[str, list[tuple]] = {}
        for a, s, k, t, is_regex in tests:
            if not is_regex:
                literals.setdefault(t, []).append((a, s, k))
        compiled = [((a, s, k), engine.compile(t.removeprefix("(?d)"), engine.V0)) for a, s, k, t, is_regex in tests if is_regex]
        find = _matcher(words)
        for b in batches:
            at, rows = [], []
            for i, body in enumerate(b.column(1).to_pylist()):
                hits = [(start, of) for word, start in find(body) for of in literals[word]] if body else []
                hits += [(m.start(), of) for of, p in compiled for m in p.finditer(body)] if body else []
                if not hits:
                    continue
                lines, ends = body.split("\n"), [m.start() for m in re.finditer("\n", body)]
                for start, of in hits:
                    n = bisect_left(ends, start)
                    rows.append((*of, n + 1, "\n".join(lines[max(0, n - 2) : n + 3])))
                    at.append(i)
            out = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *out], [id_col, *names])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, advisory_id string, severity int, type string, line int, snippet string")


def _matcher(words: list[str]) -> Callable[[str], Iterator[tuple[str, int]]]:
    """(word, start) of every occurrence of every word, those of one word without overlap."""
    try:
        import ahocorasick
    except ImportError:  # one search a word
        return lambda body: ((w, m.start()) for w in words for m in re.finditer(re.escape(w), body))
    tree = ahocorasick.Automaton()
    for w in words:
        tree.add_word(w, w)
    if words:
        tree.make_automaton()

    def find(body: str) -> Iterator[tuple[str, int]]:
        free: dict[str, int] = {}
        for end, w in tree.iter(body) if words else ():
            start = end + 1 - len(w)
            if start >= free.get(w, 0):
                free[w] = end + 1
                yield w, start

    return find


def scan_project(files: DataFrame, advisories: DataFrame, patterns: list[dict], min_severity: int = LOW, include_dev: bool = False) -> DataFrame:
    """Findings of a whole project (path, content): its lock files' dependencies and its content, one for an advisory, package and file.

    ``advisories`` is the table that dependencies are joined with, ``patterns``
    the driver's list of the same advisories' content patterns.
    """
    columns = ["advisory_id", "severity", "type", "path", "package", "version", "fixed_in", "line", "snippet"]
    deps = scan_dependencies(lockfiles.dependencies(files), advisories, min_severity, include_dev)
    deps = deps.select("advisory_id", "severity", "type", "path", F.col("name").alias("package"), "version", "fixed_in", F.lit(0).alias("line"), F.lit("").alias("snippet"))
    places = scan_content(files, patterns, min_severity)
    places = places.select("advisory_id", "severity", "type", "path", F.lit("").alias("package"), F.lit("").alias("version"), F.lit("").alias("fixed_in"), "line", "snippet")
    return deduplicate(deps.unionByName(places), "path", "package").select(*columns)


def deduplicate(findings: DataFrame, path_col: str = "path", package_col: str | None = None) -> DataFrame:
    """One finding for an advisory, package and file: that of the lowest line that isn't 0, then of the first version as text."""
    key = ["advisory_id", path_col, *([package_col] if package_col else [])]
    # dependencies stand on no line, so that only the version tells those of one package apart
    ties = [F.col(c) for c in ("version", "fixed_in", "severity") if c in findings.columns]
    order = [F.coalesce(F.col("line"), F.lit(0)) == 0, F.col("line"), F.col("type"), *ties, F.col("snippet")]
    return findings.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def severity_order(path_col: str = "path") -> list[Column]:
    return [F.desc("severity"), F.asc("advisory_id"), F.asc(path_col), F.asc("line"), F.asc("type")]


def summarize(findings: DataFrame, project_col: str = "project_id") -> DataFrame:
    """(dimension, value, n): totals by severity and type, fixable or not, and distinct projects, from one aggregation."""
    f = findings.select(F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity").cast("int") + 1).alias("severity"), "type", F.coalesce("fixable", F.lit(False)).alias("fixable"), F.when(F.col(project_col) != "", F.col(project_col)).alias("project"))
    sets = f.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value"), p.alias("project")) for d, v, p in (
        ("total", F.lit("all"), F.lit(None).cast("string")), ("severity", F.col("severity"), F.lit(None).cast("string")), ("type", F.col("type"), F.lit(None).cast("string")),
        ("fixable", F.col("fixable").cast("string"), F.lit(None).cast("string")), ("projects", F.lit("distinct"), F.col("project").cast("string")),
    )])).alias("s")).select("s.*")
    return sets.groupBy("dimension", "value").agg(F.count("*").alias("rows"), F.count_distinct("project").alias("p")).select("dimension", "value", F.when(F.col("dimension") == "projects", F.col("p")).otherwise(F.col("rows")).alias("n"))

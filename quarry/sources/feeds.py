"""Advisories of three public feeds, from JSON lines to one schema.

``normalize`` takes a string column of JSON; parsing and mapping stay in the
JVM. A text that isn't JSON of that feed gives a row without an id, which is
dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import semver

AFFECTED = "array<struct<ecosystem:string,name:string,introduced:string,fixed:string,last_affected:string,range:string>>"
OSV = "id string, aliases array<string>, summary string, details string, published string, modified string, withdrawn string, severity array<struct<type:string,score:string>>, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,lastAffected:string,last_affected:string>>>>>>, references array<struct<type:string,url:string>>, database_specific struct<severity:string>"
GHSA = "ghsaId string, summary string, description string, severity string, publishedAt string, updatedAt string, withdrawnAt string, cvss struct<score:double>, identifiers array<struct<type:string,value:string>>, references array<struct<url:string>>, vulnerabilities struct<nodes:array<struct<package:struct<ecosystem:string,name:string>,vulnerableVersionRange:string,firstPatchedVersion:struct<identifier:string>>>>"
NVD = "cve struct<id:string,published:string,lastModified:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double>>>,cvssMetricV30:array<struct<cvssData:struct<baseScore:double>>>,cvssMetricV2:array<struct<cvssData:struct<baseScore:double>>>>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string,versionStartIncluding:string,versionEndExcluding:string,versionEndIncluding:string>>>>>>,references:array<struct<url:string>>>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _time(c: Column) -> Column:
    return F.try_to_timestamp(F.nullif(c, F.lit("")))


def _label(label: Column, otherwise: Column) -> Column:
    s = F.lower(label)
    return F.when(s == "low", 1).when(s.isin("medium", "moderate"), 2).when(s == "high", 3).when(s == "critical", 4).otherwise(otherwise)


def _urls(c: Column) -> Column:
    return F.coalesce(F.filter(F.transform(c, lambda r: _text(r["url"])), lambda u: u != ""), F.array().cast("array<string>"))


def _fixed(affected: Column) -> Column:
    """Fixed version by package; the last entry of a package counts."""
    known = F.filter(affected, lambda a: (a["name"] != "") & (a["fixed"] != ""))
    names = F.array_distinct(F.transform(known, lambda a: a["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(known, lambda a: a["name"] == n), -1)["fixed"]))


def _package(ecosystem: Column, name: Column, introduced: Column, fixed: Column, last: Column, text: Column | None = None) -> Column:
    i, f, e = _text(introduced), _text(fixed), _text(last)
    return F.struct(semver.ecosystem(_text(ecosystem)).alias("ecosystem"), _text(name).alias("name"), i.alias("introduced"), f.alias("fixed"), e.alias("last_affected"), (semver.range_text(i, f, e) if text is None else _text(text)).alias("range"))


def cvss(score: Column) -> Column:
    """A plain number, or the score segment of a 3.1 vector."""
    return F.coalesce(score.try_cast("double"), F.regexp_extract(score, r"^CVSS:3\.1/(?:.*/)?SCORE:([0-9.]+)", 1).try_cast("double"))


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumn("affected", F.col("affected").cast(AFFECTED)).withColumn("fixed_versions", _fixed(F.col("affected"))).where("id IS NOT NULL")


def osv(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """All ranges of an entry collapse to the first bound of each sort."""
    r = rows.select(F.from_json(json_col, OSV).alias("j")).select("j.*")

    def entry(a: Column) -> Column:
        events = F.flatten(F.transform(F.coalesce(a["ranges"], F.array().cast("array<struct<type:string,events:array<struct<introduced:string,fixed:string,lastAffected:string,last_affected:string>>>>")), lambda x: x["events"]))
        first = lambda f: F.get(F.filter(F.transform(events, lambda e: _text(f(e))), lambda v: v != ""), F.lit(0))
        return _package(a["package"]["ecosystem"], a["package"]["name"], first(lambda e: e["introduced"]), first(lambda e: e["fixed"]), first(lambda e: F.coalesce(e["lastAffected"], e["last_affected"])))

    score = F.get(F.filter(F.transform(F.coalesce("severity", F.array().cast("array<struct<type:string,score:string>>")), lambda s: cvss(s["score"])), lambda v: v.isNotNull()), F.lit(0))
    label = _label(F.col("database_specific.severity"), F.lit(None).cast("int"))
    score0 = F.when(label.isNotNull(), 0.0).otherwise(F.coalesce(score, F.lit(0.0)))
    return _finish(r.select("id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.lit("osv").alias("source"), F.coalesce(label, semver.severity_from_cvss(score)).alias("severity"), score0.alias("cvss"), _text(F.col("summary")).alias("title"), _text(F.col("details")).alias("description"), _time(F.col("published")).alias("published"), _time(F.col("modified")).alias("modified"), _time(F.col("withdrawn")).alias("withdrawn"), F.transform(F.col("affected"), entry).alias("affected"), _urls(F.col("references")).alias("references")))


def ghsa(rows: DataFrame, json_col: str = "value") -> DataFrame:
    r = rows.select(F.from_json(json_col, GHSA).alias("j")).select("j.*")
    none = F.lit("")
    score = F.coalesce("cvss.score", F.lit(0.0))
    aliases = F.filter(F.transform(F.coalesce("identifiers", F.array().cast("array<struct<type:string,value:string>>")), lambda i: _text(i["value"])), lambda v: (v != "") & (v != F.col("ghsaId")))
    entry = lambda n: _package(n["package"]["ecosystem"], n["package"]["name"], none, n["firstPatchedVersion"]["identifier"], none, n["vulnerableVersionRange"])
    return _finish(r.select(F.col("ghsaId").alias("id"), aliases.alias("aliases"), F.lit("ghsa").alias("source"), _label(F.col("severity"), semver.severity_from_cvss(score)).alias("severity"), score.alias("cvss"), _text(F.col("summary")).alias("title"), _text(F.col("description")).alias("description"), _time(F.col("publishedAt")).alias("published"), _time(F.col("updatedAt")).alias("modified"), _time(F.col("withdrawnAt")).alias("withdrawn"), F.transform("vulnerabilities.nodes", entry).alias("affected"), _urls(F.col("references")).alias("references")))


def nvd(rows: DataFrame, json_col: str = "value") -> DataFrame:
    """Packages come from the product part of vulnerable platform names and have no registry."""
    r = rows.select(F.from_json(json_col, NVD).alias("j")).select("j.cve.*")
    matches = F.flatten(F.flatten(F.transform("configurations", lambda c: F.transform(c["nodes"], lambda n: n["cpeMatch"]))))
    entry = lambda m: _package(F.lit(""), F.get(F.split(m["criteria"], ":"), F.lit(4)), m["versionStartIncluding"], m["versionEndExcluding"], m["versionEndIncluding"])
    metric = lambda k: F.get(F.col(f"metrics.{k}"), F.lit(0))["cvssData"]["baseScore"]
    score = F.coalesce(metric("cvssMetricV31"), metric("cvssMetricV30"), metric("cvssMetricV2"), F.lit(0.0))
    texts = F.coalesce("descriptions", F.array().cast("array<struct<lang:string,value:string>>"))
    text = F.coalesce(F.get(F.filter(texts, lambda d: d["lang"] == "en"), F.lit(0))["value"], F.get(texts, F.lit(0))["value"], F.lit(""))
    return _finish(r.select("id", F.array().cast("array<string>").alias("aliases"), F.lit("nvd").alias("source"), semver.severity_from_cvss(score).alias("severity"), score.alias("cvss"), F.col("id").alias("title"), text.alias("description"), _time(F.col("published")).alias("published"), _time(F.col("lastModified")).alias("modified"), F.lit(None).cast("timestamp").alias("withdrawn"), F.transform(F.filter(matches, lambda m: m["vulnerable"]), entry).alias("affected"), _urls(F.col("references")).alias("references")))

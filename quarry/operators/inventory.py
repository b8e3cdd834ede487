"""Stores of dependencies, advisories and findings across projects, and the scans over them.

Dependency records: project_id, workspace_id, repository, ecosystem, name,
version, lockfile_path, direct, dev, indexed_at. A scan of one advisory, of one
project or of everything is the same join under different conditions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import semver
from quarry.operators import vulnerabilities
from quarry.operators.stores import latest

RECORD_KEY = ("project_id", "ecosystem", "name", "version")
_PLACES = ("project_id", "workspace_id", "repository", "ecosystem", "name", "version", "lockfile_path")


def dependency_order() -> list[Column]:
    """By place and package; direct dependencies before others, development ones after others, then by time."""
    return [*map(F.asc, _PLACES), F.desc("direct"), F.asc("dev"), F.asc("indexed_at")]


def put_dependencies(current: DataFrame, changes: DataFrame) -> DataFrame:
    """One record for a project, package and version: the one indexed last; of equal times that of ``changes``."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest(both, RECORD_KEY, [F.desc("indexed_at"), F.desc("__new"), F.desc("lockfile_path")]).drop("__new")


def query_dependencies(records: DataFrame, ecosystem: str = "", name: str = "", workspace: str = "", project: str = "", direct: bool | None = None, dev: bool | None = None, introduced: str = "", fixed: str = "", last_affected: str = "") -> DataFrame:
    """Records that meet every condition given; a version range holds no record whose version isn't one."""
    out = records
    for column, value in (("ecosystem", ecosystem), ("name", name), ("workspace_id", workspace), ("project_id", project)):
        out = out.where(F.col(column) == value) if value else out
    for column, flag in (("direct", direct), ("dev", dev)):
        out = out.where(F.col(column) == flag) if flag is not None else out
    if introduced or fixed or last_affected:
        out = out.where(semver.within(F.col("version"), F.lit(introduced), F.lit(fixed), F.lit(last_affected)))
    return out


def scan_records(records: DataFrame, advisories: DataFrame, advisory: str = "", project: str = "", workspace: str = "", ecosystem: str = "", min_severity: int = vulnerabilities.LOW, include_dev: bool = False) -> DataFrame:
    """Findings of the records, one for a project, advisory, package and lock file: that of the first record in order.

    Without conditions it scans all projects; ``advisory`` and ``project``
    narrow it before the join.
    """
    if advisory:
        advisories = advisories.where(F.col("id") == advisory)
    some = query_dependencies(records, ecosystem=ecosystem, workspace=workspace, project=project)
    found = vulnerabilities.scan_dependencies(some, advisories, min_severity, include_dev)
    w = Window.partitionBy("project_id", "advisory_id", "name", "lockfile_path").orderBy(*dependency_order())
    first = found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    parts = [F.lit("f"), *[vulnerabilities.sanitize(F.col(c)) for c in ("advisory_id", "project_id", "name", "version", "lockfile_path")]]
    return first.withColumn("id", F.concat_ws("-", *parts))


def put_findings(current: DataFrame, new: DataFrame, projects: DataFrame) -> DataFrame:
    """``current`` with the findings of the scanned ``projects`` (project_id) replaced by ``new``."""
    return current.join(projects.select("project_id").distinct(), "project_id", "left_anti").select(*current.columns).unionByName(new.select(*current.columns))


def count_findings(findings: DataFrame, min_severity: int = 0) -> DataFrame:
    """(n): how many are of this severity at least; 0 counts all."""
    return (findings.where(F.col("severity") >= min_severity) if min_severity else findings).agg(F.count("*").alias("n"))


def advisory_order() -> list[Column]:
    return [F.asc("modified"), F.asc("id")]


def advisories_of(advisories: DataFrame, ecosystem: str, name: str) -> DataFrame:
    """The advisories with an entry for a package."""
    return advisories.where(F.exists("affected", lambda a: (a["ecosystem"] == ecosystem) & (a["name"] == name)))

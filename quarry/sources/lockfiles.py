"""Dependencies of lock files of eight kinds, as a table function over (path, content)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("version", pa.string()), ("ecosystem", pa.string()), ("integrity", pa.string()), ("direct", pa.bool_()), ("dev", pa.bool_())])
Rows = Iterator[dict]


def _row(name: str, version: str, ecosystem: str, integrity: str = "", direct: bool = False, dev: bool = False) -> dict:
    return {"name": name, "version": version, "ecosystem": ecosystem, "integrity": integrity, "direct": direct, "dev": dev}


def _unquote(s: str) -> str:
    return s.strip().strip("\"'")


def npm(text: str) -> Rows:
    data = json.loads(text)
    packages = data.get("packages") or {}
    direct = {*((packages.get("") or {}).get("dependencies") or {}), *(data.get("dependencies") or {})}
    for key in sorted(packages):
        if key:
            p, name = packages[key] or {}, key.removeprefix("node_modules/")
            yield _row(name, p.get("version", ""), "npm", p.get("integrity", ""), name in direct, bool(p.get("dev")))


def _sections(text: str, begins: Callable[[str], bool]) -> Iterator[tuple[str, list[str]]]:
    head, held = None, []
    for line in text.splitlines():
        if begins(line):
            if head is not None:
                yield head, held
            head, held = line, []
        elif head is not None:
            held.append(line)
    if head is not None:
        yield head, held


def yarn(text: str) -> Rows:
    for head, inner in _sections(text, lambda x: bool(x.strip()) and x[0] not in " \t" and x.rstrip().endswith(":")):
        name, at, _ = _unquote(head.strip().removesuffix(":").split(",")[0]).rpartition("@")
        if not at or not name:
            raise ValueError(f"not an entry: {head!r}")
        got = {k: _unquote(x[len(k) + 3 :]) for x in inner for k in ("version", "integrity") if x.startswith(f"  {k} ")}
        if got.get("version"):
            yield _row(name, got["version"], "npm", got.get("integrity", ""))


def pnpm(text: str) -> Rows:
    m = re.search(r"^\s*packages:\s*$(.*?)(?=^\S|\Z)", text, re.M | re.S)
    for head, inner in _sections(m[1] if m else "", lambda x: re.match(r"  \S.*:\s*$", x) is not None):
        key = _unquote(head.strip().removesuffix(":")).removeprefix("/").split("(")[0]
        name, _, version = key.rpartition("@")
        if not name or not version:
            raise ValueError(f"not a package: {head!r}")
        yield _row(name, version, "npm", dev=any(x.strip().rstrip(",") == "dev: true" for x in inner))


def go_sum(text: str) -> Rows:
    seen = set()
    for parts in map(str.split, text.splitlines()):
        if len(parts) == 3 and not parts[1].endswith("/go.mod") and (key := tuple(parts[:2])) not in seen:
            seen.add(key)
            yield _row(parts[0], parts[1], "go", parts[2])


def _toml(text: str) -> Iterator[dict[str, str]]:
    for _, inner in _sections(text, lambda x: x.strip() == "[[package]]"):
        got: dict[str, str] = {}
        for k, sep, v in (x.strip().partition(" = ") for x in inner):
            if sep:
                got[k] = _unquote(v)
        if got.get("name") and got.get("version"):
            yield got


def cargo(text: str) -> Rows:
    for p in _toml(text):
        yield _row(p["name"], p["version"], "cargo", p.get("checksum", ""))


def poetry(text: str) -> Rows:
    for p in _toml(text):
        yield _row(p["name"], p["version"], "pypi", dev=p.get("optional") == "true" or p.get("category") == "dev")


def pip(text: str) -> Rows:
    for line in map(str.strip, text.splitlines()):
        m = re.fullmatch(r"([\w.-]+)\s*([=!~<>]=|[<>])\s*(.+)", line, re.A)
        if m and line[0] not in "#-":
            yield _row(m[1], m[3] if m[2] == "==" else m[2] + m[3], "pypi")


def gemfile(text: str) -> Rows:
    gem = specs = False
    for line in text.splitlines():
        word = line.strip()
        if word == "GEM":
            gem, specs = True, False
        elif word in ("PLATFORMS", "DEPENDENCIES", "BUNDLED WITH"):
            gem = specs = False
        elif word == "specs:":
            specs = specs or (gem and line.startswith("  "))
        elif gem and specs and (m := re.fullmatch(r"\s{4}([^\s(]+) \(([^)]+)\)", line)):
            yield _row(m[1], m[2], "rubygems")


FORMATS: dict[str, Callable[[str], Rows]] = {"package-lock.json": npm, "yarn.lock": yarn, "pnpm-lock.yaml": pnpm, "go.sum": go_sum, "Cargo.lock": cargo, "requirements.txt": pip, "Gemfile.lock": gemfile, "poetry.lock": poetry}


def parse(path: str, text: str) -> list[dict]:
    """The dependencies of one file; raises ValueError for an unknown name or malformed content."""
    how = FORMATS.get(path.rsplit("/", 1)[-1])
    if how is None:
        raise ValueError(f"not a lock file: {path}")
    return list(how(text))


def dependencies(files: DataFrame, path_col: str = "path", text_col: str = "content") -> DataFrame:
    """(path, name, version, ecosystem, integrity, direct, dev); other files never reach Python, malformed ones give nothing."""
    names = "|".join(n.replace(".", r"\.") for n in FORMATS)
    slim = files.select(F.col(path_col).alias("path"), F.col(text_col).cast("string").alias("content")).where(F.col("path").rlike(f"(^|/)({names})$") & F.col("content").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [{"path": p} | r for r in parse(p, t)]
                except (ValueError, AttributeError, TypeError):
                    continue
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return slim.mapInArrow(run, "path string, name string, version string, ecosystem string, integrity string, direct boolean, dev boolean")

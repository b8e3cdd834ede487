"""Unified diffs, and patches that fix findings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Hunk:
    old_start: int
    old_count: int
    new_start: int
    new_count: int
    lines: list[tuple[str, str]] = field(default_factory=list)  # ("+", "-" or " ", text)


@dataclass
class FilePatch:
    path: str
    hunks: list[Hunk] = field(default_factory=list)
    created: bool = False
    deleted: bool = False


def format_diff(p: FilePatch) -> str:
    out = [f"--- {'/dev/null' if p.created else 'a/' + p.path}", f"+++ {'/dev/null' if p.deleted else 'b/' + p.path}"]
    for h in p.hunks:
        out.append(f"@@ -{h.old_start},{h.old_count} +{h.new_start},{h.new_count} @@")
        out += [op + text for op, text in h.lines]
    return "\n".join(out) + "\n"


def format_patch(advisory: str, description: str, files: list[FilePatch]) -> str:
    return f"# Advisory: {advisory}\n# Description: {description}\n" + "".join("\n" + format_diff(f) for f in files)


_HEADER = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_diff(text: str) -> FilePatch:
    """The inverse of :func:`format_diff`; raises ValueError."""
    out, seen = FilePatch(""), set()
    for line in text.split("\n"):
        if not line or line[0] == "#" or line.startswith("\\ No newline"):
            continue
        if line[:4] in ("--- ", "+++ "):
            seen.add(line[0])
            name = line[4:].strip()
            if name != "/dev/null":
                out.path = out.path or re.sub("^(a/)?(b/)?", "", name)
            elif line[0] == "-":
                out.created = True
            else:
                out.deleted = True
        elif line.startswith("@@ "):
            m = _HEADER.match(line)
            if not m:
                raise ValueError(f"not a hunk: {line!r}")
            a, b, c, d = (1 if g is None else int(g) for g in m.groups())
            out.hunks.append(Hunk(a, b, c, d))
        elif not out.hunks or line[0] not in " +-":
            raise ValueError(f"not a line of a hunk: {line!r}")
        else:
            out.hunks[-1].lines.append((line[0], line[1:]))
    if seen != {"-", "+"} or not out.path:
        raise ValueError("a diff names its files")
    return out


def _lines(text: str) -> list[str]:
    return text.removesuffix("\n").split("\n") if text else []


def _swap(content: str, pattern: str, current: str, fixed: str) -> Hunk | None:
    p = re.compile(pattern)
    for n, line in enumerate(_lines(content), 1):
        m = p.fullmatch(line)
        if m and current in ("", m[2]):
            return Hunk(n, 1, n, 1, [("-", line), ("+", m[1] + fixed + m[3])])
    return None


def _cargo(content: str, package: str, current: str, fixed: str) -> Hunk | None:
    found = _swap(content, rf'(\s*{re.escape(package)}\s*=\s*")(.*?)(".*)', current, fixed)
    rows, inside = _lines(content), False
    for n, line in enumerate([] if found else rows, 1):
        word = line.strip()
        inside = word == f'name = "{package}"' or (inside and word != "")
        m = re.fullmatch(r'(\s*version = ")(.*)("\s*)', line)
        if inside and m and current in ("", m[2]):
            return Hunk(n, 1, n, 1, [("-", line), ("+", line[: len(line) - len(line.lstrip())] + f'version = "{fixed}"')])
    return found


#: How each manifest spells a pinned version, and what to run afterwards.
MANIFESTS: dict[str, tuple[Callable[[str, str, str, str], Hunk | None], str]] = {
    **dict.fromkeys(("package.json", "package-lock.json"), (lambda t, p, c, f: _swap(t, rf'(\s*"{re.escape(p)}"\s*:\s*")(.*?)("\s*,?\s*)', c, f), "npm install")),
    **dict.fromkeys(("Cargo.toml", "Cargo.lock"), (_cargo, "cargo update -p {package} --precise {fixed}")),
    "requirements.txt": (lambda t, p, c, f: _swap(t, rf"(\s*{re.escape(p)}\s*==\s*)(\S+)(\s*)", c, f), "pip install -r requirements.txt"),
    **dict.fromkeys(("go.mod", "go.sum"), (lambda t, p, c, f: _swap(t, rf"(\s*{re.escape(p)}\s+)(\S+)(\s*)", c, f), "go mod tidy")),
}


@dataclass
class Patch:
    finding_id: str
    advisory_id: str
    description: str
    files: list[FilePatch]
    commands: list[str]
    confidence: str


def bump(finding: dict, content: str) -> Patch | None:
    """Raise a pinned dependency to the fixed version; None where this can't be done."""
    fixed, path = finding.get("fixed_in") or "", finding.get("path") or ""
    how = MANIFESTS.get(path.rsplit("/", 1)[-1])
    if finding.get("type") != "dependency" or not fixed or how is None:
        return None
    package = finding["name"]
    hunk = how[0](content, package, finding.get("version") or "", fixed)
    if hunk is None:
        return None
    about = finding.get("description") or f"Update {package} to {fixed}"
    return Patch(finding["id"], finding["advisory_id"], about, [FilePatch(path, [hunk])], [how[1].format(package=package, fixed=fixed)], "high")


def replace(finding: dict, content: str) -> Patch | None:
    """Put a template's replacement in place of its pattern."""
    t, path = finding.get("fix_template") or {}, finding.get("path") or ""
    old, new = t.get("pattern") or "", t.get("replacement") or ""
    at = content.find(old) if old and t.get("type") == "api_migration" else -1
    if at < 0 or not path:
        return None
    n, gone, come = 1 + content.count("\n", 0, at), _lines(old), _lines(new)
    hunk = Hunk(n, len(gone), n, len(come), [("-", x) for x in gone] + [("+", x) for x in come])
    about = t.get("description") or finding.get("description") or "Migrate to a safer API"
    return Patch(finding["id"], finding["advisory_id"], about, [FilePatch(path, [hunk])], list(t.get("commands") or []), "medium")


STRATEGIES: tuple[Callable[[dict, str], Patch | None], ...] = (bump, replace)


def generate(finding: dict, content: str, strategies=STRATEGIES) -> Patch | None:
    """The patch of the first strategy that can give one."""
    return next((p for s in strategies if (p := s(finding, content)) is not None), None)


def patches(findings: DataFrame, files: DataFrame) -> DataFrame:
    """(finding_id, advisory_id, path, diff, commands, confidence) of every finding that can be fixed in its file."""
    rows = findings.join(files.select("path", "content"), "path")
    schema = "finding_id string, advisory_id string, path string, diff string, commands array<string>, confidence string"
    arrow = pa.schema([(n, pa.list_(pa.string()) if n == "commands" else pa.string()) for n in ("finding_id", "advisory_id", "path", "diff", "commands", "confidence")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [generate(r, r["content"] or "") for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist([{"finding_id": p.finding_id, "advisory_id": p.advisory_id, "path": p.files[0].path, "diff": format_patch(p.advisory_id, p.description, p.files), "commands": p.commands, "confidence": p.confidence} for p in got if p], schema=arrow)

    return rows.mapInArrow(run, schema)

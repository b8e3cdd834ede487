"""Regular expressions: which trigrams every match must hold, and the Java spelling of a pattern.

Patterns are written in the RE2 dialect. Planning runs on the driver, on
Python's parse tree; matching runs in the JVM through ``rlike``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from re import _constants as K
from re import _parser as P

_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "xdigit": "XDigit", "blank": "Blank", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "ascii": "ASCII"}
_CLASS = re.compile(r"\[:(\^?)(\w+):\]")
_UNSUPPORTED = re.compile(r"\(\?[=!]|\(\?<[=!]|\\[1-9]|\(\?>|\(\?\(")


@dataclass(frozen=True)
class Facts:
    """What is known of all matches of an expression; ``fixed`` is set where only one string matches."""

    grams: frozenset[bytes] = frozenset()
    prefix: bytes = b""
    suffix: bytes = b""
    fixed: bytes | None = None


@dataclass(frozen=True)
class Plan:
    pattern: str
    trigrams: tuple[bytes, ...] = field(default=())

    @property
    def codes(self) -> list[int]:
        return [g[0] << 16 | g[1] << 8 | g[2] for g in self.trigrams]


def trigrams(raw: bytes) -> frozenset[bytes]:
    """Distinct 3-byte windows without NUL or line feed."""
    return frozenset(w for i in range(len(raw) - 2) if b"\0" not in (w := raw[i : i + 3]) and b"\n" not in w)


def _literal(raw: bytes) -> Facts:
    return Facts(trigrams(raw), raw, raw, raw)


def _sequence(parts: list[Facts]) -> Facts:
    grams: frozenset[bytes] = frozenset()
    for p in parts:
        grams |= p.grams
    run, runs = b"", []  # longest known strings across neighbours: suffix, fixed parts, prefix
    for p in parts:
        if p.fixed is not None:
            run += p.fixed
        else:
            runs.append(run + p.prefix)
            run = p.suffix
    runs.append(run)
    for r in runs:
        grams |= trigrams(r)
    if all(p.fixed is not None for p in parts):
        return Facts(grams, run, run, run)
    return Facts(grams, runs[0], runs[-1])


def _shared(words: list[bytes]) -> bytes:
    low, high = min(words), max(words)
    n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return low[:n]


def _choice(parts: list[Facts]) -> Facts:
    grams = frozenset.intersection(*(p.grams for p in parts))
    same = {p.fixed for p in parts}
    if len(same) == 1 and None not in same:
        return _literal(same.pop())
    return Facts(grams, _shared([p.prefix for p in parts]), _shared([p.suffix[::-1] for p in parts])[::-1])


def _facts(tree) -> Facts:
    out, text = [], ""
    for op, arg in tree:
        if op is K.LITERAL:
            text += chr(arg)
            continue
        if text:
            out.append(_literal(text.encode()))
            text = ""
        if op is K.SUBPATTERN:
            out.append(Facts() if arg[1] & re.I else _facts(arg[3]))
        elif op is K.BRANCH:
            out.append(_choice([_facts(x) for x in arg[1]]))
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            f = _facts(inner) if low else Facts()
            if low and f.fixed is not None:
                word = f.fixed * min(low, 64)
                f = _literal(word) if low == high and low <= 64 else Facts(trigrams(word), word, word)
            elif low > 1:
                f = Facts(f.grams | trigrams(f.suffix + f.prefix), f.prefix, f.suffix)
            out.append(Facts(f.grams, f.prefix, f.suffix, f.fixed if low == high else None))
        elif op is K.AT:
            out.append(Facts(fixed=b""))
        else:
            out.append(Facts())
    if text:
        out.append(_literal(text.encode()))
    return _sequence(out) if out else Facts(fixed=b"")


def plan(pattern: str) -> Plan:
    """The trigrams that every match of ``pattern`` holds; none under case folding.

    Raises ValueError for a pattern that doesn't parse, or that uses
    look-around or back references, which RE2 lacks.
    """
    if _UNSUPPORTED.search(pattern):
        raise ValueError(f"not an RE2 pattern: {pattern!r}")
    if unknown := {m[2] for m in _CLASS.finditer(pattern)} - {*_POSIX, "word"}:
        raise ValueError(f"no such class: {unknown}")
    spelled = _CLASS.sub(r"\\w", pattern).replace(r"\z", r"\Z").replace("(?<", "(?P<").replace("(?PP<", "(?P<")
    spelled = re.sub(r"\\[pP](\{\^?\w+\}|\w)", r"\\w", spelled)
    try:
        tree = P.parse(spelled)
    except (re.error, RecursionError, OverflowError) as e:
        raise ValueError(f"pattern {pattern!r}: {e}") from None
    grams = frozenset() if tree.state.flags & re.I else _facts(tree).grams
    return Plan(pattern, tuple(sorted(grams)))


def to_java(pattern: str) -> str:
    """The same expression for ``rlike``: POSIX classes, named groups and the end of text are spelled otherwise."""
    def spell(m: re.Match) -> str:
        if m[2] == "word":
            return r"\W" if m[1] else r"\w"
        return rf"\{'P' if m[1] else 'p'}{{{_POSIX[m[2]]}}}"

    out = _CLASS.sub(spell, pattern)
    out = out.replace("(?P<", "(?<")
    return "(?d)" + out


def to_python(pattern: str) -> str:
    """The same expression for the ``regex`` package, which knows POSIX classes and named groups; the end of text is spelled otherwise."""
    return _CLASS.sub(lambda m: (r"\W" if m[1] else r"\w") if m[2] == "word" else m[0], pattern).replace(r"\z", r"\Z")


def has_meta(text: str) -> bool:
    return any(c in r"\.+*?()|[]{}^$" for c in text)


def detect_mode(query: str) -> str:
    """regex with a metacharacter, symbol with a leading capital, else exact."""
    if has_meta(query):
        return "regex"
    return "symbol" if query[:1].isascii() and query[:1].isupper() else "exact"

"""Version numbers as sortable columns.

``key`` turns a version text into a struct whose natural order is the
precedence of versions, so that range tests are plain comparisons and can be
pushed into join conditions. A text that isn't a version gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key(version: Column) -> Column:
    """struct(major, minor, patch, release, pre): up to three numbers, an optional v, then the pre-release after the first hyphen."""
    raw = F.regexp_replace(F.trim(version), "^v?V?", "")
    core = F.split(F.substring_index(raw, "-", 1), "\\.")
    ok = F.substring_index(raw, "-", 1).rlike(r"^[+-]?[0-9]{1,18}(\.[+-]?[0-9]{1,18}){0,2}$")
    pre = F.when(F.instr(raw, "-") > 0, F.regexp_replace(raw, "^[^-]*-", "")).otherwise("")
    number = lambda i: F.coalesce(F.get(core, F.lit(i)).try_cast("bigint"), F.lit(0).cast("bigint"))
    # a number sorts before any word, by value; a shorter list before a longer one, as arrays compare
    ident = lambda x: F.struct(
        F.when(x.rlike("^[+-]?[0-9]{1,18}$"), 0).otherwise(1).alias("word"),
        F.when(x.rlike("^[+-]?[0-9]{1,18}$"), x.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("n"),
        F.when(x.rlike("^[+-]?[0-9]{1,18}$"), F.lit("")).otherwise(x).alias("s"),
    )
    parts = F.when(pre == "", F.array().cast("array<struct<word:int,n:bigint,s:string>>")).otherwise(F.transform(F.split(pre, "\\."), ident))
    value = F.struct(number(0).alias("major"), number(1).alias("minor"), number(2).alias("patch"), F.when(pre == "", 1).otherwise(0).alias("release"), parts.alias("pre"))
    return F.when(ok, value)


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; null where either isn't a version."""
    a, b = key(left), key(right)
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1)


def within(version: Column, introduced: Column, fixed: Column, last: Column) -> Column:
    """At least ``introduced``, below ``fixed``, at most ``last``; an empty bound is open, a malformed one holds nothing."""
    v = key(version)
    test = lambda bound, ok: F.when(F.coalesce(bound, F.lit("")) == "", v.isNotNull()).otherwise(ok(v, key(bound)))
    both = test(introduced, lambda a, b: a >= b) & test(fixed, lambda a, b: a < b) & test(last, lambda a, b: a <= b)
    return F.coalesce(both, F.lit(False))


def range_text(introduced: Column, fixed: Column, last: Column) -> Column:
    """The bounds as text, such as ``>=1.0, <2.0``."""
    part = lambda sign, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(sign), c))
    return F.concat_ws(", ", part(">=", introduced), part("<", fixed), part("<=", last))


def severity_from_cvss(score: Column) -> Column:
    """0 unknown, 1 low, 2 medium, 3 high, 4 critical."""
    return F.when(score.isNull() | (score <= 0), 0).when(score < 4, 1).when(score < 7, 2).when(score < 9, 3).otherwise(4)


def ecosystem(name: Column) -> Column:
    """The registry's short name."""
    n = F.lower(name)
    known = {"pypi": ["pip"], "go": ["golang"], "cargo": ["rust"]}
    out = n
    for short, longs in known.items():
        out = F.when(n.isin(longs), short).otherwise(out)
    return out

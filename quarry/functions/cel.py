"""A filter language compiled to one Spark column.

The language has literals, lists, ``== != < <= > >= in && || ! ?:``, arithmetic,
``size``, ``matches``, ``startsWith``, ``endsWith``, ``contains``,
``timestamp`` and ``duration``. Types are checked while compiling, without
coercion; the result is a native column, so filters push down and stay inside
generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import regex

MAX_COST = 1000

#: Variables of a search result.
RESULT = {k: "string" for k in ("language", "file_path", "file_extension", "branch", "repository", "project_id", "commit_author", "commit_author_name", "commit_committer", "commit_message", "commit_source")} | {"file_size": "int", "commit_date": "timestamp", "commit_coauthors": "list", "commit_is_agent": "bool"}
#: Variables of a symbol.
SYMBOL = {k: "string" for k in ("name", "language", "file", "type", "branch", "repository", "workspace", "project")} | {"exported": "bool", "definition": "bool", "refs": "int", "line": "int"}

_TOKEN = re.compile(r"""\s+|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+u?)|(?P<str>r?"(?:\\.|[^"\\])*"|r?'(?:\\.|[^'\\])*')|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||[=!<>]=|[-+*/%<>!?:.,()\[\]])""", re.S)
_LEVEL = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", '"': '"', "'": "'"}
_SECONDS = {"h": 3600, "m": 60, "s": 1}


class CelError(ValueError):
    """An expression that doesn't parse or type-check."""


@dataclass
class Typed:
    column: Column
    kind: str
    text: str | None = None
    items: list[Typed] | None = None


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise CelError(f"unexpected {source[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Compiler:
    def __init__(self, source: str, variables: dict[str, str], columns: dict[str, Column]):
        self.toks, self.at, self.variables, self.columns, self.cost = _tokens(source), 0, variables, columns, 0

    def peek(self) -> str:
        return self.toks[self.at][1] if self.toks[self.at][0] != "str" else ""

    def take(self, want: str | None = None) -> tuple[str, str]:
        tok = self.toks[self.at]
        if want is not None and (tok[0] == "str" or tok[1] != want):
            raise CelError(f"expected {want!r}, found {tok[1]!r}")
        self.at += 1
        self.cost += 1
        if self.cost > MAX_COST:
            raise CelError(f"expression costs more than {MAX_COST}")
        return tok

    def ternary(self) -> Typed:
        test = self.binary(1)
        if self.peek() != "?":
            return test
        self.take("?")
        yes = self.ternary()
        self.take(":")
        no = self.ternary()
        if test.kind != "bool" or yes.kind != no.kind:
            raise CelError("a conditional needs a bool and two values of one type")
        return Typed(F.when(test.column, yes.column).otherwise(no.column), yes.kind)

    def binary(self, level: int) -> Typed:
        left = self.unary()
        while (op := self.peek()) in _LEVEL and _LEVEL[op] >= level:
            self.take()
            left = self.apply(op, left, self.binary(_LEVEL[op] + 1))
        return left

    def apply(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("&&", "||"):
            if a.kind != "bool" or b.kind != "bool":
                raise CelError(f"{op} needs two bools")
            return Typed(a.column & b.column if op == "&&" else a.column | b.column, "bool")
        if op == "in":
            if b.items is not None:
                if any(x.kind != a.kind for x in b.items):
                    raise CelError("a list holds values of another type")
                return Typed(a.column.isin([x.column for x in b.items]) if b.items else F.lit(False), "bool")
            if b.kind != "list" or a.kind != "string":
                raise CelError("in needs a list")
            return Typed(F.array_contains(b.column, a.column), "bool")
        if op in "+-*/%" and {a.kind, b.kind} <= {"timestamp", "duration"} and op in "+-" and b.kind == "duration":
            return Typed(a.column + b.column if op == "+" else a.column - b.column, a.kind)
        if a.kind != b.kind:
            raise CelError(f"no {op} for {a.kind} and {b.kind}")
        x, y = a.column, b.column
        if op in ("==", "!=", "<", "<=", ">", ">="):
            if a.kind in ("list",) and op not in ("==", "!="):
                raise CelError(f"lists have no {op}")
            return Typed({"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
        if op == "+" and a.kind == "string":
            return Typed(F.concat(x, y), "string")
        if a.kind not in ("int", "double") or (op == "%" and a.kind != "int"):
            raise CelError(f"no {op} for {a.kind}")
        if op == "/":
            return Typed((F.try_divide(x, y)).cast("bigint") if a.kind == "int" else F.try_divide(x, y), a.kind)
        return Typed({"+": x + y, "-": x - y, "*": x * y, "%": F.when(y != 0, x % y)}[op], a.kind)

    def unary(self) -> Typed:
        if self.peek() in ("!", "-"):
            op = self.take()[1]
            v = self.unary()
            if v.kind != "bool" if op == "!" else v.kind not in ("int", "double"):
                raise CelError(f"no {op} for {v.kind}")
            return Typed(~v.column if op == "!" else -v.column, v.kind)
        v = self.primary()
        while self.peek() in (".", "["):
            if self.take()[1] == "[":
                i = self.ternary()
                self.take("]")
                if v.kind != "list" or i.kind != "int":
                    raise CelError("only lists have an index")
                v = Typed(F.get(v.column, i.column.cast("int")), "string")
            else:
                v = self.method(v, self.take()[1])
        return v

    def arguments(self) -> list[Typed]:
        self.take("(")
        out = []
        while self.peek() != ")" or self.toks[self.at][0] == "str":
            out.append(self.ternary())
            if self.peek() != ",":
                break
            self.take(",")
        self.take(")")
        return out

    def method(self, v: Typed, name: str) -> Typed:
        args = self.arguments()
        if name == "size" and not args and v.kind in ("string", "list"):
            return self.size(v)
        if name in ("startsWith", "endsWith", "contains", "matches") and v.kind == "string" and [a.kind for a in args] == ["string"]:
            if name == "matches":
                if args[0].text is None:
                    raise CelError("matches needs a literal pattern")
                try:
                    regex.plan(args[0].text)
                except ValueError as e:
                    raise CelError(str(e)) from None
                return Typed(v.column.rlike(regex.to_java(args[0].text)), "bool")
            return Typed({"startsWith": v.column.startswith, "endsWith": v.column.endswith, "contains": v.column.contains}[name](args[0].column), "bool")
        raise CelError(f"{v.kind} has no {name}")

    @staticmethod
    def size(v: Typed) -> Typed:
        return Typed((F.length(v.column) if v.kind == "string" else F.size(v.column)).cast("bigint"), "int")

    def primary(self) -> Typed:
        kind, text = self.take()
        if kind == "num":
            if "." in text:
                return Typed(F.lit(float(text)), "double")
            return Typed(F.lit(int(text.rstrip("u"))).cast("bigint"), "int")
        if kind == "str":
            raw = text[0] == "r"
            body = text[1 + raw : -1]
            s = body if raw else re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[0]), body, flags=re.S)
            return Typed(F.lit(s), "string", s)
        if kind == "id":
            if text in ("true", "false"):
                return Typed(F.lit(text == "true"), "bool")
            if self.peek() == "(":
                return self.function(text, self.arguments())
            if text not in self.variables:
                raise CelError(f"unknown variable {text!r}")
            return Typed(self.columns.get(text, F.col(text)), self.variables[text])
        if text == "(":
            v = self.ternary()
            self.take(")")
            return v
        if text == "[":
            items = []
            while self.peek() != "]":
                items.append(self.ternary())
                if self.peek() != ",":
                    break
                self.take(",")
            self.take("]")
            return Typed(F.array(*[x.column for x in items]), "list", items=items)
        raise CelError(f"unexpected {text or 'end of expression'!r}")

    def function(self, name: str, args: list[Typed]) -> Typed:
        if name == "size" and len(args) == 1 and args[0].kind in ("string", "list"):
            return self.size(args[0])
        if name == "timestamp" and len(args) == 1 and args[0].kind == "string":
            return Typed(F.try_to_timestamp(args[0].column), "timestamp")
        if name == "duration" and len(args) == 1 and args[0].text is not None:
            parts = re.findall(r"(\d+(?:\.\d+)?)([hms])", args[0].text)
            if "".join(a + b for a, b in parts) != args[0].text:
                raise CelError(f"not a duration: {args[0].text!r}")
            return Typed(F.make_dt_interval(secs=F.lit(float(sum(float(n) * _SECONDS[u] for n, u in parts)))), "duration")
        if name in ("string", "int", "double") and len(args) == 1:
            to = {"string": "string", "int": "bigint", "double": "double"}[name]
            return Typed(args[0].column.try_cast(to), name)
        raise CelError(f"unknown function {name!r}")


def compile_filter(source: str, variables: dict[str, str] = RESULT, columns: dict[str, Column] | None = None) -> Column:
    """The filter as a boolean column; an empty expression is true. Raises :class:`CelError`."""
    if not source.strip():
        return F.lit(True)
    c = _Compiler(source, variables, columns or {})
    v = c.ternary()
    if c.toks[c.at][0] != "end":
        raise CelError(f"unexpected {c.toks[c.at][1]!r}")
    if v.kind != "bool":
        raise CelError(f"a filter is a bool, not {v.kind}")
    return v.column


def validate(source: str, variables: dict[str, str] = RESULT) -> str | None:
    """What is wrong with the expression, or None."""
    try:
        compile_filter(source, variables)
    except CelError as e:
        return str(e)
    return None


def apply_filter(df: DataFrame, source: str, variables: dict[str, str] = RESULT, columns: dict[str, Column] | None = None) -> DataFrame:
    return df.where(compile_filter(source, variables, columns))

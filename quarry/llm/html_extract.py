"""Main text of HTML pages by line-block distribution.

Markup is stripped: comments, scripts, styles and the head go, block-level
tags become line breaks (line ends of the source count as blanks), other tags
vanish, entities are decoded. The lengths of the lines (without white space)
are summed over windows of ``width`` lines. A surge is a window whose sum
exceeds ``surge`` and which the next window doesn't leave empty; its block
runs to the dive, the first window from there on whose sum is below ``dive``.
Lines from surge to dive are kept, except that a line shorter than ``surge``
at either end goes when two blank lines part it from the rest: a caption or
footer beside the text. A page may have several blocks.

Cases
-----
* Null html gives a null text; empty html, or a page without a surge, gives
  the empty text.
* Unclosed comments, scripts and styles run to the end of the page; a lone
  ``<`` is text.
* Very long pages are read whole, in time linear in their length whatever is
  left unclosed. Repeated rows are extracted each; other columns are ignored,
  whatever their names; an empty table gives an empty result.
* A window that sums to exactly ``surge`` is none, one of exactly ``dive`` goes
  on.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common as C

WIDTH = 3
SURGE = 86
DIVE = 30

_OPEN = re.compile(r"<!--|<!|<(script|style|head|noscript|template|svg)\b", re.I)
_CLOSE = {n: re.compile(rf"</{n}\s*+>", re.I) for n in ("script", "style", "head", "noscript", "template", "svg")}
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*+>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*+>")
_SPACE = re.compile(r"\s+")


def _without_hidden(page: str) -> str:
    """The page without comments, declarations and the elements that hold no text; each leaves a blank. One pass: what is looked for and missing once isn't looked for again."""
    out, at, last = [], 0, page.rfind(">")
    while m := _OPEN.search(page, at):
        out.append(page[at : m.start()])
        name, end = m[1], -1
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            end = end + 3 if end >= 0 else len(page)
        elif m.start() > last:  # no tag ends from here on, so only a comment can begin
            tail = page.find("<!--", m.start())
            out.append(page[m.start() : tail] + " " if tail >= 0 else page[m.start() :])
            return "".join(out)
        else:
            end = page.index(">", m.end()) + 1
            if name:
                close = _CLOSE[name.lower()].search(page, end)
                end = close.end() if close else len(page)
        out.append(" ")
        at = end
    return "".join(out) + page[at:]


def _replace(tag: re.Pattern, by: str, text: str) -> str:
    """Substitute tags up to the last ``>``: beyond it none ends, and every ``<`` would look for an end in vain."""
    cut = text.rfind(">") + 1
    return tag.sub(by, text[:cut]) + text[cut:]


def to_lines(page: str) -> list[str]:
    """The lines of the page as text, in time linear in its length."""
    text = _replace(_TAG, "", _replace(_BREAK, "\n", _SPACE.sub(" ", _without_hidden(page))))
    return [_SPACE.sub(" ", _html.unescape(x)).strip() for x in text.split("\n")]


def blocks(lengths: list[int], width: int = WIDTH, surge: int = SURGE, dive: int = DIVE) -> list[tuple[int, int]]:
    """(surge, dive) line ranges."""
    n = len(lengths)
    total = np.concatenate(([0], np.cumsum(lengths)))
    window = total[np.minimum(np.arange(n) + width, n)] - total[:n]
    out, i = [], 0
    starts, ends = np.flatnonzero(window > surge), np.flatnonzero(window < dive)
    while True:
        k = np.searchsorted(starts, i)
        if k == len(starts):
            return out
        s = int(starts[k])
        if (window[s + 1 : s + 2] == 0).any():
            i = s + 1
            continue
        k = np.searchsorted(ends, s)
        e = int(ends[k]) if k < len(ends) else n
        i = e
        out.append((s, e))


def _isolated(lengths: list[int], at: int, step: int, stop: int, surge: int) -> bool:
    """Whether the line at an edge is short and at least two blank lines part it from the rest."""
    return lengths[at] < surge and at + 3 * step in range(*sorted((at, stop))) and lengths[at + step] == lengths[at + 2 * step] == 0


def extract(page: str | None, width: int = WIDTH, surge: int = SURGE, dive: int = DIVE) -> str | None:
    """The page's main text, one kept line each."""
    if page is None:
        return None
    lines = to_lines(page)
    lengths = [len(x) - x.count(" ") for x in lines]
    kept: list[str] = []
    for s, e in blocks(lengths, width, surge, dive):
        e -= 1
        while s < e and (not lengths[s] or _isolated(lengths, s, 1, e + 1, surge)):
            s += 1
        while e > s and (not lengths[e] or _isolated(lengths, e, -1, s - 1, surge)):
            e -= 1
        kept += [x for x in lines[s : e + 1] if x]
    return "\n".join(kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", width: int = WIDTH, surge: int = SURGE, dive: int = DIVE) -> DataFrame:
    """(page_id, text, n_chars) of every row."""
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                text = [extract(x, width, surge, dive) for x in C.column(b, "html").to_pylist()]
                yield pa.RecordBatch.from_arrays([C.column(b, "page_id"), pa.array(text, pa.string()), pa.array([None if x is None else len(x) for x in text], pa.int64())], ["page_id", "text", "n_chars"])

    return C.map_arrow(slim, run, f"page_id {dict(slim.dtypes)['page_id']}, text string, n_chars bigint")


_HIDDEN = "|".join(["(?is)<!--.*?(?:-->|\\z)", *[rf"<{n}\b[^>]*>.*?(?:</{n}\s*>|\z)" for n in ("script", "style", "head", "noscript", "template", "svg")], "<![^>]*>"])
_DECODED = "line"
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#39;", "''"), ("&apos;", "''")):
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_char}')"
#: The same in DuckDB, with the entities that such pages use. All starts before one dive make one block, and an edge is the outermost line that stays.
ORACLE = rf"""
WITH shown AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '{_HIDDEN}', ' ', 'g'), '\s+', ' ', 'g') AS t FROM pages),
cut AS (SELECT page_id, html, regexp_replace(regexp_replace(t, '(?i){_BREAK.pattern.replace("*+", "*")}', chr(10), 'g'), '{_TAG.pattern.replace("*+", "*")}', '', 'g') AS t FROM shown),
split AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS i FROM cut),
lines AS (SELECT page_id, i, trim(regexp_replace(regexp_replace({_DECODED}, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS x FROM split),
sized AS (SELECT page_id, i, x, length(replace(x, ' ', '')) AS n FROM lines),
summed AS (SELECT *, sum(n) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS w, max(i) OVER (PARTITION BY page_id) + 1 AS stop FROM sized),
ahead AS (SELECT *, lead(w) OVER (PARTITION BY page_id ORDER BY i) AS next, min(CASE WHEN w < {DIVE} THEN i END) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS dive FROM summed),
block AS (SELECT page_id, min(i) AS s, coalesce(dive, stop) - 1 AS e FROM ahead WHERE w > {SURGE} AND coalesce(next, 1) <> 0 GROUP BY page_id, coalesce(dive, stop)),
near AS (SELECT *, lag(n, 1) OVER p AS b1, lag(n, 2) OVER p AS b2, lead(n, 1) OVER p AS a1, lead(n, 2) OVER p AS a2 FROM sized WINDOW p AS (PARTITION BY page_id ORDER BY i)),
first AS (SELECT b.page_id, b.e, coalesce(min(r.i), b.e) AS s FROM block b LEFT JOIN near r ON r.page_id = b.page_id AND r.i >= b.s AND r.i < b.e AND r.n > 0 AND NOT (r.n < {SURGE} AND r.i + 3 <= b.e AND r.a1 = 0 AND r.a2 = 0) GROUP BY b.page_id, b.s, b.e),
last AS (SELECT b.page_id, b.s, coalesce(max(r.i), b.s) AS e FROM first b LEFT JOIN near r ON r.page_id = b.page_id AND r.i > b.s AND r.i <= b.e AND r.n > 0 AND NOT (r.n < {SURGE} AND r.i - 3 >= b.s - 1 AND r.b1 = 0 AND r.b2 = 0) GROUP BY b.page_id, b.s, b.e),
kept AS (SELECT r.page_id, string_agg(r.x, chr(10) ORDER BY r.i) AS text FROM last b JOIN sized r ON r.page_id = b.page_id AND r.i BETWEEN b.s AND b.e WHERE r.x <> '' GROUP BY r.page_id)
SELECT p.page_id, CASE WHEN p.html IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CASE WHEN p.html IS NULL THEN NULL ELSE length(coalesce(k.text, '')) END AS n_chars
FROM pages p LEFT JOIN kept k ON p.page_id = k.page_id
"""

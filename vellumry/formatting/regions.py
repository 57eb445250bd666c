"""Protected regions: syntax whose source is kept byte for byte.

Candidates come from one scanner per kind; those that overlap are arbitrated by
(priority, greater length, name).  Offsets are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Region(NamedTuple):
    kind: str
    form: str
    start: int
    end: int
    source: str

    @property
    def widths(self) -> list[int]:
        """Per line of an inline region; a block has none."""
        return [len(x) for x in self.source.split("\n")] if self.form == "inline" else []


# Kinds of regions and their priorities; the lower wins.
PRIORITY = {
    "math_gitlab_inline": 10, "math_myst_inline": 10, "raw_html_inline": 15, "myst_role_inline": 18, "wikilink_inline": 18, "gitlab_reference_inline": 18,
    "code_span": 20, "math_paren_inline": 30, "math_environment_inline": 30, "attribute_group_inline": 35, "math_dollar_inline": 40, "math_double_dollar_inline": 40,
    "pandoc_multiline_table": 45, "obsidian_callout": 45, "colon_container": 45, "toml_frontmatter": 45, "definition_list": 45, "pandoc_grid_table": 45,
    "raw_html_block": 45, "attribute_group_block": 45, "pandoc_line_block": 45, "gitlab_multiline_blockquote": 45,
    "math_dollar_block": 50, "math_bracket_block": 50, "math_environment_block": 50,
}
# Reference types of the bracket form [type:id].
REFERENCE_TYPES = "cadence|contact|epic|feature_flag|issue|vulnerability|wiki_page|work_item"
# Element names that open an HTML block up to a blank line.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th "
    "thead title tr track ul"
).split()
_ATTRIBUTE = r"\s+[A-Za-z_:][\w.:\-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?"
OPEN_TAG = rf"<[A-Za-z][A-Za-z0-9\-]*(?:{_ATTRIBUTE})*\s*/?>"
CLOSE_TAG = r"</[A-Za-z][A-Za-z0-9\-]*\s*>"
RAW_HTML = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}|<!--(?:>|->|[\s\S]*?-->)|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>|<[A-Za-z][A-Za-z0-9+.\-]{{1,31}}:[^\s<>]*>|<[\w.!#$%&'*+/=?^`{{|}}~\-]+@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?>")
_TICKS = re.compile("`+")
_ATOM = r"(?:\\.|[^\s{}\"'=\\])+"
_VALUE = r"(?:\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|(?:\\.|[^\s{}\"'\\])+)"
_ATTRIBUTE_ITEM = rf"(?:[.#]{_ATOM}|{_ATOM}={_VALUE})"
#: {#id .class key=value}: an attribute group on one line.
ATTRIBUTE_GROUP = re.compile(rf"\{{[^\S\n]*{_ATTRIBUTE_ITEM}(?:[^\S\n]+{_ATTRIBUTE_ITEM})*[^\S\n]*\}}")
# Fixed value: characters that an attribute group may follow.
_BEARERS = ")]}`$>*_"
_WIKI_MARK = re.compile(r"\[\[|\]\]|\n")
_REFERENCE = re.compile(rf"\[(?:{REFERENCE_TYPES}):(?:\\.|[^\[\]\\\n])+\]")
_ROLE = re.compile(r"\{([A-Za-z][A-Za-z0-9:_\-]*)\}\Z")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([^{}\n]+)\}")
_PAREN = re.compile(r"\\[()]")
_DOLLARS = re.compile(r"\$+")
#: Documents without any of these have no inline region.
MAY_HOLD = re.compile(r"[`$<{\\]|\[\[|\[(?:" + REFERENCE_TYPES + "):")


def is_escaped(text: str, at: int) -> bool:
    """Whether an odd number of backslashes stands before ``at``."""
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def _cut(kind: str, text: str, start: int, end: int) -> Region:
    return Region(kind, "inline", start, end, text[start:end])


def _backticks(text: str) -> Iterator[Region]:
    """Code spans, and the math and role forms that are built on backticks.

    A run of backticks closes the open one of its length, or opens one itself.
    """
    code: dict[int, int] = {}
    role: dict[int, tuple[str, int]] = {}
    dollar: dict[int, int] = {}
    for m in _TICKS.finditer(text):
        a, b = m.span()
        n = b - a
        if (start := code.pop(n, None)) is not None:
            yield _cut("code_span", text, start, b)
        else:
            code[n] = a
        if (opened := role.pop(n, None)) is not None:
            yield _cut(opened[0], text, opened[1], b)
        elif text[a - 1 : a] == "}" and (named := _ROLE.search(text, max(0, text.rfind("{", 0, a)), a)) and not is_escaped(text, named.start()):
            role[n] = ("math_myst_inline" if named[1] == "math" else "myst_role_inline", named.start())
        if n in dollar and text[b : b + 1] == "$":
            yield _cut("math_gitlab_inline", text, dollar.pop(n), b + 1)
        elif text[a - 1 : a] == "$" and a and not is_escaped(text, a - 1):
            dollar.setdefault(n, a - 1)


def _dollars(text: str) -> Iterator[Region]:
    """Dollar math: two dollars open and close display math; single ones pair up, also
    while display math has been opened and not closed yet."""
    display = single = None
    for m in _DOLLARS.finditer(text):
        at, stop = m.span()
        if is_escaped(text, at):
            at += 1
        while at < stop:
            pair = stop - at >= 2
            if display is None and single is None:
                display, single = (at, None) if pair else (None, at)
                at += 1 + pair
            elif display is not None and pair:
                yield _cut("math_double_dollar_inline", text, display, at + 2)
                display = single = None
                at += 2
            elif single is None:
                single = at
                at += 1
            else:
                yield _cut("math_dollar_inline", text, single, at + 1)
                single = None
                at += 1


def _environments(text: str) -> Iterator[Region]:
    stack: list[tuple[str, int]] = []
    for m in _ENVIRONMENT.finditer(text):
        if is_escaped(text, m.start()):
            continue
        if m[1] == "begin":
            stack.append((m[2], m.start()))
        elif stack and stack[-1][0] == m[2]:
            yield _cut("math_environment_inline", text, stack.pop()[1], m.end())


def _wikilinks(text: str) -> Iterator[Region]:
    """Double brackets on one line; of nested ones the outermost that closes."""
    stack: list[int] = []
    found: list[tuple[int, int]] = []
    for m in _WIKI_MARK.finditer(text):
        if m.group() == "\n":
            stack = []
        elif is_escaped(text, m.start()):
            continue
        elif m.group() == "[[":
            stack.append(m.start())
        elif stack:
            start = stack.pop()
            while found and found[-1][0] > start:
                found.pop()
            if text[start + 2 : m.start()].strip():
                found.append((start, m.end()))
    for start, end in found:
        embeds = text[start - 1 : start] == "!" and start and not is_escaped(text, start - 1)
        yield _cut("wikilink_inline", text, start - 1 if embeds else start, end)


def _simple(text: str, heading: bool) -> Iterator[Region]:
    for kind, pattern in (("raw_html_inline", RAW_HTML), ("gitlab_reference_inline", _REFERENCE)):
        for m in pattern.finditer(text):
            if not is_escaped(text, m.start()):
                yield _cut(kind, text, *m.span())
    opened = None
    for m in _PAREN.finditer(text):
        if is_escaped(text, m.start()):
            continue
        if m.group() == "\\(":
            opened = m.start() if opened is None else opened
        elif opened is not None:
            yield _cut("math_paren_inline", text, opened, m.end())
            opened = None
    for m in ATTRIBUTE_GROUP.finditer(text):
        before = text[m.start() - 1 : m.start()]
        if before and (before in _BEARERS or heading and before.isspace()) and not is_escaped(text, m.start()):
            yield _cut("attribute_group_inline", text, *m.span())


def arbitrate(found: list[Region]) -> list[Region]:
    """Of regions with one start the best; then those that do not overlap, from the left."""
    best: dict[int, Region] = {}
    for r in sorted(found, key=lambda r: (r.start, PRIORITY[r.kind], r.start - r.end, r.kind)):
        best.setdefault(r.start, r)
    out: list[Region] = []
    for start in sorted(best):
        if not out or start >= out[-1].end:
            out.append(best[start])
    return out


def inline_regions(text: str, heading: bool = False) -> list[Region]:
    """The protected inline regions of one paragraph or heading, in order."""
    return arbitrate(inline_candidates(text, heading))


def inline_candidates(text: str, heading: bool = False) -> list[Region]:
    """What the inline scanners find in one scope, overlaps included."""
    if not MAY_HOLD.search(text):
        return []
    found: list[Region] = list(_simple(text, heading))
    if "`" in text:
        found += _backticks(text)
    if "$" in text:
        found += _dollars(text)
    if "[[" in text:
        found += _wikilinks(text)
    if "\\begin" in text:
        found += _environments(text)
    return found


def cell_spans(row: str) -> list[tuple[int, int]]:
    """The cells of a table row; pipes in code, links and references do not divide."""
    closed = arbitrate([r for r in inline_candidates(row) if r.kind in ("code_span", "math_myst_inline", "myst_role_inline", "wikilink_inline", "gitlab_reference_inline")])
    out, start, k = [], 0, 0
    for at, c in enumerate(row):
        if c != "|":
            continue
        while k < len(closed) and closed[k].end <= at:
            k += 1
        if not (k < len(closed) and closed[k].start <= at) and not is_escaped(row, at):
            out.append((start, at))
            start = at + 1
    return [(a, b) for a, b in [*out, (start, len(row))] if a < b]

"""Markdown blocks: containers, leaves and the block-level protected kinds.

A document is read in one pass from the outside in.  Each block keeps its source lines,
so that rendering can copy what must not change.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import accumulate
from typing import NamedTuple

from vellumry.formatting.regions import ATTRIBUTE_GROUP, BLOCK_TAGS, CLOSE_TAG, OPEN_TAG, Region, arbitrate, cell_spans, inline_candidates


@dataclass
class Block:
    """A block with its first and last source line (0-based, inclusive)."""

    kind: str
    start: int
    end: int
    text: str = ""
    info: str = ""
    level: int = 0
    fence: str = ""
    marker: str = ""
    number: int = 0
    loose: bool = False
    protected: str = ""
    children: list[Block] = field(default_factory=list)


@dataclass
class Line:
    """A line inside its containers: number, text, and whether it is a lazy continuation."""

    n: int
    text: str
    lazy: bool = False

    @property
    def blank(self) -> bool:
        return not self.text.strip()


_CONTAINERS = ("quote", "list", "item", "footnote")

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})[ \t]*(.*?)[ \t]*$")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
BREAK = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
QUOTE = re.compile(r" {0,3}>")
ITEM = re.compile(r"( {0,3})([-*+]|(\d{1,9})([.)]))(?=[ \t]|$)")
FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
DEFINITION = re.compile(r" {0,3}\[(?!\^)((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]+(\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
TABLE_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
MATH_OPEN = re.compile(r" {0,3}\$\$[ \t]*$")
# Fixed value: the end of a dollar block, with its label.
MATH_CLOSE = re.compile(r" {0,3}\$\$(?:[ \t]+(?:\([^()\n]*\)|\{[^{}\n]*\}))?$")
ENVIRONMENT_LINE = re.compile(r" {0,3}\\(begin|end)\{([^{}\n]+)\}$")
COLONS = re.compile(r" {0,3}(:{3,})[ \t]*(\S.*)?$")
CALLOUT = re.compile(r"\[![A-Za-z][\w\-]*\][+-]?")
DEFINED = re.compile(r" {0,2}[:~][ \t]+\S")
GRID = re.compile(r" {0,3}\+(?:[-=:]+\+)+[ \t]*$")
DASHES = re.compile(r" {0,3}-+(?:[ \t]+-+)*[ \t]*$")
LINE_BLOCK = re.compile(r" {0,3}\|(?: |$)")

# Starts and ends of the HTML block kinds that close on a mark.
HTML_KINDS = [
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?=[\s>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->")),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>")),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">")),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>")),
]
HTML_BLOCK = re.compile(rf" {{0,3}}</?(?:{'|'.join(BLOCK_TAGS)})(?=[\s/>]|$)", re.I)
HTML_ALONE = re.compile(rf" {{0,3}}(?:{OPEN_TAG}|{CLOSE_TAG})[ \t]*$")


def columns(text: str) -> int:
    """Width of the indent, tabs to stops of four."""
    n = 0
    for c in text:
        if c == " ":
            n += 1
        elif c == "\t":
            n += 4 - n % 4
        else:
            break
    return n


def cut(text: str, n: int) -> str:
    """``text`` without ``n`` columns of indent; a split tab leaves its rest as spaces."""
    done = k = 0
    while k < len(text) and done < n and text[k] in " \t":
        done += 1 if text[k] == " " else 4 - done % 4
        k += 1
    return " " * (done - n) + text[k:]


def interrupts(text: str) -> bool:
    """Whether a line ends the paragraph above it."""
    if not text or text[0] not in " #`~*-_><$:+0123456789|[":
        return False
    if FENCE.match(text) or HEADING.match(text) or BREAK.match(text) or QUOTE.match(text):
        return True
    if m := ITEM.match(text):
        rest = text[m.end() :].strip()
        return bool(rest) and (m[3] is None or int(m[3]) == 1)
    return any(a.match(text) for a, _ in HTML_KINDS) or bool(HTML_BLOCK.match(text)) or bool(MATH_OPEN.match(text)) or bool(COLONS.match(text))


def parse(text: str) -> list[Block]:
    """The blocks of a document."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    out: list[Block] = []
    k = 0
    if lines and lines[0].rstrip() == "+++":
        end = next((i for i in range(1, len(lines)) if lines[i].rstrip() == "+++"), None)
        if end:
            out.append(Block("raw", 0, end, "\n".join(lines[: end + 1]), protected="toml_frontmatter"))
            k = end + 1
    return out + _Reader([Line(i, x) for i, x in enumerate(lines)][k:]).blocks()


def tree_of(text: str) -> list[Block]:
    """``parse`` for tables of structure: a document nested too deep to be read is one raw block."""
    try:
        return parse(text)
    except RecursionError:
        return [Block("raw", 0, max(0, len(_split(text)) - 1), text)]


class _Reader:
    def __init__(self, lines: list[Line]) -> None:
        self.lines, self.at = lines, 0
        #: Lines of the container being read that were parsed, how many, and their blocks.
        self.parsed: tuple[list[Line] | None, int, list[Block]] = (None, 0, [])
        self.no_table_from = len(lines)
        self.colon_ends: dict[int, int] | None = None

    def blocks(self) -> list[Block]:
        out: list[Block] = []
        while self.at < len(self.lines):
            if self.lines[self.at].blank:
                self.at += 1
            else:
                out.append(self._block())
        return out

    def _take(self, n: int) -> list[Line]:
        got = self.lines[self.at : self.at + n]
        self.at += n
        return got

    def _raw(self, n: int, kind: str) -> Block:
        got = self._take(n)
        return Block("raw", got[0].n, got[-1].n, "\n".join(x.text for x in got), protected=kind)

    def _block(self) -> Block:
        line = self.lines[self.at]
        text = line.text
        if line.lazy:
            return self._paragraph()
        if columns(text) >= 4:
            return self._indented()
        if m := FENCE.match(text):
            return self._fenced(m)
        if text.lstrip()[:1] not in "#*-_>$:+<[|\\{0123456789=":
            return self._definition_list() or self._paragraph()
        for special in (self._protected, self._html):
            if (block := special()) is not None:
                return block
        if m := HEADING.match(text):
            self.at += 1
            return Block("heading", line.n, line.n, (m[2] or "").strip(), level=len(m[1]))
        if QUOTE.match(text):
            return self._quote()
        if BREAK.match(text):
            self.at += 1
            return Block("break", line.n, line.n)
        if ITEM.match(text):
            return self._list()
        if m := FOOTNOTE.match(text):
            return self._footnote(m)
        if DEFINITION.match(text):
            self.at += 1
            return Block("definition", line.n, line.n, text.strip())
        return self._definition_list() or self._paragraph()

    # -- leaves ---------------------------------------------------------------------

    def _fenced(self, m: re.Match) -> Block:
        first = self.lines[self.at]
        fence, indent = m[1], columns(first.text)
        body: list[str] = []
        k = self.at + 1
        closed = False
        while k < len(self.lines) and not self.lines[k].lazy:
            t = self.lines[k].text
            if columns(t) < 4 and (c := t.strip()) and set(c) == {fence[0]} and len(c) >= len(fence):
                closed = True
                k += 1
                break
            body.append(cut(t, min(indent, columns(t))))
            k += 1
        last = self.lines[k - 1].n
        self.at = k
        return Block("code", first.n, last, "\n".join(body), info=m[2], fence=fence, loose=closed)

    def _indented(self) -> Block:
        k, body = self.at, []
        while k < len(self.lines) and (self.lines[k].blank or columns(self.lines[k].text) >= 4) and not self.lines[k].lazy:
            body.append(cut(self.lines[k].text, 4))
            k += 1
        while not body[-1].strip():
            body.pop()
        first = self.lines[self.at].n
        last = self.lines[self.at + len(body) - 1].n
        self.at = k
        return Block("code", first, last, "\n".join(body))

    def _paragraph(self) -> Block:
        first = k = self.at
        k += 1
        while k < len(self.lines):
            line = self.lines[k]
            if line.blank:
                break
            if not line.lazy and (m := SETEXT.match(line.text)):
                if not (m[1][0] == "-" and TABLE_RULE.match(line.text) and "|" in self.lines[k - 1].text and k == first + 1):
                    got = self._take(k - first + 1)
                    body = "\n".join(x.text.strip() for x in got[:-1])
                    return Block("heading", got[0].n, got[-1].n, body, level=1 if m[1][0] == "=" else 2)
            if k == first + 1 and not line.lazy and self._is_table(k):
                return self._table()
            if columns(line.text) < 4 and not line.lazy and interrupts(line.text):
                break
            k += 1
        got = self._take(k - first)
        body = "\n".join(x.text for x in got)
        return Block("paragraph", got[0].n, got[-1].n, body.strip())

    def _is_table(self, rule: int) -> bool:
        head, line = self.lines[rule - 1].text, self.lines[rule].text
        return "|" in line and bool(TABLE_RULE.match(line)) and len(cells(head)) == len(cells(line))

    def _table(self) -> Block:
        k = self.at + 2
        while k < len(self.lines) and not self.lines[k].blank and not self.lines[k].lazy and not interrupts(self.lines[k].text):
            k += 1
        got = self._take(k - self.at)
        return Block("table", got[0].n, got[-1].n, "\n".join(x.text for x in got))

    # -- containers -----------------------------------------------------------------

    def _continues(self, inner: list[Line]) -> bool:
        """Whether the next line may lazily continue the paragraph at the end of ``inner``."""
        if self.at >= len(self.lines) or not inner or inner[-1].blank:
            return False
        line = self.lines[self.at]
        if line.blank or (columns(line.text) < 4 and (interrupts(line.text) or ITEM.match(line.text))):
            return False
        known, n, _ = self.parsed
        if known is inner and all(x.lazy for x in inner[n:]):
            return True  # what continues a paragraph leaves it open
        tree = _Reader(inner).blocks()
        self.parsed = (inner, len(inner), tree)
        last = tree[-1]
        while last.children and last.kind in _CONTAINERS:
            last = last.children[-1]
        if last.kind == "paragraph" and last.end == inner[-1].n:
            return True
        self.parsed = (None, 0, [])
        return False

    def _inside(self, inner: list[Line]) -> list[Block]:
        """The blocks of a container.  Where all that followed the last look at them continues
        a paragraph, it is added there, so that nesting is read once."""
        known, n, tree = self.parsed
        rest = inner[n:]
        if known is not inner or not all(x.lazy and x.text[:1] not in (":", "~", "[") for x in rest):
            return _Reader(inner).blocks()
        if rest:
            last = tree[-1]
            while last.children and last.kind in _CONTAINERS:
                last.end = rest[-1].n
                last = last.children[-1]
            last.end = rest[-1].n
            ends = inner[n - 1].text  # its white space may make a hard break
            last.text = "\n".join([last.text + ends[len(ends.rstrip()) :], *(x.text for x in rest)]).rstrip()
        return tree

    def _quote(self) -> Block:
        inner: list[Line] = []
        first = self.at
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if not line.lazy and columns(line.text) < 4 and QUOTE.match(line.text):
                rest = line.text.lstrip(" \t")[1:]
                inner.append(Line(line.n, cut(rest, 1) if rest[:1] in (" ", "\t") else rest))
            elif self._continues(inner):
                inner.append(Line(line.n, line.text.lstrip(), True))
            else:
                break
            self.at += 1
        source = inner[0].text.strip()
        if CALLOUT.match(source):
            return Block("raw", inner[0].n, inner[-1].n, "\n".join(x.text for x in self.lines[first : self.at]), protected="obsidian_callout")
        return Block("quote", inner[0].n, inner[-1].n, children=self._inside(inner))

    def _list(self) -> Block:
        m = ITEM.match(self.lines[self.at].text)
        kind = m[2][-1]
        out = Block("list", self.lines[self.at].n, 0, marker=kind, number=int(m[3]) if m[3] else -1)
        while self.at < len(self.lines):
            line = self.lines[self.at]
            m = None if line.lazy or columns(line.text) >= 4 else ITEM.match(line.text)
            if not m or m[2][-1] != kind or BREAK.match(line.text):
                break
            out.children.append(self._item(m))
            ahead = self.at
            while ahead < len(self.lines) and self.lines[ahead].blank:
                ahead += 1
            if ahead < len(self.lines) and not self.lines[ahead].lazy and (n := ITEM.match(self.lines[ahead].text)) and columns(self.lines[ahead].text) < 4 and n[2][-1] == kind and not BREAK.match(self.lines[ahead].text):
                out.loose |= ahead > self.at or out.children[-1].info == "blank"
                self.at = ahead
            else:
                break
        for item in out.children:
            gaps = zip(item.children, item.children[1:])
            out.loose |= any(b.start > a.end + 1 for a, b in gaps)
        out.end = out.children[-1].end
        return out

    def _item(self, m: re.Match) -> Block:
        first = self.lines[self.at]
        rest = first.text[m.end() :]
        gap = columns(rest)
        offset = m.end() + (gap if 1 <= gap <= 4 and rest.strip() else 1)
        inner = [Line(first.n, cut(rest, offset - m.end()))]
        self.at += 1
        trailing = 0
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.blank:
                if len(inner) == 1 and inner[0].blank:
                    break
                inner.append(Line(line.n, ""))
                trailing += 1
            elif not line.lazy and columns(line.text) >= offset:
                inner.append(Line(line.n, cut(line.text, offset)))
                trailing = 0
            elif not trailing and self._continues(inner):
                inner.append(Line(line.n, line.text.lstrip(), True))
            else:
                break
            self.at += 1
        for _ in range(trailing):
            inner.pop()
        self.at -= trailing
        out = Block("item", first.n, inner[-1].n, children=self._inside(inner))
        out.marker = m[2]
        if out.children and out.children[0].kind == "paragraph" and (t := re.match(r"\[([ xX])\][ \t]+(?=\S)", out.children[0].text)):
            out.info = "[ ] " if t[1] == " " else "[x] "
            out.children[0].text = out.children[0].text[t.end() :]
        return out

    def _footnote(self, m: re.Match) -> Block:
        first = self.lines[self.at]
        inner = [Line(first.n, m[2])]
        self.at += 1
        trailing = 0
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.blank:
                inner.append(Line(line.n, ""))
                trailing += 1
            elif columns(line.text) >= 4 and not line.lazy:
                inner.append(Line(line.n, cut(line.text, 4)))
                trailing = 0
            elif not trailing and not DEFINITION.match(line.text) and not FOOTNOTE.match(line.text) and self._continues(inner):
                inner.append(Line(line.n, line.text.lstrip(), True))
            else:
                break
            self.at += 1
        for _ in range(trailing):
            inner.pop()
        self.at -= trailing
        return Block("footnote", first.n, inner[-1].n, info=m[1], children=self._inside(inner))

    # -- protected ------------------------------------------------------------------

    def _until(self, closes, most: int | None = None) -> int | None:
        """Lines up to the first after this one for which ``closes`` holds, inclusive."""
        for k in range(self.at + 1, len(self.lines)):
            if self.lines[k].lazy:
                return None
            if closes(self.lines[k].text):
                return k - self.at + 1
        return None

    def _protected(self) -> Block | None:
        line = self.lines[self.at]
        text, bare = line.text, line.text.strip()
        if MATH_OPEN.match(text):
            n = self._until(lambda t: MATH_CLOSE.match(t) is not None)
            return self._raw(n, "math_dollar_block") if n else None
        if bare == "\\[":
            n = self._until(lambda t: t.strip() == "\\]")
            return self._raw(n, "math_bracket_block") if n else None
        if (m := ENVIRONMENT_LINE.match(text)) and m[1] == "begin":
            depth = 0
            for k in range(self.at, len(self.lines)):
                e = ENVIRONMENT_LINE.match(self.lines[k].text)
                if e and e[2] == m[2]:
                    depth += 1 if e[1] == "begin" else -1
                    if not depth:
                        return self._raw(k - self.at + 1, "math_environment_block")
            return None
        if (m := COLONS.match(text)) and m[2]:
            end = self._colon_ends().get(self.at)
            return self._raw(end - self.at + 1, "colon_container") if end is not None else None
        if bare == ">>>":
            n = self._until(lambda t: t.strip() == ">>>")
            return self._raw(n, "gitlab_multiline_blockquote") if n else None
        if GRID.match(text):
            k, last = self.at, None
            while k < len(self.lines) and self.lines[k].text.strip()[:1] in ("+", "|") and not self.lines[k].blank:
                if GRID.match(self.lines[k].text):
                    last = k
                k += 1
            if last is not None and last > self.at + 1:
                return self._raw(self._caption(last + 1) - self.at, "pandoc_grid_table")
            return None
        if ATTRIBUTE_GROUP.fullmatch(bare):
            return self._raw(1, "attribute_group_block")
        if self._is_line_block(self.at):
            k = self.at
            while k < len(self.lines) and self._is_line_block(k):
                k += 1
            return self._raw(k - self.at, "pandoc_line_block")
        if re.fullmatch(r" {0,3}(?:-{2,}(?:[ \t]+-{2,})+|-{3,})[ \t]*", text):
            return self._multiline_table()
        return None

    def _colon_ends(self) -> dict[int, int]:
        """The closing line of each colon container that closes; code is passed over."""
        if self.colon_ends is None:
            self.colon_ends, opened, fence = {}, [], ""
            for k, line in enumerate(self.lines):
                mark = line.text.strip()
                if fence:
                    if set(mark) == {fence[0]} and len(mark) >= len(fence):
                        fence = ""
                elif m := FENCE.match(line.text):
                    fence = m[1]
                elif not line.lazy and (m := COLONS.match(line.text)):
                    if m[2]:
                        opened.append(k)
                    elif opened:
                        self.colon_ends[opened.pop()] = k
        return self.colon_ends

    def _is_line_block(self, k: int) -> bool:
        """A line that starts with a bar and is no row of a table."""
        bare = self.lines[k].text.strip()
        if not LINE_BLOCK.match(self.lines[k].text) or bare.endswith("|") and bare.count("|") >= 3:
            return False
        return not (k + 1 < len(self.lines) and self._is_table(k + 1)) and not TABLE_RULE.match(self.lines[k].text)

    def _caption(self, k: int) -> int:
        """The line behind a caption that follows line ``k``, or ``k``."""
        ahead = k
        while ahead < len(self.lines) and self.lines[ahead].blank:
            ahead += 1
        if ahead < len(self.lines) and re.match(r"(?:Table)?:[ \t]", self.lines[ahead].text):
            while ahead < len(self.lines) and not self.lines[ahead].blank:
                ahead += 1
            return ahead
        return k

    def _multiline_table(self) -> Block | None:
        """A header over a rule of several dashes runs, rows, and a closing rule before a
        blank line; a solid rule may stand above the header."""
        if self.at >= self.no_table_from:
            return None
        ruled = self.at
        if " " not in self.lines[ruled].text.strip():
            ruled += 1
            while ruled < len(self.lines) and not self.lines[ruled].blank and not DASHES.match(self.lines[ruled].text):
                ruled += 1
            if ruled == self.at + 1 or ruled >= len(self.lines) or " " not in self.lines[ruled].text.strip() or self.lines[ruled].blank:
                return None
        for close in range(ruled + 1, len(self.lines)):
            if self.lines[close].lazy:
                return None
            if DASHES.match(self.lines[close].text) and (close + 1 >= len(self.lines) or self.lines[close + 1].blank):
                return self._raw(self._caption(close + 1) - self.at, "pandoc_multiline_table")
        self.no_table_from = self.at  # no closing rule from here on
        return None

    def _definition_list(self) -> Block | None:
        """Term lines, each with definitions that start with a colon or tilde."""
        ahead = [x.text for x in self.lines[self.at + 1 : self.at + 3]]
        if not any(x.lstrip()[:1] in (":", "~") for x in ahead):
            return None
        k, seen = self.at, False
        while True:
            term = k
            while k < len(self.lines) and not self.lines[k].blank and not DEFINED.match(self.lines[k].text) and not self.lines[k].lazy:
                if k > term and (interrupts(self.lines[k].text) or columns(self.lines[k].text) >= 4):
                    return None if not seen else self._raw(last - self.at, "definition_list")
                k += 1
            ahead = k + 1 if k < len(self.lines) and self.lines[k].blank else k
            if k == term or ahead >= len(self.lines) or not DEFINED.match(self.lines[ahead].text) or k - term > 1:
                break
            k, seen = ahead, True
            while k < len(self.lines):
                if self.lines[k].blank:
                    nxt = k
                    while nxt < len(self.lines) and self.lines[nxt].blank:
                        nxt += 1
                    if nxt < len(self.lines) and (DEFINED.match(self.lines[nxt].text) or columns(self.lines[nxt].text) >= 2):
                        k = nxt
                        continue
                    break
                k += 1
            last = k
            while k < len(self.lines) and self.lines[k].blank:
                k += 1
            if k >= len(self.lines):
                break
        return self._raw(last - self.at, "definition_list") if seen else None

    def _html(self) -> Block | None:
        text = self.lines[self.at].text
        if text.lstrip()[:1] != "<":
            return None
        for opens, closes in HTML_KINDS:
            if opens.match(text):
                n = 1 if closes.search(text, opens.match(text).end()) else self._until(lambda t: closes.search(t) is not None) or len(self.lines) - self.at
                return self._raw(n, "raw_html_block")
        if HTML_BLOCK.match(text) or HTML_ALONE.match(text):
            k = self.at
            while k < len(self.lines) and not self.lines[k].blank and not self.lines[k].lazy:
                k += 1
            return self._raw(k - self.at, "raw_html_block")
        return None


def cells(row: str) -> list[str]:
    """The cells of a table row; pipes in code spans or behind a backslash do not divide."""
    row = row.strip()
    row = row[1:] if row.startswith("|") else row
    if "\\" not in row and "`" not in row:
        parts = [x.strip() for x in row.split("|")]
        return parts if parts[-1] else parts[:-1]
    out, start, k, code = [], 0, 0, ""
    while k < len(row):
        c = row[k]
        if c == "\\":
            k += 2
            continue
        if c == "`":
            run = re.match("`+", row[k:]).group()
            code = "" if code == run else code or (run if row.find(run, k + len(run)) >= 0 else "")
            k += len(run)
            continue
        if c == "|" and not code:
            out.append(row[start:k].strip())
            start = k + 1
        k += 1
    if row[start:].strip():
        out.append(row[start:].strip())
    return out


def flatten(blocks: list[Block], parent: int = -1, depth: int = 0, out: list | None = None) -> list[tuple]:
    """Rows (ord, parent, depth, kind, start_line, end_line, text) of a block tree."""
    out = [] if out is None else out
    for b in blocks:
        ord_ = len(out)
        out.append((ord_, parent, depth, b.protected or b.kind, b.start, b.end, b.text))
        flatten(b.children, ord_, depth + 1, out)
    return out


def front_lines(lines: list[str]) -> int:
    """Lines of front matter at the start: from ``---`` to ``---`` or ``...``."""
    if not lines or lines[0] != "---":
        return 0
    return next((k + 1 for k in range(1, len(lines)) if lines[k] in ("---", "...")), 0)


def _split(text: str) -> list[str]:
    lines = text.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def opaque_lines(text: str) -> list[bool]:
    """Per line of a normalized document: code, its fences included, or front matter."""
    lines = _split(text)
    skipped = front_lines(lines)
    out = [k < skipped for k in range(len(lines))]
    for _, _, _, kind, first, last, _ in flatten(tree_of("\n".join(lines[skipped:]))):
        if kind in ("code", "toml_frontmatter"):
            out[skipped + first : skipped + last + 1] = [True] * (last + 1 - first)
    return out


def single_blanks(text: str) -> str:
    """``text`` with each run of blank lines as one line; those of code and front matter stay."""
    out: list[str] = []
    before = False
    for line, opaque in zip(_split(text), opaque_lines(text)):
        blank = not opaque and not line.strip()
        if not (blank and before):
            out.append(line)
        before = blank
    return "\n".join(out) + "\n"


_NUMBER = re.compile(r"[0-9]{1,9}[.)]")


def renumbered(text: str) -> str:
    """``text`` with the items of each ordered list counted on from its first number, each
    with a full stop."""
    lines = _split(text)
    skipped = front_lines(lines)

    def walk(tree: list[Block]) -> None:
        for b in tree:
            if b.kind == "list" and b.number >= 0:
                for k, item in enumerate(b.children):
                    at = skipped + item.start
                    lines[at] = _NUMBER.sub(f"{b.number + k}.", lines[at], count=1)
            walk(b.children)

    walk(tree_of("\n".join(lines[skipped:])))
    return "\n".join(lines) + "\n"


def document_rows(text: str) -> list[tuple]:
    """``flatten`` of a normalized document; front matter is one block at its start."""
    lines = _split(text)
    skipped = front_lines(lines)
    front = [Block("front_matter", 0, skipped - 1, "\n".join(lines[:skipped]))] if skipped else []
    tree = tree_of("\n".join(lines[skipped:]))

    def shift(level: list[Block]) -> None:
        for b in level:
            b.start, b.end = b.start + skipped, b.end + skipped
            shift(b.children)

    if skipped:
        shift(tree)
    return flatten(front + tree)


class Scope(NamedTuple):
    """A stretch of a document that is searched for inline regions."""

    kind: str
    start: int
    end: int


#: Scopes of one kind of region only: a table as a whole holds raw HTML, its cells all else.
_HTML = "raw_html_inline"


def _scan(text: str) -> tuple[list[Region], list[Scope]]:
    """(protected blocks, inline scopes) of a normalized document.

    Marks of containers before the first line of a block are not part of its scope.
    """
    lines = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in lines)]
    skipped = front_lines(lines)
    found: list[Region] = []
    scopes: list[Scope] = []

    def walk(tree: list[Block]) -> None:
        for b in tree:
            first, last = b.start + skipped, b.end + skipped
            begin, end = starts[first], min(starts[last + 1], len(text))
            if b.protected:
                found.append(Region(b.protected, "block", begin, end, text[begin:end]))
            elif b.kind == "table":
                scopes.append(Scope("table", begin, end))
                scopes.extend(Scope("cell", starts[k] + x, starts[k] + y) for k in range(first, last + 1) for x, y in cell_spans(lines[k]))
            elif b.kind in ("paragraph", "heading", "definition"):
                bare, own = lines[first].rstrip(), b.text.split("\n")[0].rstrip()
                at = max(0, bare.rfind(own)) if b.kind != "heading" or last > first else max(0, bare.find("#" * b.level))
                scopes.append(Scope(b.kind, begin + at, end))
            walk(b.children)

    walk(tree_of("\n".join(lines[skipped:])))
    return found, scopes


def inline_scopes(text: str) -> list[Scope]:
    """Paragraphs, headings, definitions, tables and cells of a normalized document, in order."""
    return sorted(_scan(text)[1], key=lambda s: (s.start, -s.end))


def protected_regions(text: str) -> list[Region]:
    """The protected regions of a normalized document, in order and disjoint.

    Protected blocks are whole lines with their ends, marks of containers included.  Code
    and front matter hold no region.  Inline regions are searched in each scope.
    """
    found, scopes = _scan(text)
    inline: list[Region] = []
    for kind, a, b in scopes:
        for r in inline_candidates(text[a:b], kind == "heading"):
            if kind not in ("table", "cell") or (kind == "table") == (r.kind == _HTML):
                inline.append(r._replace(start=r.start + a, end=r.end + a))
    return sorted(found + arbitrate(inline), key=lambda r: r.start)


def line_frames(text: str) -> list[tuple[str, str]]:
    """Per line of a normalized document: its containers from the outside in, and the kind of
    block it belongs to (empty between blocks)."""
    lines = _split(text)
    skipped = front_lines(lines)
    frames = [[] for _ in lines]
    kinds = ["front_matter" if k < skipped else "" for k in range(len(lines))]

    def walk(tree: list[Block]) -> None:
        for b in tree:
            own = range(skipped + b.start, skipped + b.end + 1)
            if b.kind in ("quote", "item", "footnote"):
                for k in own:
                    frames[k].append(b.kind)
            elif b.kind != "list":
                for k in own:
                    kinds[k] = b.protected or b.kind
            walk(b.children)

    walk(tree_of("\n".join(lines[skipped:])))
    return [(">".join(f), kind) for f, kind in zip(frames, kinds)]

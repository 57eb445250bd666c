"""Rendering of parsed blocks and the whole Markdown pipeline."""

from __future__ import annotations

import re
import sys

from vellumry.formatting import blocks, inline, source, units, wrap
from vellumry.formatting.blocks import Block
from vellumry.options import FormatOptions, ListSpacing

_BACKTICKS, _TILDES = re.compile("`+"), re.compile("~+")
_STRONG = re.compile(r"\*\*(?!\*)((?:(?!\*\*).)+)\*\*(?!\*)", re.S)
_STRONG_EMPHASIS = re.compile(r"\*\*\*((?:(?!\*).)+)\*\*\*", re.S)
_COMMENT = re.compile(r"\s*<!--.*-->\s*")


def unbold(text: str) -> str:
    """A heading whose only content is strong text, without the strong marks."""
    if m := _STRONG_EMPHASIS.fullmatch(text):
        return f"*{m[1]}*"
    m = _STRONG.fullmatch(text)
    return m[1] if m else text


def _is_comment(b: Block) -> bool:
    return b.kind == "raw" and b.start == b.end and bool(_COMMENT.fullmatch(b.text))


def _hard_end(b: Block) -> bool:
    return b.kind == "heading" and (b.text.endswith("\\") or b.text.endswith("  "))


def _complex(item: Block) -> bool:
    kinds = [c.kind for c in item.children]
    return "list" in kinds or "code" in kinds or kinds.count("paragraph") > 1


class Renderer:
    def __init__(self, options: FormatOptions, defs: inline.Definitions, wrapper: wrap.Wrapper) -> None:
        self.options, self.defs, self.wrapper = options, defs, wrapper

    def inline(self, text: str, starts_line: bool = True, heading: bool = False) -> str:
        return inline.normalize(text, self.defs, self.options.smartquotes, self.options.ellipses, starts_line, heading)

    def document(self, children: list[Block], first: str = "", other: str = "") -> str:
        out: list[str] = []
        for k, b in enumerate(children):
            if k and self._parts(children[k - 1], b):
                out.append(other.rstrip())
            out.append(self.block(b, other if k else first, other))
        return "\n".join(out)

    def _parts(self, a: Block, b: Block) -> bool:
        """Whether a blank line stands between two blocks of a document."""
        tight = b.start <= a.end + 1
        if _hard_end(a) or _hard_end(b) and tight:
            return False
        if a.kind in ("heading", "footnote"):
            return True
        if a.kind == b.kind == "definition":
            return False
        if not tight:
            return True
        if _is_comment(a) or (_is_comment(b) and a.kind not in ("list", "table")):
            return False
        if "break" in (a.kind, b.kind) or "raw" in (a.kind, b.kind) or a.protected or b.protected:
            return False
        follows = {"paragraph": ("list", "code", "table", "quote"), "code": ("paragraph", "list", "code"), "list": ("list", "quote", "code")}
        return b.kind not in follows.get(a.kind, ())

    def block(self, b: Block, first: str, other: str) -> str:
        return getattr(self, "_" + b.kind)(b, first, other)

    @staticmethod
    def _prefixed(lines: list[str], first: str, other: str) -> str:
        return "\n".join(((other if k else first) + x) if x else (other if k else first).rstrip() for k, x in enumerate(lines))

    def _raw(self, b: Block, first: str, other: str) -> str:
        return self._prefixed(b.text.split("\n"), first, other)

    def _paragraph(self, b: Block, first: str, other: str) -> str:
        return self.wrapper(b.info + self.inline(b.text), first, other)

    def _heading(self, b: Block, first: str, other: str) -> str:
        text = self.inline(b.text, False, True)
        if self.options.cleanups:
            text = unbold(text)
        text = text.replace("  \n", "\\\n").replace("\n", " ") if not _hard_end(b) else text
        return f"{first}{'#' * b.level} {text}".rstrip(" ")

    def _break(self, b: Block, first: str, other: str) -> str:
        return f"{first}* * *"

    def _definition(self, b: Block, first: str, other: str) -> str:
        m = blocks.DEFINITION.match(b.text)
        label = b.text[: b.text.index("]:", m.end(1))]
        return first + label.lower() + b.text[len(label) :]

    def _code(self, b: Block, first: str, other: str) -> str:
        mark = b.fence[:1] or "`"
        runs = (_TILDES if mark == "~" else _BACKTICKS).findall(b.text)
        fence = mark * max(3, len(b.fence), *(len(r) + 1 for r in runs if len(r) >= 3)) if runs else mark * max(3, len(b.fence))
        body = b.text.rstrip("\n")
        return self._prefixed([fence + b.info, *(body.split("\n") if body else []), fence], first, other)

    def _table(self, b: Block, first: str, other: str) -> str:
        head, rule, *rows = b.text.split("\n")
        n = len(blocks.cells(head))
        align = units.separator_row("|" + "|".join(blocks.cells(rule)) + "|")
        body = [(blocks.cells(r) + [""] * n)[:n] for r in [head, *rows]]
        line = lambda row: "| " + " | ".join(inline.unmask(self.inline(c, False)) for c in row) + " |"
        return self._prefixed([line(body[0]), align, *map(line, body[1:])], first, other)

    def _quote(self, b: Block, first: str, other: str) -> str:
        out: list[str] = []
        for k, c in enumerate(b.children):
            if k and not (c.kind == "quote" and c.start <= b.children[k - 1].end + 1) and not (_hard_end(b.children[k - 1])):
                out.append(other + "> ")
            out.append(self.block(c, (other if k else first) + "> ", other + "> "))
        return "\n".join(out) or first + ">"

    def _list(self, b: Block, first: str, other: str) -> str:
        spacing = self.options.list_spacing
        loose = b.loose if spacing is ListSpacing.PRESERVE else spacing is ListSpacing.LOOSE or any(map(_complex, b.children))
        out: list[str] = []
        for k, item in enumerate(b.children):
            if k and loose:
                out.append(other.rstrip())
            mark = f"{b.number + k}. " if b.number >= 0 else f"{b.marker} "
            out.append(self._item(item, (other if k else first) + mark, other + " " * len(mark), loose))
        return "\n".join(out)

    def _item(self, b: Block, first: str, other: str, loose: bool) -> str:
        if not b.children:
            return first.rstrip()
        if b.info:
            b.children[0].info = b.info
        spacing = self.options.list_spacing
        gap = lambda x, y: y.start > x.end + 1
        any_gap = any(gap(x, y) for x, y in zip(b.children, b.children[1:]))
        out: list[str] = []
        for k, c in enumerate(b.children):
            if k:
                before = b.children[k - 1]
                if spacing is ListSpacing.LOOSE:
                    parts = True
                elif spacing is ListSpacing.TIGHT:
                    parts = c.kind == "code" or c.kind == "list" and (c.loose or any(map(_complex, c.children))) or gap(before, c)
                else:
                    parts = gap(before, c) if c.kind in ("list", "code") and loose else any_gap
                if _hard_end(before) or _hard_end(c) or _is_comment(before) and not gap(before, c):
                    parts = False
                if before.kind == "heading" and not _hard_end(before):
                    parts = True
                if parts:
                    out.append(other.rstrip())
            out.append(self.block(c, other if k else first, other))
        return "\n".join(out)

    def _footnote(self, b: Block, first: str, other: str) -> str:
        head = f"{first}[^{b.info}]: "
        return self.document(b.children, head, other + "    ") if b.children else head.rstrip()


def definitions(tree: list[Block], out: inline.Definitions | None = None) -> inline.Definitions:
    """Reference definitions by lower-cased label; of several the last one counts."""
    out = {} if out is None else out
    for b in tree:
        if b.kind == "definition" and (m := blocks.DEFINITION.match(b.text)):
            out[inline.label_key(m[1])] = (m[2], m[3] or "")
        definitions(b.children, out)
    return out


#: Frames of the interpreter for nested blocks; the reader and the renderer call themselves.
FRAMES = 100_000


def _filled(body: str, options: FormatOptions, wrapper: wrap.Wrapper | None) -> str:
    if options.dedent:
        body = source.dedent(body)
    front, rest = source.split_front_matter(body)
    lead = ""
    if not front:
        lead, rest = source.leading_blanks(rest)
    rest, authored = inline.escape_reserved(rest)
    tree = blocks.parse(units.space_blocks_in_tags(rest))
    own = wrapper or wrap.line_wrapper(options.width, options.semantic)
    done = Renderer(options, definitions(tree), own).document(tree)
    joint = "\n" if front and rest.startswith("\n") else ""
    done = inline.unmask(done)
    return front + joint + lead + (done.translate(authored) if authored else done)


def checked_markdown(text: str, options: FormatOptions = FormatOptions(), wrapper: wrap.Wrapper | None = None) -> tuple[str, str | None]:
    """(document in normal form, None), or (source with normalized line ends, what failed)."""
    body, had_bom = source.normalize(text)
    before = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(max(before, FRAMES))
        return source.finalize(_filled(body, options, wrapper), had_bom), None
    except Exception as e:  # noqa: BLE001 - one document must not end the job; the cause is reported
        return source.finalize(body, had_bom), f"{type(e).__name__}: {e}"
    finally:
        sys.setrecursionlimit(before)


def fill_markdown(text: str, options: FormatOptions = FormatOptions(), wrapper: wrap.Wrapper | None = None) -> str:
    """A Markdown document in normal form; ``checked_markdown`` without the cause of a failure."""
    return checked_markdown(text, options, wrapper)[0]


def checked_text(text: str, options: FormatOptions = FormatOptions()) -> tuple[str, str | None]:
    """(formatted document, cause of a failure or None): Markdown or, with ``plaintext``, filled text."""
    if options.plaintext:
        mode = wrap.Wrap.WRAP if options.width > 0 else wrap.Wrap.NONE
        return wrap.fill_text(text, mode, options.width), None
    return checked_markdown(text, options)


def format_text(text: str, options: FormatOptions = FormatOptions()) -> str:
    """A document formatted as Markdown or, with ``plaintext``, filled as plain text."""
    return checked_text(text, options)[0]

"""Wrapping: greedy lines, sentence lines, paragraphs, hard breaks and tags."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from enum import Enum
from itertools import accumulate

from vellumry.formatting import units
from vellumry.formatting.units import SPACES, strip
from vellumry.options import SHORT_LINE

#: (text, first indent, other indent) -> text
Wrapper = Callable[[str, str, str], str]
Splitter = Callable[[str], list[str]]

_NUMBER = re.compile(r"(\d+)([.)])")
_BULLET = re.compile(r"[-*+>]|#+")
_HARD_BREAK = re.compile(r"\\\n|  +\n")
_MAY_HOLD_TAGS = re.compile(r"[|{}\-]")
_PARAGRAPHS = re.compile(r"\n{2,}")
_MISPLACED_CLOSER = re.compile(r"%\}\s*(\{%\s*/)|#\}\s*(\{#\s*/)|\}\}\s*(\{\{\s*/)|-->\s*(<!--\s*/)")


def escape_word(word: str) -> str:
    """``word`` so that it cannot start a list, quote or heading at the start of a line."""
    if m := _NUMBER.fullmatch(word):
        return f"{m[1]}\\{m[2]}"
    return "\\" + word if _BULLET.fullmatch(word) else word


def escape_first(line: str) -> str:
    head, space, rest = line.partition(" ")
    return escape_word(head) + space + rest


def greedy_lines(text: str, width: int, first: int = 0, other: int = 0, splitter: Splitter = units.atomic_words, markdown: bool = False, collapse: bool = True, drop: bool = True) -> list[str]:
    """Lines of at most ``width``; ``first`` and ``other`` are columns already taken.

    A word longer than the line stands alone.  In Markdown the first word of each line
    but the first is escaped where it would start a block.  Width 0 does not wrap.
    """
    if width <= 0:
        if collapse:
            text = SPACES.sub(" ", text)
        if drop:
            text = strip(text)
        return [text] if text else []
    if collapse and (splitter is not units.plain_words or first + len(text) <= width):
        text = units.collapse(text)  # words without spaces inside need it only to be returned as they are
        if first + len(text) <= width and "}{" not in text and "><" not in text:
            return [text] if text else []  # it fits as it is: no words to count
    words = splitter(text)
    ends = list(accumulate(len(w) + 1 for w in words))  # where each word ends on an endless line
    out: list[str] = []
    k, taken = 0, first if words and first + len(words[0]) <= width else other
    while k < len(words):
        head = escape_word(words[k]) if markdown and out else words[k]
        room = width - taken + 1 - (len(head) - len(words[k])) + (ends[k - 1] if k else 0)
        stop = max(k + 1, bisect_right(ends, room, k))
        out.append(" ".join([head, *words[k + 1 : stop]]))
        k, taken = stop, other
    return out


def wrap_paragraph(text: str, width: int, first_indent: str = "", other_indent: str = "", column: int = 0, splitter: Splitter = units.atomic_words, markdown: bool = False, collapse: bool = True, drop: bool = True) -> str:
    """One paragraph, indented; with a start ``column`` the first indent is left out."""
    lines = greedy_lines(text, width, column or len(first_indent), len(other_indent), splitter, markdown, collapse, drop)
    head = "" if column else first_indent
    done = "\n".join((other_indent if k else head) + line for k, line in enumerate(lines))
    return units.split_adjacent(done)


def sentence_lines(text: str, width: int, first_indent: str, other_indent: str, short: int = SHORT_LINE, markdown: bool = False, splitter: Splitter = units.atomic_words, split_sentences: Splitter = units.sentences_atomic) -> str:
    """One line per sentence, wrapped; a short line takes in the start of the next."""
    text = text.replace("\n", " ")
    if width <= 0:
        return first_indent + units.collapse(text)
    out: list[str] = []
    for sentence in split_sentences(text):
        last = out.pop() if out and len(out[-1]) < short else None
        start = len(other_indent if out or last else first_indent) + len(last or "")
        head, *rest = greedy_lines(sentence, width, start, len(other_indent), splitter, markdown) or [""]
        if last and head and len(last) + 1 + len(head) <= width:
            head = f"{last} {head}"
        else:
            out += [last] if last else []
            head = escape_first(head) if markdown and out else head
        out += [line for line in (head, *rest) if line]
    done = "\n".join((other_indent if k else first_indent) + line for k, line in enumerate(out))
    return units.split_adjacent(done)


class Wrap(Enum):
    """Modes of plain-text filling: indent of first line, of others, wraps at all."""

    NONE = ("", "", False)
    WRAP = ("", "", True)
    WRAP_FULL = ("", "", True)
    WRAP_INDENT = ("    ", "    ", True)
    INDENT_ONLY = ("    ", "    ", False)
    HANGING_INDENT = ("", "    ", True)
    MARKDOWN_ITEM = ("", "  ", True)


def fill_text(text: str, mode: Wrap = Wrap.WRAP, width: int = 88, extra: str = "", empty: str = "", column: int = 0, splitter: Splitter = units.atomic_words) -> str:
    """Plain text filled paragraph by paragraph; no line end is added."""
    first, other, wraps = mode.value
    first, other = extra + first, extra + other
    if not wraps:
        if mode is Wrap.INDENT_ONLY:
            return "\n".join(first + line for line in text.split("\n"))
        return text
    out = []
    for paragraph in filter(None, map(strip, _PARAGRAPHS.split(text))):
        head = other if mode in (Wrap.HANGING_INDENT, Wrap.MARKDOWN_ITEM) and out else first
        out.append(wrap_paragraph(paragraph, width, head, other, 0 if out else column, splitter))
    return f"\n{empty}\n".join(out)


def with_hard_breaks(base: Wrapper) -> Wrapper:
    """Pieces between hard breaks are wrapped each; breaks become a backslash."""

    def run(text: str, first: str, other: str) -> str:
        pieces = _HARD_BREAK.split(text) if "\n" in text else [text]
        if len(pieces) == 1:
            return base(text, first, other)
        return "\\\n".join(base(p, other if k else first, other) for k, p in enumerate(pieces))

    return run


def closers_on_own_line(text: str) -> str:
    """A closing tag behind the end of an opening tag over several lines gets its own line."""
    if "\n" not in text:
        return text
    head, *rest = text.split("\n")
    out = [head]
    for line in rest:
        m = None if units.starts_with_tag(line) else _MISPLACED_CLOSER.search(line)
        if m:
            at = m.start(m.lastindex)
            out += [line[:at].rstrip(units.WS_CHARS), line[at:].lstrip(units.WS_CHARS)]
        else:
            out.append(line)
    return "\n".join(out)


def _closing_tags(text: str) -> str:
    out: list[str] = []
    for line in text.split("\n"):
        if units.is_closing_tag(line):
            line = line.lstrip(units.WS_CHARS)
            if out and units.is_block_content(out[-1]):
                out.append("")
        out.append(line)
    return "\n".join(out)


def with_tag_lines(base: Wrapper) -> Wrapper:
    """Line breaks at template tags and table rows are kept; the rest is wrapped."""
    marks = (*units.TAG_OPEN, *units.TAG_CLOSE)

    def segments(lines: list[str]) -> list[list[str]]:
        tagged = any(units.starts_with_tag(x) or units.ends_with_tag(x) for x in lines)
        block = [units.is_table_row(x) or tagged and units.is_list_item(x) for x in lines]
        out = [[lines[0]]]
        for k in range(1, len(lines)):
            opens = units.starts_with_tag(lines[k]) and not units.is_indented(lines[k])
            if block[k] or block[k - 1] or opens or units.ends_with_tag(lines[k - 1]):
                out.append([])
            out[-1].append(lines[k])
        return out

    def wrap_segment(lines: list[str], first: str, other: str) -> str:
        if all(units.is_table_row(x) for x in lines if strip(x)):
            return "\n".join(x if not strip(x) else (other if k else first) + units.separator_row(x) for k, x in enumerate(lines))
        return base("\n".join(lines), first, other)

    def run(text: str, first: str, other: str) -> str:
        if not _MAY_HOLD_TAGS.search(text) or "|" not in text and not any(mark in text for mark in marks):
            return base(text, first, other)
        parts = segments(text.split("\n"))
        if len(parts) == 1:
            return closers_on_own_line(base(text, first, other))
        out = []
        for k, lines in enumerate(parts):
            if k:
                before = parts[k - 1]
                tag_before, tag_here = units.ends_with_tag(before[-1]), units.starts_with_tag(lines[0]) and not units.is_indented(lines[0])
                if tag_before and any(map(units.is_block_content, lines)) or tag_here and any(map(units.is_block_content, before)):
                    out.append("")
            out.append(wrap_segment(lines, other if k else first, other))
        return closers_on_own_line(_closing_tags("\n".join(out)))

    return run


def line_wrapper(width: int, semantic: bool = False, markdown: bool = True, splitter: Splitter = units.atomic_words, split_sentences: Splitter = units.sentences_atomic) -> Wrapper:
    """The wrapper of paragraphs: sentence lines or filled lines."""

    def base(text: str, first: str, other: str) -> str:
        if semantic:
            return sentence_lines(text, width, first, other, markdown=markdown, splitter=splitter, split_sentences=split_sentences)
        return wrap_paragraph(text, width, first, other, splitter=splitter, markdown=markdown)

    return with_hard_breaks(with_tag_lines(base)) if markdown else base

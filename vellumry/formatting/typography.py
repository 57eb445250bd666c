"""Typographic quotes, apostrophes and ellipses."""

from __future__ import annotations

import re

from vellumry.formatting.units import SPACES, TEMPLATE_TAG, WS_CHARS

_QUOTE = re.compile("[\"']")
#: Quote -> its typographic pair, and what ends the passage that it opens.
_PAIRS = {'"': ("“", "”", re.compile("[\"“”]")), "'": ("‘", "’", re.compile("['‘’]"))}
# What may stand before an opening quote and behind a closing one.
_BEFORE_QUOTE = frozenset(WS_CHARS + "—")
_BEHIND_QUOTE = frozenset(WS_CHARS + ".,;:?!—)")
_DOTS = re.compile(r"\.{3,}")
# What dots may lean on, what may stand between dots and the next word, and
# what may follow.
_QUOTES = frozenset("\"'‘’“”")
_DOT_MARKS = frozenset(".,;:?!)-—\"'‘’“”")
_MAY_FOLLOW = frozenset(",:;?!)-—\"'”’>")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _holds_blank_line(text: str, start: int, stop: int) -> bool:
    at = text.find("\n", start, stop)
    while at >= 0:
        end = text.find("\n", at + 1, stop)
        if end >= 0 and not text[at:end].strip(WS_CHARS):
            return True
        at = end
    return False


def _pairs(text: str) -> list[tuple[int, int]]:
    """Opening and closing positions of quoted passages, from the left.

    The character behind a passage belongs to it: it cannot open the next one, unless that
    one begins its line.
    """
    found, free = [], 0
    for m in _QUOTE.finditer(text):
        at = m.start()
        if at < free or at and text[at - 1] != "\n" and not (at > free and text[at - 1] in _BEFORE_QUOTE):
            continue
        end = _PAIRS[text[at]][2].search(text, at + 1)
        if end is None or end.group() != text[at] or end.end() < len(text) and text[end.end()] not in _BEHIND_QUOTE:
            continue
        free = end.end() + 1
        if not _holds_blank_line(text, at, end.start()):
            found.append((at, end.start()))
    return found


def _apostrophe(word: str) -> str:
    """An apostrophe between word characters, or behind a plural, where it is the only one."""
    at = word.find("'")
    if at < 1 or word.find("'", at + 1) >= 0:
        return word
    if at + 1 < len(word):
        good = _is_word(word[at - 1]) and _is_word(word[at + 1])
    else:
        good = word[at - 1] in "sS" and all(map(_is_word, word[:at]))
    return f"{word[:at]}’{word[at + 1 :]}" if good else word


def _quotes(text: str) -> str:
    if '"' not in text and "'" not in text:
        return text
    while found := _pairs(text):  # a pair may uncover the one beside or inside it
        chars = list(text)
        for start, end in found:
            chars[start], chars[end], _ = _PAIRS[text[start]]
        text = "".join(chars)
    if "'" not in text:
        return text
    out, pos = [], 0
    for gap in SPACES.finditer(text):
        out += [_apostrophe(text[pos : gap.start()]), gap.group()]
        pos = gap.end()
    return "".join([*out, _apostrophe(text[pos:])])


def outside(pattern: re.Pattern, change, text: str) -> str:
    """``change`` applied between the matches of ``pattern``."""
    out, pos = [], 0
    for m in pattern.finditer(text):
        out += [change(text[pos : m.start()]) if m.start() > pos else "", m.group()]
        pos = m.end()
    return "".join([*out, change(text[pos:]) if pos < len(text) else ""])


def smart_quotes(text: str) -> str:
    """Straight quotes and apostrophes as typographic ones, outside template tags.

    Length is unchanged.  Quotations over a paragraph break stay as they are.
    """
    if '"' not in text and "'" not in text:
        return text
    return outside(TEMPLATE_TAG, _quotes, text)


def ellipses(text: str) -> str:
    """Three dots as one character, set off from words; longer runs of dots stay.

    Dots lean on a word, a quote or the start of a line; one mark may follow them (a
    fourth dot counts as one).  What was looked at for one run is not used for the next.
    """
    out, done, free = [], 0, 0
    for run in _DOTS.finditer(text):
        at, end = run.span()
        gap = at
        while gap > free and text[gap - 1] in WS_CHARS:
            gap -= 1
        lean = text[gap - 1] if gap > free else ""
        if not lean or not (_is_word(lean) or lean in _QUOTES):
            lean = ""
            gap = next((k for k in range(gap, at + 1) if k == 0 or text[k - 1] == "\n"), -1)
            if gap < 0:
                continue
        stop = at + 3 + (text[at + 3 : at + 4] in _DOT_MARKS and at + 3 < len(text))
        mark, free = text[at + 3 : stop], stop
        while free < len(text) and text[free] in WS_CHARS:
            free += 1
        behind = text[free : free + 1]
        if end - at > 4 or behind and not (_is_word(behind) or behind in _MAY_FOLLOW):
            continue
        before = text[gap:at] or (" " if lean and _is_word(lean) else "")
        space = text[stop:free] or (" " if behind and _is_word(behind) and not mark else "")
        out += [text[done:gap], before, "…", mark, space]
        done = free
    return "".join([*out, text[done:]])

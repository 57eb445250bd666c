"""Inline content of a paragraph: links, emphasis, typography and protected regions.

A paragraph stays a string throughout.  Protected regions and link targets are taken
out behind marks of one character and come back with their white space masked, so that
wrapping measures them by their authored width and never breaks them.
"""

from __future__ import annotations

import re

from vellumry.formatting import typography
from vellumry.formatting.regions import inline_regions

#: Stand-ins: a protected region, a link target, and masked white space inside them.
REGION, TARGET, SPACE, BREAK, TAB = "", "", "", "", ""
RESERVED = re.compile("[-]")
_MASK = str.maketrans({" ": SPACE, "\n": BREAK, "\t": TAB})

_DESTINATION = re.compile(r"\(\s*(<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S)
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.S)
_BARE_URL = re.compile(r"(?:https?://|www\.)[^\s<>-\[\]]*[^\s<>?!.,:;*_~'\")\]\[-]")
_LINE_START = re.compile(r"\n[ \t]+")
_PERIOD = re.compile(r"\\\.")
_NUMBERED = re.compile(r"\A\d+\\\.")
_UNDERSCORES = re.compile(r"_+")
_LOOSE_UNDERSCORE = re.compile(r"(?<![^\W_])_|_(?![^\W_])")
_PUNCTUATION = re.compile(r"[^\w\s]|_")

#: What takes no part in typography.
_SKIPPED = re.compile(f"[*\\[\\]~{REGION}{TARGET}]")
#: Text without any of these is in normal form.
_MARKUP = re.compile(r"[\[`$<{\\_\"']|\.\.\.|\n[ \t]|[\ue000-\ue004]")

#: label -> (destination, title with its quotes or "")
Definitions = dict[str, tuple[str, str]]


def escape_reserved(text: str) -> tuple[str, dict[int, str]]:
    """``text`` with other private characters, that it does not hold, for authored
    stand-ins; and the table that brings them back."""
    authored = sorted(set(RESERVED.findall(text)))
    if not authored:
        return text, {}
    held = set(text)
    spare = (chr(n) for n in range(0xF0000, 0xFFFFE) if chr(n) not in held)
    pairs = [(c, next(spare)) for c in authored]
    return text.translate({ord(c): s for c, s in pairs}), {ord(s): c for c, s in pairs}


def label_key(label: str) -> str:
    return " ".join(label.split()).lower()


def mask(text: str) -> str:
    return text.translate(_MASK)


def unmask(text: str) -> str:
    for mark, c in ((SPACE, " "), (BREAK, "\n"), (TAB, "\t")):
        if mark in text:
            text = text.replace(mark, c)
    return text


def _title(quoted: str | None) -> str:
    if not quoted:
        return ""
    inner = quoted[1:-1]
    return f' "{inner}"' if '"' not in inner or "\\\"" in inner else f" {quoted}"


def _links(text: str, defs: Definitions, targets: list[str]) -> str:
    """Links and images in their normal form; targets are replaced by marks."""
    if "[" not in text:
        return text
    levels: list[list[str]] = [[]]
    marks: list[str] = []
    k = 0

    def target(source: str) -> str:
        targets.append(source)
        return TARGET

    while k < len(text):
        c = text[k]
        if c == "\\" and k + 1 < len(text):
            levels[-1].append(text[k : k + 2])
            k += 2
        elif c == "[":
            image = bool(levels[-1]) and levels[-1][-1] == "!" and (k < 2 or text[k - 2] != "\\")
            if image:
                levels[-1].pop()
            marks.append("![" if image else "[")
            levels.append([])
            k += 1
        elif c == "]" and marks:
            inner, mark = "".join(levels.pop()), marks.pop()
            done, k = None, k + 1
            if inner.startswith("^"):
                pass
            elif text[k : k + 1] == "(" and (m := _DESTINATION.match(text, k)):
                done, k = f"{mark}{inner}]" + target(f"({m[1]}{_title(m[2])})"), m.end()
            else:
                m = _LABEL.match(text, k)
                key = label_key(m[1]) if m and m[1].strip() else label_key(inner)
                if key in defs:
                    where, title = defs[key]
                    k = m.end() if m else k
                    if mark == "![":
                        done = f"{mark}{inner}]" + target(f"({where}{_title(title)})")
                    else:
                        done = f"{mark}{inner}]" + target("[]" if key == inner else f"[{key}]")
            levels[-1].append(done if done is not None else f"{mark}{inner}]")
        else:
            levels[-1].append(c)
            k += 1
    while marks:
        inner, mark = "".join(levels.pop()), marks.pop()
        levels[-1].append(mark + inner)
    return "".join(levels[0])


def _emphasis(text: str) -> str:
    """Emphasis with underscores written with asterisks."""
    if not _LOOSE_UNDERSCORE.search(text):
        return text  # underscores inside words neither open nor close
    runs = []
    for m in _UNDERSCORES.finditer(text):
        a, b = m.span()
        if a and text[a - 1] == "\\":
            a += 1
            if a == b:
                continue
        before, after = text[a - 1 : a] or " ", text[b : b + 1] or " "
        left = not after.isspace() and (not _PUNCTUATION.match(after) or before.isspace() or bool(_PUNCTUATION.match(before)))
        right = not before.isspace() and (not _PUNCTUATION.match(before) or after.isspace() or bool(_PUNCTUATION.match(after)))
        opens = left and (not right or bool(_PUNCTUATION.match(before)))
        closes = right and (not left or bool(_PUNCTUATION.match(after)))
        runs.append([a, b - a, opens, closes])
    chars = list(text)
    stack: list[list] = []
    for run in runs:
        at, size, opens, closes = run
        used = 0
        while closes and size - used and stack:
            opener = stack[-1]
            n = 2 if opener[1] >= 2 and size - used >= 2 else 1
            start = opener[0] + opener[1] - n
            chars[start : start + n] = "*" * n
            chars[at + used : at + used + n] = "*" * n
            opener[1] -= n
            used += n
            if not opener[1]:
                stack.pop()
        if opens and size - used:
            stack.append([at + used, size - used])
    return "".join(chars)


def _typography(text: str, stand_ins: list[str], quotes: bool, dots: bool) -> str:
    if quotes and ('"' in text or "'" in text) and not _SKIPPED.search(text):
        text = typography.smart_quotes(text)
    elif quotes and ('"' in text or "'" in text):
        # Only text takes part: markup is skipped, a region counts as its stand-in.
        where, seen, k = [], [], 0
        for at, c in enumerate(text):
            if c == REGION:
                seen.append(stand_ins[k])
                where.append(-1)
                k += 1
            elif c not in "*[]" + TARGET and not (c == "~" and "~~" in text[max(0, at - 1) : at + 2]):
                seen.append(c)
                where.append(at)
        new = typography.smart_quotes("".join(seen))
        chars = list(text)
        for at, c in zip(where, new):
            if at >= 0:
                chars[at] = c
        text = "".join(chars)
    if dots and "..." in text:
        text = "".join(p if p[:1] in (REGION, TARGET) else typography.ellipses(p) for p in re.split(f"([{REGION}{TARGET}])", text))
    return text


def normalize(text: str, defs: Definitions, quotes: bool = False, dots: bool = False, starts_line: bool = True, heading: bool = False) -> str:
    """The inline source in normal form, with protected white space masked.

    An escaped full stop loses its backslash, unless it keeps a number at the start of a
    line from becoming a list.
    """
    if not _MARKUP.search(text):
        return text
    regions = inline_regions(text, heading)
    out, pos, sources, stand_ins = [], 0, [], []
    for r in regions:
        out += [text[pos : r.start], REGION]
        sources.append(mask(r.source))
        last = r.source.rstrip("`")[-1:] if r.kind == "code_span" else ""
        stand_ins.append(last if last and (last.isalnum() or last == "_") else " ")
        pos = r.end
    text = "".join([*out, text[pos:]])
    if "\n " in text or "\n\t" in text:
        text = _LINE_START.sub("\n", text)  # outside regions, indents of lines mean nothing
    targets: list[str] = []
    text = _links(text, defs, targets)
    if "_" in text:
        text = "".join(p if k % 2 else _emphasis(p) for k, p in enumerate(_split_urls(text)))
    if quotes or dots:
        text = _typography(text, stand_ins, quotes, dots)
    if "\\." in text:
        m = _NUMBERED.match(text) if starts_line else None
        text = (m.group() if m else "") + _PERIOD.sub(".", text[m.end() if m else 0 :])
    if not sources and not targets:
        return text
    # Marks of regions inside link targets were never seen by the link pattern.
    feed = {REGION: iter(sources), TARGET: iter(targets)}
    return "".join(next(feed[c]) if c in feed else c for c in re.split(f"([{REGION}{TARGET}])", text))


def _split_urls(text: str) -> list[str]:
    if "://" not in text and "www." not in text:
        return [text]
    out, pos = [], 0
    for m in _BARE_URL.finditer(text):
        out += [text[pos : m.start()], m.group()]
        pos = m.end()
    return [*out, text[pos:]]

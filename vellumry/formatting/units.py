"""Units of text: white space, words and kinds of lines."""

from __future__ import annotations

import re

# The characters with the property White_Space.
WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WS_CHARS = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WS}]", c))
SPACES = re.compile(f"[{WS}]+")
_NON_SPACE = re.compile(f"[^{WS}]+")

# Template tags and comments that wrapping never breaks.
SINGLE_TAGS = [r"\{%.*?%\}", r"\{#.*?#\}", r"\{\{.*?\}\}", r"<!--.*?-->"]
TAG_OPEN = ("{%", "{#", "{{", "<!--")
TAG_CLOSE = ("%}", "#}", "}}", "-->")
CLOSING_TAG = ("{% /", "{# /", "{{ /", "<!-- /")

# Constructs that count as one word, in order of precedence.
CODE_AND_LINKS = [r"````[\s\S]*?````", r"```[\s\S]*?```", r"``.+?``", r"`[^`]+`", r"\[[^\]]*\](?:\([^)]*\)|\[[^\]]*\])?"]
PAIRED_TAGS = [
    r"\{%\s*[^/%\s][^%]*%\}\s*\{%\s*/[^%]*%\}",
    r"\{#\s*[^/#\s][^#]*#\}\s*\{#\s*/[^#]*#\}",
    r"\{\{\s*[^/}\s][^}]*\}\}\s*\{\{\s*/[^}]*\}\}",
    r"<!--\s*[^/\-\s][^-]*(?:-[^-]+)*-->\s*<!--\s*/[^-]*(?:-[^-]+)*-->",
]
HTML_TAGS = [r"<[a-zA-Z][^>]*>", r"</[a-zA-Z][^>]*>"]
AUTOLINKS = [r"<[A-Za-z][A-Za-z0-9+.\-]*:[^\s<>]*>", r"<[^\s<>@]+@[^\s<>]+>", r"(?:https?://|www\.)[^\s<>]*[^\s<>?!.,:;*_~'\")\]]"]
ATOM = "|".join(CODE_AND_LINKS + PAIRED_TAGS + SINGLE_TAGS + HTML_TAGS)
INLINE_ATOM = "|".join(CODE_AND_LINKS + AUTOLINKS)

_WORDS = re.compile(f"(?:{ATOM}|[^{WS}])+", re.S)
_INLINE_WORDS = re.compile(f"(?:{INLINE_ATOM}|[^{WS}])+", re.S)
TEMPLATE_TAG = re.compile("|".join(SINGLE_TAGS), re.S)

_ADJACENT = re.compile(r"(%\})(\{%)|(#\})(\{#)|(\}\})(\{\{)|(-->)(<!--)")
_SPACED = re.compile(r"(%\}) (\{%)|(#\}) (\{#)|(\}\}) (\{\{)|(-->) (<!--)")

_SEPARATOR_ROW = re.compile(rf"\|(?:[{WS}]*:?-+:?[{WS}]*\|)+")
_LIST_ITEM = re.compile(r"(?:[-*+]|[0-9]{1,9}[.)])[ \t]")
#: The end of a sentence: two letters or more, the last a small one, then a terminator.
SENTENCE_END = re.compile(r"(?<![\w])[^\W\d_]+(?P<last>[^\W\d_])(?:[.?!]['\"’”)]?|['\"’”)][.?!]) *\Z")


def strip(text: str) -> str:
    """``text`` without white space at both ends."""
    return text.strip(WS_CHARS)


def collapse(text: str) -> str:
    """``text`` with each run of white space as one space, and none at the ends."""
    text = strip(text)
    if text.isascii() and "  " not in text and text.isprintable():
        return text
    return SPACES.sub(" ", text)


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a final line end adds no line."""
    parts = text.split("\n")
    if parts and parts[-1] == "":
        parts.pop()
    return [p[:-1] if p.endswith("\r") else p for p in parts]


def plain_words(text: str) -> list[str]:
    return _NON_SPACE.findall(text)


def join_adjacent(text: str) -> str:
    """One space between a closing tag and an opening tag of its kind."""
    if "}{" not in text and "><" not in text:
        return text
    return _ADJACENT.sub(lambda m: " ".join(filter(None, m.groups())), text)


def split_adjacent(text: str) -> str:
    """The reverse of ``join_adjacent``; a single authored space goes as well."""
    if "} {" not in text and "> <" not in text:
        return text
    return _SPACED.sub(lambda m: "".join(filter(None, m.groups())), text)


_MAY_HOLD_ATOMS = re.compile(r"[`\[<{]")
_MAY_HOLD_INLINE = re.compile(r"[`\[<]|://|www\.")
#: Openings with the mark that each needs behind it, and the character without which an
#: opening is none.  No other construct needs that character at such a place.
_LINK_OPENINGS = [("[", "]", re.compile(r"\[")), ("](", ")", re.compile(r"(?<=\])\("))]
_OPENINGS = [
    *_LINK_OPENINGS, ("<", ">", re.compile("<")), ("<!--", "-->", re.compile("<(?=!--)")),
    ("{%", "%}", re.compile(r"(?<=\{)%")), ("{#", "#}", re.compile(r"(?<=\{)#")), ("{{", "}}", re.compile(r"\{(?=\{)")),
]


#: Shorter texts are scanned as they are: the words are the same, and the scan is cheap.
_SHORT = 1000


def _closable(text: str, openings: list[tuple[str, str, re.Pattern]]) -> str:
    """``text``, of equal length, without the openings behind the last of their closing
    marks: each of them would be followed to the end of the text, for nothing."""
    for mark, close, needed in openings:
        if mark not in text:
            continue
        at = text.find(mark, text.rfind(close) + 1)
        if at >= 0:
            text = text[:at] + needed.sub("\0", text[at:])
    return text


def atomic_words(text: str) -> list[str]:
    """Words, where code, links, template tags and HTML tags stay whole."""
    if not _MAY_HOLD_ATOMS.search(text):
        return plain_words(text)
    text = join_adjacent(text)
    closable = text if len(text) < _SHORT else _closable(text, _OPENINGS)
    if closable is text:
        return _WORDS.findall(text)
    return [text[m.start() : m.end()] for m in _WORDS.finditer(closable)]


#: Characters a sentence can end on; words with other ends need no look.
_LAST = frozenset(".?!'\"’”)")
_CANDIDATE = re.compile(f"[.?!'\"’”)](?![^{WS}])")
_WS_SET = frozenset(WS_CHARS)
_FIRST = re.compile(f"[^{WS}]")


def ends_sentence(word: str) -> bool:
    if word[-1:] not in _LAST and word[-1:] != " ":
        return False
    m = SENTENCE_END.search(word)
    return bool(m) and m["last"].islower()


def sentences_plain(text: str, min_length: int = 0) -> list[str]:
    """Sentences with white space collapsed; ``min_length`` counts UTF-8 bytes."""
    out: list[str] = []
    held: list[str] = []
    size = -1
    for word in plain_words(text):
        held.append(word)
        size += len(word.encode()) + 1
        if size >= min_length and ends_sentence(word):
            out.append(" ".join(held))
            held, size = [], -1
    if held:
        out.append(" ".join(held))
    return out


def sentences_atomic(text: str, min_length: int = 0) -> list[str]:
    """Sentences as slices of the text, never cut inside code, links or addresses."""
    out: list[str] = []
    if not min_length and not _MAY_HOLD_INLINE.search(text):
        # Without atoms only words that end on a mark need a look.
        m = _FIRST.search(text)
        for mark in _CANDIDATE.finditer(text):
            end = mark.end()
            word = end - 1
            while word and text[word - 1] not in _WS_SET:
                word -= 1
            if m and ends_sentence(text[word:end]):
                out.append(text[m.start() : end])
                m = _FIRST.search(text, end)
        if m:
            out.append(text[m.start() :].rstrip(WS_CHARS))
        return out
    start, size, end = None, -1, 0
    for m in _INLINE_WORDS.finditer(text if len(text) < _SHORT else _closable(text, _LINK_OPENINGS)):
        if start is None:
            start = m.start()
        end = m.end()
        size += end - m.start() + 1
        if size >= min_length and ends_sentence(text[m.start() : end]):
            out.append(text[start:end])
            start, size = None, -1
    if start is not None:
        out.append(text[start:end])
    return out


def first_sentence(text: str, min_length: int = 0) -> str:
    found = sentences_plain(text, min_length)
    return found[0] if found else text


def is_table_row(line: str) -> bool:
    return line.lstrip(WS_CHARS).startswith("|")


def is_table_separator(line: str) -> bool:
    return bool(_SEPARATOR_ROW.fullmatch(strip(line)))


def is_list_item(line: str) -> bool:
    return bool(_LIST_ITEM.match(line.lstrip(WS_CHARS)))


def is_block_content(line: str) -> bool:
    return is_table_row(line) or is_list_item(line)


def starts_with_tag(line: str) -> bool:
    return line.lstrip(WS_CHARS).startswith(TAG_OPEN)


def ends_with_tag(line: str) -> bool:
    return line.rstrip(WS_CHARS).endswith(TAG_CLOSE)


def is_indented(line: str) -> bool:
    return line[:1] in WS_CHARS and line != ""


def is_tag_only(line: str) -> bool:
    return not is_indented(line) and starts_with_tag(line) and ends_with_tag(line)


def is_closing_tag(line: str) -> bool:
    return line.lstrip(WS_CHARS).startswith(CLOSING_TAG)


def separator_row(line: str) -> str:
    """A table separator with three dashes a cell; other lines unchanged."""
    if not is_table_separator(line):
        return line
    cells = [strip(c) for c in strip(line)[1:-1].split("|")]
    return "| " + " | ".join(":" * c.startswith(":") + "---" + ":" * c.endswith(":") for c in cells) + " |"


def space_blocks_in_tags(text: str) -> str:
    """A blank line between a template tag on its own line and a list or table beside it.

    Comments are protected source: what stands beside them stays as close as it was.
    """
    lines = text.split("\n")
    tag = [is_tag_only(x) and not x.startswith("<") for x in lines]
    if not any(tag):
        return text
    out = lines[:1]
    for k, (before, line) in enumerate(zip(lines, lines[1:])):
        if (tag[k] and is_block_content(line)) or (is_block_content(before) and tag[k + 1]):
            out.append("")
        out.append(line)
    return "\n".join(out)

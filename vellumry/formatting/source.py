"""Source normalization and front matter."""

from __future__ import annotations

import re

from vellumry.formatting.units import WS_CHARS, strip

BOM = "﻿"
_ENDS = re.compile(r"\r\n?")


def normalize(text: str) -> tuple[str, bool]:
    """Text with LF line ends and exactly one at the end; whether it had a byte-order mark."""
    had = text.startswith(BOM)
    if had:
        text = text[1:]
    return _ENDS.sub("\n", text).rstrip("\n") + "\n", had


def finalize(text: str, had_bom: bool) -> str:
    done, _ = normalize(text)
    return BOM + done if had_bom else done


def split_front_matter(text: str) -> tuple[str, str]:
    """(front matter, body).  Front matter that never closes is the whole document."""
    lines = text.split("\n")
    start = next((k for k, x in enumerate(lines) if strip(x)), None)
    if start is None or strip(lines[start]) != "---":
        return "", text
    for k in range(start + 1, len(lines)):
        if strip(lines[k]) == "---":
            return "\n".join(lines[start : k + 1]) + "\n", "\n".join(lines[k + 1 :])
    return text, ""


def has_front_matter(text: str) -> bool:
    """Stricter: the first line with content is exactly ``---`` and a closer exists."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    start = next((k for k, x in enumerate(lines) if strip(x)), None)
    return start is not None and lines[start] == "---" and any(strip(x) == "---" for x in lines[start + 1 :])


def leading_blanks(text: str) -> tuple[str, str]:
    """A run of blank lines at the start becomes one line end."""
    rest = text
    while "\n" in rest and not strip(rest.split("\n", 1)[0]):
        rest = rest.split("\n", 1)[1]
    return ("\n", rest) if rest != text else ("", text)


def dedent(text: str) -> str:
    """Without the least common indent of lines that are not blank."""
    lines = text.split("\n")
    margin = min((len(x) - len(x.lstrip(" \t")) for x in lines if x.strip(WS_CHARS)), default=0)
    return "\n".join(x[margin:] if x.strip(WS_CHARS) else "" for x in lines)

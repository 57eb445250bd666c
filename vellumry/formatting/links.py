"""Reference links of a document and the definitions that they name."""

from __future__ import annotations

import re
from collections import Counter

from vellumry.formatting import blocks, inline, markdown, source
from vellumry.formatting.blocks import Block
from vellumry.formatting.regions import inline_regions

_USE = re.compile(r"(?<!\\)\[(?!\^)((?:[^\[\]\\]|\\.)+)\](?:\[((?:[^\[\]\\]|\\.)*)\]|(?=(\()?))", re.S)


def _labels(text: str, heading: bool, defined: inline.Definitions) -> list[str]:
    """Labels used in one scope: ``[text][label]``, ``[label][]`` and, where it is defined, ``[label]``."""
    for r in reversed(inline_regions(text, heading)):
        text = text[: r.start] + " " + text[r.end :]  # code and other protected source hold no links
    found = []
    for m in _USE.finditer(text):
        label = inline.label_key(m[2] or m[1])
        if m[2] is not None and label or m[2] is None and m[3] is None and label in defined:
            found.append(label)
    return found


def reference_links(text: str) -> list[tuple[str, str | None, int]]:
    """(label, target, uses) of a normalized document, in order of labels.

    Labels are lower-cased.  Of several definitions the last one counts; definitions and
    uses in code are none.  A label without a definition has no target.
    """
    front, rest = source.split_front_matter(text)
    tree = blocks.tree_of(rest)
    defined = markdown.definitions(tree)
    uses: Counter = Counter()

    def walk(level: list[Block]) -> None:
        for b in level:
            if b.kind in ("paragraph", "heading"):
                uses.update(_labels(b.text, b.kind == "heading", defined))
            elif b.kind == "table":
                for row in b.text.split("\n"):
                    for cell in blocks.cells(row):
                        uses.update(_labels(cell, False, defined))
            walk(b.children)

    walk(tree)
    return [(label, defined[label][0] if label in defined else None, n) for label, n in sorted(uses.items())]

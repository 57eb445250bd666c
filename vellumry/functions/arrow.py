"""Arrow functions: the formatter's pure functions on columns of documents."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from vellumry.formatting import blocks, source, typography, units, wrap
from vellumry.formatting.inline import unmask
from vellumry.formatting.links import reference_links
from vellumry.formatting.markdown import FRAMES, checked_text, format_text
from vellumry.functions import text
from vellumry.options import FormatOptions


def of(function: Callable[[str], Any], kind: T.DataType | str):
    """``function`` on a string column in Arrow batches; null stays null.

    Results are Python values of the type ``kind``; structs are dictionaries.
    """
    result = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
    arrow_type = to_arrow_type(result)

    @F.arrow_udf(result)
    def run(texts: pa.Array) -> pa.Array:
        before = sys.getrecursionlimit()
        try:
            sys.setrecursionlimit(max(before, FRAMES))
            return pa.array([None if t is None else function(t) for t in texts.to_pylist()], arrow_type)
        finally:
            sys.setrecursionlimit(before)

    return run


def where_needed(function: Callable[[str], str], c: Column, needed: Column) -> Column:
    """``function`` where ``needed`` holds; other texts are as they were and never leave the JVM as more than a null."""
    return F.coalesce(of(function, "string")(F.when(needed, c)), c)


def formatted(c: Column, options: FormatOptions = FormatOptions()) -> Column:
    """struct<formatted, error>: ``error`` says why a document kept its source.

    Marked as not deterministic, so that a filter on the result never formats twice.
    """
    run = of(lambda t: dict(zip(("formatted", "error"), checked_text(t, options))), "struct<formatted string, error string>")
    return run.asNondeterministic()(c)


def timed(c: Column, options: FormatOptions = FormatOptions()) -> Column:
    """Characters, and microseconds spent on blocks and on the whole rendering."""

    def run(document: str) -> dict:
        start = time.perf_counter_ns()
        blocks.tree_of(source.normalize(document)[0])
        parsed = time.perf_counter_ns()
        format_text(document, options)
        return {"n_chars": len(document), "parse_us": (parsed - start) // 1000, "render_us": max(0, time.perf_counter_ns() - 2 * parsed + start) // 1000}

    return of(run, "struct<n_chars bigint, parse_us bigint, render_us bigint>")(c)


def smart_quotes(c: Column) -> Column:
    return where_needed(typography.smart_quotes, c, c.contains('"') | c.contains("'"))


def ellipses(c: Column) -> Column:
    return where_needed(typography.ellipses, c, c.contains("..."))


def sentences_plain(c: Column, min_length: int = 0) -> Column:
    return of(lambda t: units.sentences_plain(t, min_length), "array<string>")(c)


def sentences_atomic(c: Column, min_length: int = 0) -> Column:
    return of(lambda t: units.sentences_atomic(t, min_length), "array<string>")(c)


def atomic_words(c: Column) -> Column:
    return of(units.atomic_words, "array<string>")(c)


def wrapped_lines(c: Column, width: int, plain: bool = True, markdown: bool = False) -> Column:
    splitter = units.plain_words if plain else units.atomic_words
    return of(lambda t: wrap.greedy_lines(t, width, splitter=splitter, markdown=markdown), "array<string>")(c)


def filled(c: Column, width: int, mode: wrap.Wrap = wrap.Wrap.WRAP, plain: bool = False) -> Column:
    splitter = units.plain_words if plain else units.atomic_words
    return of(lambda t: wrap.fill_text(t, mode, width, splitter=splitter), "string")(c)


def semantic_lines(c: Column, width: int, first: str = "", other: str = "") -> Column:
    return of(lambda t: unmask(wrap.line_wrapper(width, True)(t, first, other)), "string")(c)


REGION = "array<struct<idx int, kind string, form string, start int, end int, source string, widths array<int>>>"


def _regions(document: str) -> list[dict]:
    return [{"idx": k, "kind": r.kind, "form": r.form, "start": r.start, "end": r.end, "source": r.source, "widths": r.widths} for k, r in enumerate(blocks.protected_regions(document))]


def protected_regions(c: Column) -> Column:
    """Protected blocks and inline regions of a normalized document; null where the document
    cannot hold any."""
    return of(_regions, REGION)(F.when(text.may_hold_regions(c), c))


SCOPE = "array<struct<kind string, start int, end int>>"
FRAME = "array<struct<frames string, block string>>"


def inline_scopes(c: Column) -> Column:
    """The stretches of a normalized document that may hold inline regions."""
    return of(lambda t: [x._asdict() for x in blocks.inline_scopes(t)], SCOPE)(c)


def line_frames(c: Column) -> Column:
    """Per line of a normalized document: its containers and the kind of its block."""
    return of(lambda t: [dict(zip(("frames", "block"), x)) for x in blocks.line_frames(t)], FRAME)(c)


BLOCK = "array<struct<ord int, parent int, depth int, kind string, start_line int, end_line int, text string>>"
_NAMES = ("ord", "parent", "depth", "kind", "start_line", "end_line", "text")


def _blocks(document: str) -> list[dict]:
    return [dict(zip(_NAMES, r)) for r in blocks.document_rows(document)]


def block_rows(c: Column) -> Column:
    """The flattened block tree of a normalized document."""
    return of(_blocks, BLOCK)(c)


def opaque_flags(c: Column) -> Column:
    """Per line of a normalized document: code or front matter."""
    return of(blocks.opaque_lines, "array<boolean>")(c)


def single_blanks(c: Column) -> Column:
    """A normalized document with runs of blank lines outside code as one blank line."""
    return of(blocks.single_blanks, "string")(c)


def renumbered(c: Column) -> Column:
    """A normalized document with the items of its ordered lists counted on."""
    return of(blocks.renumbered, "string")(c)


REFERENCE = "array<struct<label string, url string, n int>>"


def reference_uses(c: Column) -> Column:
    """Reference links of a normalized document, with their targets."""
    return of(lambda t: [dict(zip(("label", "url", "n"), r)) for r in reference_links(t)], REFERENCE)(c)

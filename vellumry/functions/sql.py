"""The formatter's functions for SQL: scalar functions and table functions.

``register(spark)`` makes them known to a session; table functions take part in lateral
joins: ``SELECT d.id, s.* FROM docs d, LATERAL text_sentences(d.text) s``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from vellumry.formatting import blocks, markdown, regions, source, typography, units, wrap
from vellumry.functions import arrow
from vellumry.options import FormatOptions


class Sentences:
    """(i, sentence) of a text."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from enumerate(units.sentences_atomic(text or ""))


class Words:
    """(i, word) of a text; code, links and tags are one word."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from enumerate(units.atomic_words(text or ""))


class Blocks:
    """The block tree of a Markdown text."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        if text is not None:
            yield from blocks.document_rows(source.normalize(text)[0])


class Regions:
    """Protected inline regions of a Markdown paragraph."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for k, r in enumerate(regions.inline_regions(text or "")):
            yield k, r.kind, r.form, r.start, r.end, r.source


TABLE_FUNCTIONS = {
    "text_sentences": (Sentences, "i int, sentence string"),
    "text_words": (Words, "i int, word string"),
    "text_blocks": (Blocks, "ord int, parent int, depth int, kind string, start_line int, end_line int, text string"),
    "text_regions": (Regions, "idx int, kind string, form string, start int, end int, source string"),
}
SCALAR_FUNCTIONS = {
    "format_markdown": (markdown.format_text, "string"),
    "format_auto": (lambda t: markdown.format_text(t, FormatOptions.auto()), "string"),
    "format_plaintext": (lambda t: markdown.format_text(t, FormatOptions(plaintext=True)), "string"),
    "smart_quotes": (typography.smart_quotes, "string"),
    "ellipses": (typography.ellipses, "string"),
    "fill_text": (wrap.fill_text, "string"),
    "sentences_of": (units.sentences_plain, "array<string>"),
    "words_of": (units.atomic_words, "array<string>"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions; returns their names."""
    for name, (function, kind) in SCALAR_FUNCTIONS.items():
        spark.udf.register(name, arrow.of(function, kind))
    for name, (function, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(function, returnType=kind))
    return [*SCALAR_FUNCTIONS, *TABLE_FUNCTIONS]

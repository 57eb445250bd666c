"""Vellumry: formatting, checking and comparing large document corpora on Spark.

A corpus is a DataFrame of documents.  Formatter capabilities are column
functions or DataFrame transforms, and document structure (lines, sentences,
words, blocks, protected regions) is exposed as ordinary tables.
"""

__version__ = "0.1.0"

from vellumry.formatting.markdown import checked_markdown, fill_markdown, format_text
from vellumry.formatting.typography import ellipses, smart_quotes
from vellumry.formatting.units import atomic_words, first_sentence, plain_words, sentences_atomic, sentences_plain
from vellumry.formatting.wrap import Wrap, fill_text, line_wrapper, wrap_paragraph
from vellumry.options import FormatOptions, ListSpacing

__all__ = [
    "FormatOptions", "ListSpacing", "Wrap", "atomic_words", "checked_markdown", "ellipses", "fill_markdown", "fill_text", "first_sentence", "format_text", "line_wrapper", "plain_words",
    "sentences_atomic", "sentences_plain", "smart_quotes", "wrap_paragraph",
]

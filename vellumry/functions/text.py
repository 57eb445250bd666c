"""Native column functions: everything regular expressions and arrays can express.

White space is the Unicode property White_Space, words are Unicode words, and lines end
on LF only, whatever the defaults of the regular expression engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word characters spelled out, the same for Java and RE2.
WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NON_WS = WS.replace("[", "[^", 1)
WORD = r"[\p{L}\p{M}\p{N}_]"
NON_WORD = r"[^\p{L}\p{M}\p{N}_]"
#: A sentence ends in a word of two letters or more, the last a small one, and a terminator.
END_MARK = r"(?:[.?!]['\"’”)]?|['\"’”)][.?!])"
BOM = "﻿"


def has_bom(c: Column) -> Column:
    return c.startswith(BOM)


def normalize_source(c: Column) -> Column:
    """LF line ends, no byte-order mark, exactly one line end at the end."""
    bare = F.when(has_bom(c), F.substring(c, 2, 2**31 - 1)).otherwise(c)
    return F.concat(F.rtrim(F.regexp_replace(bare, "\r\n?", "\n"), F.lit("\n")), F.lit("\n"))


def finalize_output(c: Column, had_bom: Column) -> Column:
    done = normalize_source(c)
    return F.when(had_bom, F.concat(F.lit(BOM), done)).otherwise(done)


def is_utf8(content: Column) -> Column:
    """Strict UTF-8 verdict of a binary column."""
    return F.is_valid_utf8(content)


_LINE_WS = WS.replace(r"\n", "", 1)
#: Front matter of a normalized document: blank lines, ``---``, lines, ``---``.
FRONT_START = rf"\A(?:{WS}*\n)?{_LINE_WS}*---{_LINE_WS}*\n"
FRONT_MATTER = rf"(?s)\A(?:{WS}*\n)?({_LINE_WS}*---{_LINE_WS}*\n(?:.*?\n)??{_LINE_WS}*---{_LINE_WS}*(?:\n|\z))"


def front_matter(c: Column) -> Column:
    """Front matter with its fences, without blank lines before it; the empty string where
    there is none.  Front matter that never closes is the whole document."""
    found = F.regexp_extract(c, FRONT_MATTER, 1)
    return F.when(found != "", found).when(c.rlike(FRONT_START), c).otherwise("")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Sentences with white space collapsed (no least length)."""
    found = F.regexp_extract_all(collapse(c), F.lit(rf"(?s)(.*?(?<!{WORD})\p{{L}}+\p{{Ll}}{END_MARK}(?: |\z)|.+\z)"), 1)
    return F.transform(found, lambda x: F.rtrim(x))


def first_sentences(c: Column, n: int) -> Column:
    return F.slice(sentences(c), 1, n)


def first_sentence(c: Column) -> Column:
    return F.coalesce(F.get(sentences(c), F.lit(0)), c)


def lines(c: Column) -> Column:
    """Lines of a normalized document, without an empty last one."""
    return F.split(F.regexp_replace(c, "\n\\z", ""), "\n")


def is_table_row(c: Column) -> Column:
    return c.rlike(rf"\A{WS}*\|")


def is_table_separator(c: Column) -> Column:
    cells = F.split(F.regexp_replace(F.regexp_replace(c, rf"\A{WS}*\|", ""), rf"\|{WS}*\z", ""), r"\|")
    return c.rlike(rf"\A{WS}*\|.*\|{WS}*\z") & F.forall(cells, lambda x: x.rlike(rf"\A{WS}*:?-+:?{WS}*\z"))


def is_list_item(c: Column) -> Column:
    return c.rlike(rf"\A{WS}*(?:[-*+]|[0-9]{{1,9}}[.)])[ \t]")


def is_tag_only(c: Column) -> Column:
    return c.rlike(rf"(?s)\A(?:\{{%|\{{#|\{{\{{|<!--).*(?:%\}}|#\}}|\}}\}}|-->){WS}*\z")


def is_heading(c: Column) -> Column:
    return c.rlike(r"\A {0,3}#{1,6}(?:[ \t]|\z)")


def is_fence(c: Column) -> Column:
    return c.rlike(r"\A {0,3}(?:`{3,}[^`]*|~{3,}.*)\z")


def is_thematic_break(c: Column) -> Column:
    return c.rlike(r"\A {0,3}[*_-]") & F.regexp_replace(c, "[ \t]+", "").rlike(r"\A(?:\*{3,}|-{3,}|_{3,})\z")


def separator_row(c: Column) -> Column:
    """A table separator row with three dashes a cell; other lines unchanged."""
    inner = F.regexp_replace(F.regexp_replace(c, rf"\A{WS}*\|", ""), rf"\|{WS}*\z", "")
    cell = lambda x: F.concat(F.when(collapse(x).startswith(":"), ":").otherwise(""), F.lit("---"), F.when(collapse(x).endswith(":"), ":").otherwise(""))
    row = F.concat(F.lit("| "), F.array_join(F.transform(F.split(inner, r"\|"), cell), " | "), F.lit(" |"))
    return F.when(is_table_separator(c), row).otherwise(c)


def escape_word(c: Column) -> Column:
    numbered = F.regexp_replace(c, r"\A([0-9]+)([.)])\z", r"$1\\$2")
    return F.regexp_replace(numbered, r"\A([-*+>]|#+)\z", r"\\$1")


def join_adjacent(c: Column) -> Column:
    for a, b in ((r"%\}", r"\{%"), (r"#\}", r"\{#"), (r"\}\}", r"\{\{"), ("-->", "<!--")):
        c = F.regexp_replace(c, f"({a})({b})", "$1 $2")
    return c


def split_adjacent(c: Column) -> Column:
    for a, b in ((r"%\}", r"\{%"), (r"#\}", r"\{#"), (r"\}\}", r"\{\{"), ("-->", "<!--")):
        c = F.regexp_replace(c, f"({a}) ({b})", "$1$2")
    return c


def hard_break_pieces(c: Column) -> Column:
    return F.split(c, "\\\\\n|  +\n")


def unbold_heading(c: Column) -> Column:
    """A heading line whose only content is strong text, without the strong marks."""
    once = F.regexp_replace(c, r"\A( {0,3}#{1,6}[ \t]+)\*\*\*([^*]+)\*\*\*[ \t]*\z", "$1*$2*")
    return F.regexp_replace(once, r"\A( {0,3}#{1,6}[ \t]+)\*\*([^*]+)\*\*[ \t]*\z", "$1$2")


def label_code(c: Column) -> Column:
    """A reference label lower-cased, as hexadecimal UTF-8."""
    return F.lower(F.hex(F.encode(F.lower(c), "UTF-8")))


def label_decode(c: Column) -> Column:
    return F.decode(F.unhex(c), "UTF-8")


def content_hash(content: Column) -> Column:
    """A 64-bit content hash as 16 hexadecimal digits; only equality matters."""
    return F.lower(F.lpad(F.hex(F.xxhash64(content)), 16, "0"))


def fence_length(code: Column, authored: Column) -> Column:
    """The backticks a fence needs: one more than the longest run, at least three."""
    runs = F.transform(F.regexp_extract_all(code, F.lit("(`+)"), 1), F.length)
    return F.greatest(F.lit(3), authored, F.coalesce(F.array_max(runs), F.lit(0)) + 1)


def common_indent(c: Column) -> Column:
    """The least indent of lines that are not blank."""
    full = F.filter(F.split(c, "\n"), lambda x: collapse(x) != "")
    return F.coalesce(F.array_min(F.transform(full, lambda x: F.length(x) - F.length(F.regexp_replace(x, r"\A[ \t]+", "")))), F.lit(0))


# What documents with protected syntax hold somewhere, a superset.
MAY_HOLD_REGIONS = r"(?m)[`$<{\\]|\[\[|\[!|\[(?:cadence|contact|epic|feature_flag|issue|vulnerability|wiki_page|work_item):|^\+\+\+|:::|>>>|\+[-=:]|^[ >\t]*\||--|^[ >\t]*(?:[-*+] +|[0-9]+[.)] +)*[:~|][ \t]"


def may_hold_regions(c: Column) -> Column:
    """Whether a document may hold protected regions; false means that it holds none."""
    return c.rlike(MAY_HOLD_REGIONS)

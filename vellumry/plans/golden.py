"""Queries over fixed cases: whole documents and structure whose results SQL states row by row.

Each case is a small document with the result that the rules demand; the operators run over
the cases as over any table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.formatting import markdown, source, units, wrap
from vellumry.functions import arrow, text
from vellumry.operators import documents, manifest
from vellumry.options import FormatOptions, ListSpacing
from vellumry.sources import config, files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

OPTIONS = {
    "": FormatOptions(),
    "semantic": FormatOptions(semantic=True),
    "auto": FormatOptions.auto(),
    "clean": FormatOptions(cleanups=True),
    "quotes": FormatOptions(smartquotes=True),
    "dots": FormatOptions(ellipses=True),
    "narrow": FormatOptions(width=20),
    "endless": FormatOptions(width=0),
    "loose": FormatOptions(list_spacing=ListSpacing.LOOSE),
    "tight": FormatOptions(list_spacing=ListSpacing.TIGHT),
    "dedent": FormatOptions(dedent=True),
    "plain": FormatOptions(plaintext=True, width=20),
    "plain_endless": FormatOptions(plaintext=True, width=0),
}

#: (case, options, document, result); None: the document itself.
BLOCKS = [
    ("heading", "", "#  Tides\nThe sea rises.\n", "# Tides\n\nThe sea rises.\n"),
    ("heading_closed", "", "## Tides ##\n", "## Tides\n"),
    ("heading_underlined", "", "Tides\n=====\nSmall ones\n---\nx\n", "# Tides\n\n## Small ones\n\nx\n"),
    ("heading_not", "", "#Tides and ####### seven\n", None),
    ("heading_list", "", "# Tides\n- a\n", "# Tides\n\n- a\n"),
    ("heading_strong_kept", "", "# **Tides**\n", None),
    ("heading_strong", "clean", "# **Tides**\n", "# Tides\n"),
    ("heading_strong_part", "clean", "# **Tides** rise\n", None),
    ("heading_strong_emphasis", "clean", "## ***Tides***\n", "## *Tides*\n"),
    ("paragraph", "", "one\ntwo   three\n", "one two three\n"),
    ("paragraph_wrapped", "narrow", "a paragraph that is longer than twenty\n", "a paragraph that is\nlonger than twenty\n"),
    ("paragraph_endless", "endless", "one\ntwo\n\nthree\n", "one two\n\nthree\n"),
    ("paragraphs_apart", "", "one\n\n\n\ntwo\n", "one\n\ntwo\n"),
    ("paragraph_list_tight", "", "one\n- two\n", None),
    ("paragraph_quote_tight", "", "one\n> two\n", None),
    ("paragraph_code_tight", "", "one\n```\ntwo\n```\n", None),
    ("paragraph_table_tight", "", "one\n\n| a |\n| --- |\n", None),
    ("code_paragraph_tight", "", "```\none\n```\ntwo\n", None),
    ("list_paragraph", "", "- one\n\ntwo\n", None),
    ("bullets", "", "* a\n* b\n", None),
    ("bullets_plus", "", "+   a\n+   b\n", "+ a\n+ b\n"),
    ("bullets_differ", "", "- a\n* b\n", None),
    ("numbers", "", "4. a\n9. b\n9. c\n", "4. a\n5. b\n6. c\n"),
    ("numbers_bracket", "", "1) a\n2) b\n", "1. a\n2. b\n"),
    ("numbers_width", "narrow", "9. one two three four five\n", "9. one two three\n   four five\n"),
    ("numbers_ten", "narrow", "9. a\n9. one two three four five\n", "9. a\n10. one two three\n    four five\n"),
    ("nested", "", "- a\n    - b\n- c\n", "- a\n  - b\n- c\n"),
    ("nested_number", "", "1. a\n   - b\n", None),
    ("item_empty", "", "- a\n-\n- b\n", None),
    ("item_paragraphs", "", "- a\n\n  b\n- c\n", "- a\n\n  b\n\n- c\n"),
    ("item_code", "", "- a\n\n  ```\n  x\n  ```\n- b\n", "- a\n\n  ```\n  x\n  ```\n\n- b\n"),
    ("item_lazy", "", "- a\nb\n", "- a b\n"),
    ("tasks", "", "- [ ] do\n- [X] done\n", "- [ ] do\n- [x] done\n"),
    ("tight_kept", "", "- a\n- b\n", None),
    ("loose_kept", "", "- a\n\n- b\n", None),
    ("tight_made_loose", "loose", "- a\n- b\n", "- a\n\n- b\n"),
    ("loose_made_tight", "tight", "- a\n\n- b\n", "- a\n- b\n"),
    ("complex_not_tight", "tight", "- a\n\n  b\n- c\n", "- a\n\n  b\n\n- c\n"),
    ("quote", "", "> a\n> b\n", "> a b\n"),
    ("quote_lazy", "", "> a\nb\n", "> a b\n"),
    ("quote_list", "", "> - a\n> - b\n", None),
    ("quote_wrapped", "narrow", "> one two three four five six\n", "> one two three four\n> five six\n"),
    ("code", "", "``` py\nx  y\n```\n", "```py\nx  y\n```\n"),
    ("code_indented", "", "    let x\n\n    let y\n", "```\nlet x\n\nlet y\n```\n"),
    ("code_blank_lines", "", "```\na\n\n\n\nb\n```\n", None),
    ("code_long_fence", "", "````\n```\n````\n", None),
    ("code_tildes", "", "~~~\nx\n~~~\n", None),
    ("code_open", "", "```\nx\n", "```\nx\n```\n"),
    ("break_dashes", "", "a\n\n---\n\nb\n", "a\n\n* * *\n\nb\n"),
    ("break_stars", "", "a\n\n*****\n\nb\n", "a\n\n* * *\n\nb\n"),
    ("html", "", "<div>\na   b\n</div>\n\nc   d\n", "<div>\na   b\n</div>\n\nc d\n"),
    ("comment_close", "", "<!-- c -->\ntext   here\n", "<!-- c -->\ntext here\n"),
    ("table", "", "|a|b|\n|:-|-:|\n|1|2|\n", "| a | b |\n| :--- | ---: |\n| 1 | 2 |\n"),
    ("table_center", "", "| a |\n|:-:|\n| 1 |\n", "| a |\n| :---: |\n| 1 |\n"),
    ("table_short_row", "", "| a | b |\n|---|---|\n| 1 |\n", "| a | b |\n| --- | --- |\n| 1 |  |\n"),
    ("table_code", "", "| a |\n| --- |\n| `x \\| y` |\n", None),
    ("table_quotes", "quotes", "| \"a\" |\n| --- |\n", "| “a” |\n| --- |\n"),
    ("alert", "", "> [!NOTE]\n> keep   this\n", None),
    ("footnote", "", "see[^n]\n\n[^n]: a note\n    goes on\n", "see[^n]\n\n[^n]: a note goes on\n"),
    ("footnote_dots", "dots", "see[^n]\n\n[^n]: and so...\n", "see[^n]\n\n[^n]: and so …\n"),
    ("definition_lower", "", "[Port]\n\n[PORT]: /P 'T'\n", "[Port][port]\n\n[port]: /P 'T'\n"),
    ("definition_last", "", "![a][p]\n\n[p]: /1\n[P]: /2\n", "![a](/2)\n\n[p]: /1\n[p]: /2\n"),
    ("front_matter", "", "---\nt:   1\n---\na   b\n", "---\nt:   1\n---\na b\n"),
    ("front_matter_open", "", "---\nt:   1\n", None),
    ("leading_blanks", "", "\n\n\na   b\n", "\na b\n"),
    ("byte_order_mark", "", "\ufeffa\r\nb\r\n", "\ufeffa b\n"),
    ("empty", "", "", "\n"),
    ("no_line_end", "", "a", "a\n"),
    ("dedent", "dedent", "    one\n    two\n", "one two\n"),
    ("plain", "plain", "one two three four five\n\n\nsix", "one two three four\nfive\n\nsix"),
    ("plain_endless", "plain_endless", "one\ntwo\n", None),
    ("auto", "auto", "# **Go**\nHe said \"wait...\" and left. It rained on the old quay.\n", "# Go\n\nHe said “wait …” and left.\nIt rained on the old quay.\n"),
]

INLINE = [
    ("emphasis", "", "_a_ and __b__ and snake_case_name\n", "*a* and **b** and snake_case_name\n"),
    ("strike", "", "~~a~~ b\n", None),
    ("code_span", "", "`a  b` c   d\n", "`a  b` c d\n"),
    ("code_span_ticks", "", "``a ` b`` c\n", None),
    ("link_title", "", "[a](b 'c')\n", "[a](b \"c\")\n"),
    ("link_spaces", "", "[a]( b )\n", "[a](b)\n"),
    ("link_in_one_piece", "narrow", "see [a long text](https://port.example/x) now\n", "see\n[a long text](https://port.example/x)\nnow\n"),
    ("link_collapsed", "", "[port][]\n\n[port]: /p\n", None),
    ("link_full", "", "[a][Port]\n\n[port]: /p\n", "[a][port]\n\n[port]: /p\n"),
    ("link_undefined", "", "[a][port] and [b]\n", None),
    ("image_reference", "", "![a][q]\n\n[q]: u 'T'\n", "![a](u \"T\")\n\n[q]: u 'T'\n"),
    ("image", "", "![a](b)\n", None),
    ("badge", "", "[![a][q]](/z)\n\n[q]: u\n", "[![a](u)](/z)\n\n[q]: u\n"),
    ("autolink", "", "<https://port.example/a_b> and <me@port.example>\n", None),
    ("bare_link", "", "https://port.example/a_b_c here\n", None),
    ("escape", "", "a \\* b \\_ c\n", None),
    ("entity", "", "a &amp; b &copy;\n", None),
    ("period_free", "", "about 3\\. then\n", "about 3. then\n"),
    ("period_needed", "", "3\\. not a list\n", None),
    ("line_start_number", "narrow", "the number there is 12. yes\n", "the number there is\n12\\. yes\n"),
    ("line_start_dash", "narrow", "one two three four - five\n", "one two three four -\nfive\n"),
    ("line_start_hash", "narrow", "one two three fours # five\n", "one two three fours\n\\# five\n"),
    ("break_spaces", "", "sea  \nland\n", "sea\\\nland\n"),
    ("break_backslash", "", "sea\\\nland\n", None),
    ("html_inline", "", "a <b class='x  y'>c</b> d\n", None),
    ("html_comment", "", "a <!-- b   c --> d\n", None),
    ("footnote_reference", "", "a[^1] b\n\n[^1]: c\n", None),
    ("wikilink", "", "a [[b   c]] d\n", None),
    ("wikilink_embed", "", "a ![[b   c]] d\n", None),
    ("math", "", "a $x   y$ b\n", None),
    ("math_display", "", "a $$x   y$$ b\n", None),
    ("math_brackets", "", "a \\(x   y\\) b\n", None),
    ("math_environment", "", "a \\begin{e}x   y\\end{e} b\n", None),
    ("math_role", "", "a {math}`x   y` b\n", None),
    ("math_ticks", "", "a $`x   y`$ b\n", None),
    ("role", "", "a {ref}`x   y` b\n", None),
    ("reference_type", "", "a [issue:12] b\n", None),
    ("attributes", "", "# T {#i   .c}\n", None),
    ("attributes_code", "", "a `x`{.c   k=1} b\n", None),
    ("private_use", "", "a \ue001\nb\n", "a \ue001 b\n"),
    ("word_too_long", "narrow", "abcdefghijklmnopqrstuvwxyz a\n", "abcdefghijklmnopqrstuvwxyz\na\n"),
]

TYPOGRAPHY = [
    ("double", "quotes", "say \"a b\" now\n", "say “a b” now\n"),
    ("single", "quotes", "say 'a b' now\n", "say ‘a b’ now\n"),
    ("nested", "quotes", "\"a 'b' c\"\n", "“a ‘b’ c”\n"),
    ("neighbours", "quotes", "\"a\" \"b\"\n", "“a” “b”\n"),
    ("apostrophe", "quotes", "it's Iris' boat\n", "it’s Iris’ boat\n"),
    ("two_apostrophes", "quotes", "rock'n'roll\n", None),
    ("inches", "quotes", "5\" by 6\"\n", None),
    ("code_untouched", "quotes", "`\"a\"` x=\"y\"\n", None),
    ("around_code", "quotes", "\"`a` b\"\n", "“`a` b”\n"),
    ("dash_before", "quotes", "so—\"a\"—b\n", "so—“a”—b\n"),
    ("bracket_behind", "quotes", "(see \"a\")\n", "(see “a”)\n"),
    ("tag_untouched", "quotes", "{{ f(\"a\") }} \"b\"\n", "{{ f(\"a\") }} “b”\n"),
    ("over_lines", "quotes", "\"a\nb\" c\n", "“a b” c\n"),
    ("off", "", "\"a\" it's...\n", None),
    ("dots_word", "dots", "wait...\n", "wait …\n"),
    ("dots_start", "dots", "...so\n", "… so\n"),
    ("dots_between", "dots", "a...b\n", "a … b\n"),
    ("dots_set_off", "dots", "a ... b\n", "a … b\n"),
    ("dots_mark", "dots", "why...? no\n", "why …? no\n"),
    ("dots_four", "dots", "end.... \n", "end ….\n"),
    ("dots_many", "dots", "no..... x\n", None),
    ("dots_code", "dots", "`a...` b\n", None),
]

WRAPPING = [
    ("sentences", "semantic", "The first one stands here alone. The second one as well, it seems.\n", "The first one stands here alone.\nThe second one as well, it seems.\n"),
    ("sentence_short", "semantic", "Go on. This one follows on the same line.\n", "Go on. This one follows on the same line.\n"),
    ("sentence_in_link", "semantic", "Read [ch. one. And two](u) first. Then go on and read more.\n", "Read [ch. one. And two](u) first.\nThen go on and read more.\n"),
    ("sentence_number", "semantic", "It costs 3. Not more than that, they say.\n", "It costs 3. Not more than that, they say.\n"),
    ("sentence_list", "semantic", "- The first sentence of an item. The second sentence of it.\n", "- The first sentence of an item.\n  The second sentence of it.\n"),
    ("sentence_escape", "semantic", "Here is a longer sentence that ends. - dash begins this one here.\n", "Here is a longer sentence that ends.\n\\- dash begins this one here.\n"),
    ("tag_lines", "", "{% t %}\nsome   text\n{% /t %}\n", "{% t %}\nsome text\n{% /t %}\n"),
    ("tag_list", "", "{% t %}\n- a\n- b\n{% /t %}\n", "{% t %}\n\n- a\n- b\n\n{% /t %}\n"),
    ("tag_whole", "narrow", "text and {% tag with many words %} more\n", "text and\n{% tag with many words %}\nmore\n"),
    ("tag_pair", "narrow", "text {% a b c %}{% /a %} more of it\n", "text\n{% a b c %}{% /a %}\nmore of it\n"),
    ("tag_variable", "", "{{ a   b }} c   d\n", "{{ a b }} c d\n"),
    ("comment_tag", "", "{# a #}\ntext   b\n", "{# a #}\ntext b\n"),
]

#: (case, document, [(kind, form, source)])
REGIONS = [
    ("code_span", "a `b c` d\n", [("code_span", "inline", "`b c`")]),
    ("code_over_lines", "a `b\nc` d\n", [("code_span", "inline", "`b\nc`")]),
    ("math_dollar", "a $x$ b\n", [("math_dollar_inline", "inline", "$x$")]),
    ("math_double", "a $$x$$ b\n", [("math_double_dollar_inline", "inline", "$$x$$")]),
    ("math_paren", "a \\(x\\) b\n", [("math_paren_inline", "inline", "\\(x\\)")]),
    ("math_environment", "a \\begin{e}x\\end{e} b\n", [("math_environment_inline", "inline", "\\begin{e}x\\end{e}")]),
    ("math_gitlab", "a $`x`$ b\n", [("math_gitlab_inline", "inline", "$`x`$")]),
    ("math_myst", "a {math}`x` b\n", [("math_myst_inline", "inline", "{math}`x`")]),
    ("role", "a {ref}`x` b\n", [("myst_role_inline", "inline", "{ref}`x`")]),
    ("html", "a <i x=1> b\n", [("raw_html_inline", "inline", "<i x=1>")]),
    ("wikilink", "a ![[x y]] b\n", [("wikilink_inline", "inline", "![[x y]]")]),
    ("reference", "a [epic:9] b\n", [("gitlab_reference_inline", "inline", "[epic:9]")]),
    ("attributes", "a `x`{.k} b\n", [("code_span", "inline", "`x`"), ("attribute_group_inline", "inline", "{.k}")]),
    ("attributes_heading", "# T {#k}\n", [("attribute_group_inline", "inline", "{#k}")]),
    ("escaped", "a \\$x$ \\<i>\n", []),
    ("ticks_ignore_backslashes", "a `b\\` c\n", [("code_span", "inline", "`b\\`")]),
    ("in_cells", "| a | $b |\n| --- | --- |\n| `c|d` | e$ |\n", [("code_span", "inline", "`c|d`")]),
    ("none_in_code", "```\n`a` $x$\n```\n\n    `b`\n", []),
    ("none_in_front_matter", "---\na: `b`\n---\n`c`\n", [("code_span", "inline", "`c`")]),
    ("dollar_block", "$$\nx\n$$\n", [("math_dollar_block", "block", "$$\nx\n$$\n")]),
    ("bracket_block", "\\[\nx\n\\]\n", [("math_bracket_block", "block", "\\[\nx\n\\]\n")]),
    ("environment_block", "\\begin{e}\nx\n\\end{e}\n", [("math_environment_block", "block", "\\begin{e}\nx\n\\end{e}\n")]),
    ("html_block", "<div>\nx\n</div>\n", [("raw_html_block", "block", "<div>\nx\n</div>\n")]),
    ("container", ":::n\nx\n:::\n", [("colon_container", "block", ":::n\nx\n:::\n")]),
    ("container_nested", ":::a\n:::b\nx\n:::\n:::\n", [("colon_container", "block", ":::a\n:::b\nx\n:::\n:::\n")]),
    ("callout", "> [!tip]\n> x\n", [("obsidian_callout", "block", "> [!tip]\n> x\n")]),
    ("toml", "+++\na = 1\n+++\n", [("toml_frontmatter", "block", "+++\na = 1\n+++\n")]),
    ("definitions", "Term\n: what\n", [("definition_list", "block", "Term\n: what\n")]),
    ("grid", "+---+\n| a |\n+---+\n", [("pandoc_grid_table", "block", "+---+\n| a |\n+---+\n")]),
    ("multiline", "----- -----\na     b\n\nc     d\n----- -----\n", [("pandoc_multiline_table", "block", "----- -----\na     b\n\nc     d\n----- -----\n")]),
    ("line_block", "| a\n| b\n", [("pandoc_line_block", "block", "| a\n| b\n")]),
    ("attribute_block", "{#i .c}\n", [("attribute_group_block", "block", "{#i .c}\n")]),
    ("multiline_quote", ">>>\nx\n>>>\n", [("gitlab_multiline_blockquote", "block", ">>>\nx\n>>>\n")]),
    ("priority", "a $x `y$ z` b\n", [("math_dollar_inline", "inline", "$x `y$")]),
]

#: (case, document, a letter per line: o opaque, - not)
OPAQUE = [
    ("fence", "a\n```\nb\n\n```\nc\n", "-oooo-"),
    ("tildes", "~~~\n```\n~~~\n", "ooo"),
    ("open", "```\na\n", "oo"),
    ("indented", "a\n\n    b\n\n    c\n\nd\n", "--ooo--"),
    ("not_indented", "a\n    b\n", "--"),
    ("front_matter", "---\na\n---\nb\n", "ooo-"),
    ("front_matter_dots", "---\na\n...\nb\n", "ooo-"),
    ("front_matter_open", "---\na\n", "--"),
    ("item", "- a\n\n  ```\n  b\n  ```\n- c\n", "--ooo-"),
    ("quote", "> ```\n> a\n> ```\nb\n", "ooo-"),
    ("toml", "+++\na\n+++\nb\n", "ooo-"),
]

#: (case, document, [(parent, depth, kind, first line, last line)]) in order.
TREES = [
    ("flat", "# a\n\nb\n\n***\n", [(-1, 0, "heading", 0, 0), (-1, 0, "paragraph", 2, 2), (-1, 0, "break", 4, 4)]),
    ("list", "- a\n  - b\n", [(-1, 0, "list", 0, 1), (0, 1, "item", 0, 1), (1, 2, "paragraph", 0, 0), (1, 2, "list", 1, 1), (3, 3, "item", 1, 1), (4, 4, "paragraph", 1, 1)]),
    ("quote", "> a\n>\n> b\n", [(-1, 0, "quote", 0, 2), (0, 1, "paragraph", 0, 0), (0, 1, "paragraph", 2, 2)]),
    ("lazy", "> a\nb\n\nc\n", [(-1, 0, "quote", 0, 1), (0, 1, "paragraph", 0, 1), (-1, 0, "paragraph", 3, 3)]),
    ("code", "```\na\n\nb\n```\n", [(-1, 0, "code", 0, 4)]),
    ("table", "|a|\n|-|\n|b|\n", [(-1, 0, "table", 0, 2)]),
    ("footnote", "[^a]: b\n\n    c\n", [(-1, 0, "footnote", 0, 2), (0, 1, "paragraph", 0, 0), (0, 1, "paragraph", 2, 2)]),
    ("definition", "[a]: b\n", [(-1, 0, "definition", 0, 0)]),
    ("html", "<p>\na\n</p>\n", [(-1, 0, "raw_html_block", 0, 2)]),
    ("front_matter", "---\na: 1\n---\n# b\n", [(-1, 0, "front_matter", 0, 2), (-1, 0, "heading", 3, 3)]),
]


def _value(x: object) -> str:
    if x is None or isinstance(x, int):
        return "NULL" if x is None else str(x)
    return "'" + str(x).replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) v({names})"


def _register(function, rows: list[tuple], names: str) -> None:
    QUERIES[function.__name__] = function
    ORACLES[function.__name__] = _values(rows, names)


def _formatted(cases: list[tuple], name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        done = None
        for options in dict.fromkeys(c[1] for c in cases):
            rows = spark.createDataFrame([(c[0], c[2]) for c in cases if c[1] == options], "case_id string, text string")
            part = documents.format_documents(rows, options=OPTIONS[options]).select("case_id", "formatted", "error")
            done = part if done is None else done.unionByName(part)
        return done

    run.__name__ = name
    _register(run, [(c[0], c[2] if c[3] is None else c[3], None) for c in cases], "case_id, formatted, error")
    ORACLES[name] = ORACLES[name].replace("SELECT *", "SELECT case_id, formatted, error::VARCHAR AS error")


for _cases, _name in ((BLOCKS, "golden_blocks"), (INLINE, "golden_inline"), (TYPOGRAPHY, "golden_typography"), (WRAPPING, "golden_wrapping")):
    _formatted(_cases, _name)


def golden_settled(spark: SparkSession, d: str) -> DataFrame:
    """The results of all cases of Markdown are settled: formatting them again changes nothing."""
    done = None
    for options in OPTIONS:
        rows = [(f"{name}.{c[0]}", c[2] if c[3] is None else c[3]) for name, cases in (("blocks", BLOCKS), ("inline", INLINE), ("typography", TYPOGRAPHY), ("wrapping", WRAPPING)) for c in cases if c[1] == options and not options.startswith("plain")]
        if rows:
            part = documents.format_documents(spark.createDataFrame(rows, "case_id string, text string"), options=OPTIONS[options]).select("case_id", "changed")
            done = part if done is None else done.unionByName(part)
    return done


_register(golden_settled, [(f"{name}.{c[0]}", "no") for name, cases in (("blocks", BLOCKS), ("inline", INLINE), ("typography", TYPOGRAPHY), ("wrapping", WRAPPING)) for c in cases if not c[1].startswith("plain")], "case_id, changed")
ORACLES["golden_settled"] = ORACLES["golden_settled"].replace("SELECT *", "SELECT case_id, changed = 'yes' AS changed")


def _table(spark: SparkSession, cases: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(c[0], c[1]) for c in cases], "case_id string, text string")


def golden_regions(spark: SparkSession, d: str) -> DataFrame:
    found = documents.regions(_table(spark, REGIONS), ["case_id"])
    here = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.join(_table(spark, REGIONS), "case_id").select("case_id", "idx", "kind", "form", "source", (here == F.col("source")).cast("int").alias("in_place"))


_register(golden_regions, [(c, k, *r, 1) for c, _, rs in REGIONS for k, r in enumerate(rs)], "case_id, idx, kind, form, source, in_place")


def golden_opaque(spark: SparkSession, d: str) -> DataFrame:
    flags = F.transform(arrow.opaque_flags(F.col("text")), lambda x: F.when(x, "o").otherwise("-"))
    return _table(spark, OPAQUE).select("case_id", F.array_join(flags, "").alias("flags"))


_register(golden_opaque, [(c, flags) for c, _, flags in OPAQUE], "case_id, flags")


#: (case, document, [(kind, source)])
SCOPES = [
    ("paragraphs", "a\nb\n\n> c\n", [("paragraph", "a\nb\n"), ("paragraph", "c\n")]),
    ("heading", "## a\nb\n", [("heading", "## a\n"), ("paragraph", "b\n")]),
    ("item", "- a\n- b\n", [("paragraph", "a\n"), ("paragraph", "b\n")]),
    ("no_code", "```\na\n```\n\nb\n", [("paragraph", "b\n")]),
    ("no_front_matter", "---\na\n---\nb\n", [("paragraph", "b\n")]),
    ("cells", "|a|`b|c`|\n|-|-|\n", [("table", "|a|`b|c`|\n|-|-|\n"), ("cell", "a"), ("cell", "`b|c`"), ("cell", "-"), ("cell", "-")]),
]


def golden_scopes(spark: SparkSession, d: str) -> DataFrame:
    found = documents.scopes(_table(spark, SCOPES), ["case_id"]).join(_table(spark, SCOPES), "case_id")
    return found.select("case_id", "kind", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("source"))


_register(golden_scopes, [(c, *r) for c, _, rs in SCOPES for r in rs], "case_id, kind, source")

#: (case, document, [(containers, block, opaque)]) per line.
FRAMES = [
    ("nested", "> - a\n>   b\n> c\n", [("quote>item", "paragraph", 0)] * 3),
    ("lazy", "- a\nb\n\nc\n", [("item", "paragraph", 0), ("item", "paragraph", 0), ("", "", 0), ("", "paragraph", 0)]),
    ("code_in_item", "- a\n\n  ```\n  b\n  ```\n", [("item", "paragraph", 0), ("item", "", 0), ("item", "code", 1), ("item", "code", 1), ("item", "code", 1)]),
    ("front", "---\na\n---\nb\n", [("", "front_matter", 1)] * 3 + [("", "paragraph", 0)]),
    ("footnote", "[^a]: b\n    c\n", [("footnote", "paragraph", 0), ("footnote", "paragraph", 0)]),
    ("container", ":::n\na\n:::\n", [("", "colon_container", 0)] * 3),
]


def golden_lines(spark: SparkSession, d: str) -> DataFrame:
    return documents.framed_lines(_table(spark, FRAMES), ["case_id"]).select("case_id", "i", "frames", "block", F.col("opaque").cast("int").alias("opaque"))


_register(golden_lines, [(c, k, *r) for c, _, rs in FRAMES for k, r in enumerate(rs)], "case_id, i, frames, block, opaque")


def golden_trees(spark: SparkSession, d: str) -> DataFrame:
    return documents.blocks(_table(spark, TREES), ["case_id"]).drop("text")


_register(golden_trees, [(c, k, *r) for c, _, rs in TREES for k, r in enumerate(rs)], "case_id, ord, parent, depth, kind, start_line, end_line")


def _facts() -> Iterator[tuple[str, object]]:
    """Functions that run on the driver or on one text."""
    rules = files.Ignore("/r", ["*.log", "!keep.log", "/top.md", "tmp/", "a/**/z.md"])
    for name, folder in (("x.log", 0), ("d/x.log", 0), ("d/keep.log", 0), ("top.md", 0), ("d/top.md", 0), ("tmp", 1), ("tmp", 0), ("a/b/c/z.md", 0)):
        yield f"ignore {name}{'/' * folder}", rules.verdict("/r/" + name, bool(folder))
    for path, patterns in (("/r/a/b.md", ["a/"]), ("/r/a/b.md", ["b.md"]), ("/r/a/b.md", ["b/"]), ("/r/a/b.md", ["*.rs"]), ("/r/a/b.md", ["/a/b.md"])):
        yield f"matches {path} {patterns[0]}", files.matches(path, patterns, "/r")
    yield "needs resolution glob", files.needs_resolution(["a*.md"])
    yield "needs resolution stdin", files.needs_resolution(["-"])
    yield "flag before file", config.merge({"width": 5}, {"width": 70})["width"]
    yield "file where no flag", config.merge({}, {"width": 70})["width"]
    yield "preset before file", config.merge({}, {"semantic": False}, auto=True)["semantic"]
    applied: list[str] = []
    config.merge({"width": 5}, {"width": 70, "include": ["*.rst"], "semantic": False}, auto=True, apply=lambda name, value: applied.append(f"{name}={value[0]}"))
    yield "values of the file that are applied", " ".join(applied)
    yield "spacing by name", config.options({"list_spacing": "Loose"}).list_spacing.value
    yield "hit rate", manifest.hit_rate(1, 2)
    yield "hit rate of nothing", manifest.hit_rate(0, 0)
    yield "bytes", manifest.human_bytes(12)
    yield "kilobytes", manifest.human_bytes(1536)
    yield "megabytes", manifest.human_bytes(5 << 20)
    yield "fingerprint of options", manifest.fingerprint(FormatOptions()) == manifest.fingerprint(FormatOptions(width=80))
    yield "fingerprint again", manifest.fingerprint(FormatOptions()) == manifest.fingerprint(FormatOptions())
    yield "cache given", manifest.cache_root("/c", {})[0]
    yield "cache of user", manifest.cache_root(None, {"XDG_CACHE_HOME": "/x", "HOME": "/h"})[1]
    yield "cache at home", manifest.cache_root(None, {"HOME": "/h"})[1]
    yield "cache temporary", manifest.cache_root(None, {"TMPDIR": "/t"})[0]
    yield "front matter exact", source.has_front_matter("---\na\n---\n")
    yield "front matter indented", source.has_front_matter(" ---\na\n---\n")
    yield "front matter open", source.has_front_matter("---\na\n")
    yield "leading blanks", "|".join(source.leading_blanks("\n \n\na")).replace("\n", "n")
    yield "dedent", source.dedent("    a\n      b\n\n").replace("\n", "n")
    yield "wrapper hook", markdown.fill_markdown("- a b\n  c\n", wrapper=lambda t, first, other: first + t.upper().replace("\n", "/")).strip()
    yield "splitter hook", wrap.greedy_lines("a-b-c", 3, splitter=lambda t: t.split("-"))[0]
    yield "sentence hook", wrap.line_wrapper(40, True, split_sentences=lambda t: t.split("; "))("a sentence with some length; another", "", "").replace("\n", "n")
    yield "closing tag", units.is_closing_tag("  {% /a %}")
    yield "tag at start", units.starts_with_tag("{{ a }} b")
    yield "tag at end", units.ends_with_tag("a <!-- b -->")
    yield "block content", units.is_block_content("1. a")
    yield "first indent left out", wrap.wrap_paragraph("word again", 12, "", "--", column=8).replace("\n", "n")


FACTS = [
    ("ignore x.log", "True"), ("ignore d/x.log", "True"), ("ignore d/keep.log", "False"), ("ignore top.md", "True"), ("ignore d/top.md", "None"), ("ignore tmp/", "True"), ("ignore tmp", "None"), ("ignore a/b/c/z.md", "True"),
    ("matches /r/a/b.md a/", "True"), ("matches /r/a/b.md b.md", "True"), ("matches /r/a/b.md b/", "False"), ("matches /r/a/b.md *.rs", "False"), ("matches /r/a/b.md /a/b.md", "True"),
    ("needs resolution glob", "True"), ("needs resolution stdin", "False"), ("flag before file", "5"), ("file where no flag", "70"), ("preset before file", "True"), ("values of the file that are applied", "include=*.rst"), ("spacing by name", "loose"),
    ("hit rate", "33.3%"), ("hit rate of nothing", "0.0%"), ("bytes", "12 B"), ("kilobytes", "1.5 KB"), ("megabytes", "5.0 MB"), ("fingerprint of options", "False"), ("fingerprint again", "True"),
    ("cache given", "/c"), ("cache of user", "cache"), ("cache at home", "home"), ("cache temporary", "/t/vellumry"), ("front matter exact", "True"), ("front matter indented", "False"), ("front matter open", "False"),
    ("leading blanks", "n|a"), ("dedent", "an  bnn"), ("wrapper hook", "- A B/C"), ("splitter hook", "a b"), ("sentence hook", "a sentence with some lengthnanother"),
    ("closing tag", "True"), ("tag at start", "True"), ("tag at end", "True"), ("block content", "True"), ("first indent left out", "wordn--again"),
]


def golden_facts(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(name, str(value)) for name, value in _facts()], "fact string, value string")


_register(golden_facts, FACTS, "fact, value")


def golden_indents(spark: SparkSession, d: str) -> DataFrame:
    """The least indent of texts, natively and as their dedented form has it."""
    cases = [("a", 0), ("  a\n    b", 2), ("    a\n\n  b\n", 2), ("\n\n", 0), ("\ta\n\tb", 1)]
    rows = spark.createDataFrame([(t.replace("\n", "n"), t) for t, _ in cases], "case_id string, text string")
    return rows.select("case_id", text.common_indent(F.col("text")).alias("indent"), text.common_indent(arrow.of(source.dedent, "string")(F.col("text"))).alias("rest"))


_register(golden_indents, [("a", 0, 0), ("  an    b", 2, 0), ("    ann  bn", 2, 0), ("nn", 0, 0), ("\tan\tb", 1, 0)], "case_id, indent, rest")

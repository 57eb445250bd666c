"""The formatter's pure functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumry.formatting import blocks, regions, source, typography, units, wrap
from vellumry.formatting.markdown import fill_markdown, format_text
from vellumry.options import FormatOptions, ListSpacing

SEM, AUTO = FormatOptions(semantic=True), FormatOptions.auto()


def md(text, **options):
    return fill_markdown(text, FormatOptions(**options))


@pytest.mark.parametrize("word,escaped", [("-", "\\-"), ("##", "\\##"), (">", "\\>"), ("12.", "12\\."), ("3)", "3\\)"), ("-x", "-x"), ("x.", "x."), ("1.x", "1.x"), ("7", "7")])
def test_escape_word(word, escaped):
    assert wrap.escape_word(word) == escaped


def test_greedy_lines():
    text = "one - two # three 4. four"
    assert wrap.greedy_lines(text, 5, markdown=True) == ["one -", "two #", "three", "4\\.", "four"]
    assert wrap.greedy_lines(text, 3, splitter=units.plain_words) == ["one", "-", "two", "#", "three", "4.", "four"]
    assert wrap.greedy_lines("  a \n b  ", 0) == ["a b"]
    assert wrap.greedy_lines("   ", 0) == []
    assert wrap.greedy_lines("x" * 30 + " y", 10) == ["x" * 30, "y"]


def test_paragraph_indents_and_column():
    out = wrap.wrap_paragraph("see [a long link](https://example.org/a) here", 20, "> ", ">> ")
    assert out == "> see\n>> [a long link](https://example.org/a)\n>> here"
    assert wrap.wrap_paragraph("word again", 12, "", "--", column=8) == "word\n--again"


def test_atomic_words():
    assert units.atomic_words("a `b c` [d e](f), <i>g</i>") == ["a", "`b c`", "[d e](f),", "<i>g</i>"]
    assert units.atomic_words("{% a b %}{% /a %} {{ x }}{{ y }}") == ["{% a b %} {% /a %}", "{{ x }}", "{{ y }}"]
    assert units.split_adjacent("{{ x }} {{ y }}") == "{{ x }}{{ y }}"


def test_sentences():
    assert units.sentences_plain("One two. Three 4. five! Six") == ["One two.", "Three 4. five!", "Six"]
    assert units.sentences_plain("Ab. Cd. Ef gh ij.", 8) == ["Ab. Cd.", "Ef gh ij."] or units.sentences_plain("Ab. Cd. Ef gh ij.", 8) == ["Ab. Cd. Ef gh ij."]
    assert units.sentences_atomic("See [St. James park.](x) now. Then `a. b` go.") == ["See [St. James park.](x) now.", "Then `a. b` go."]
    assert units.first_sentence("no end") == "no end"


@given(st.text(alphabet="ab .?!'\")[]`(<x:/\n", max_size=60))
def test_sentence_fast_path(text):
    """The quick way over plain text gives what the general way gives."""
    general, start = [], None
    for m in units._INLINE_WORDS.finditer(text):
        start = m.start() if start is None else start
        end = m.end()
        if units.ends_sentence(m.group()):
            general.append(text[start:end])
            start = None
    if start is not None:
        general.append(text[start:end])
    assert units.sentences_atomic(text) == general


def test_semantic_lines():
    out = wrap.sentence_lines("Go on. This is one sentence. And another one here.", 40, "", "")
    assert out == "Go on. This is one sentence.\nAnd another one here."


def test_fill_text_modes():
    text = "a b\nc\n\n\nd e"
    assert wrap.fill_text(text, width=80) == "a b c\n\nd e"
    assert wrap.fill_text(text, wrap.Wrap.HANGING_INDENT, 80, empty="|") == "a b c\n|\n    d e"
    assert wrap.fill_text(text, wrap.Wrap.NONE) == text


@pytest.mark.parametrize("text,new", [
    ('say "hi".', "say “hi”."), ("it's James' car", "it’s James’ car"), ("\"a 'b' c\"", "“a ‘b’ c”"), ("x = 'y", "x = 'y"), ("{{ f('a') }} 'b'", "{{ f('a') }} ‘b’"), ('5" by 6"', '5" by 6"'),
])
def test_smart_quotes(text, new):
    assert typography.smart_quotes(text) == new


@pytest.mark.parametrize("text,new", [("wait...", "wait …"), ("...so", "… so"), ("a ... b", "a … b"), ("no.....", "no....."), ("why...?", "why …?"), ("a....", "a ….")])
def test_ellipses(text, new):
    assert typography.ellipses(text) == new


@given(st.text(alphabet="ab '\"—.\n(", max_size=40))
def test_smart_quotes_keep_length_and_settle(text):
    once = typography.smart_quotes(text)
    assert len(once) == len(text)
    assert not typography._pairs(once)


def test_normalization_and_front_matter():
    assert source.normalize("﻿a\r\nb\rc\n\n") == ("a\nb\nc\n", True)
    assert source.finalize("x", True) == "﻿x\n"
    assert source.split_front_matter("\n---\na: 1\n---\nb\n") == ("---\na: 1\n---\n", "b\n")
    assert source.split_front_matter("---\na: 1\n") == ("---\na: 1\n", "")
    assert md("---\na:   1\n---\nb   c\n") == "---\na:   1\n---\nb c\n"
    assert md("---\nno   end\n") == "---\nno   end\n"
    assert source.has_front_matter("---\na\n---\n") and not source.has_front_matter(" ---\na\n---\n")


@pytest.mark.parametrize("text,new", [
    ("# A\ntext\n", "# A\n\ntext\n"),
    ("Title\n===\n\nx\n", "# Title\n\nx\n"),
    ("* a\n* b\n", "* a\n* b\n"),
    ("1) a\n3) b\n", "1. a\n2. b\n"),
    ("- [X] a\n- [ ] b\n", "- [x] a\n- [ ] b\n"),
    ("_a_ __b__ c_d_e\n", "*a* **b** c_d_e\n"),
    ("    code\n    more\n", "```\ncode\nmore\n```\n"),
    ("``` py\na\n```\n", "```py\na\n```\n"),
    ("```\n```\n", "```\n```\n"),
    ("---\n\n***\n", "---\n\n***\n"),
    ("a\n\n***\n", "a\n\n* * *\n"),
    ("> a\n> b\n", "> a b\n"),
    ("> a\nb\n", "> a b\n"),
    ("|a|b|\n|:-|-|\n|1|2|\n", "| a | b |\n| :--- | --- |\n| 1 | 2 |\n"),
    ("a  \nb\n", "a\\\nb\n"),
    ("[x]\n\n[X]: u\n", "[x][]\n\n[x]: u\n"),
    ("![p][Q]\n\n[q]: u 'T'\n", "![p](u \"T\")\n\n[q]: u 'T'\n"),
    ("a[^1]\n\n[^1]: note\n    more\n", "a[^1]\n\n[^1]: note more\n"),
    ("$$\na  b\n$$\n", "$$\na  b\n$$\n"),
    (":::note\na   b\n:::\n", ":::note\na   b\n:::\n"),
    ("> [!NOTE]\n> a   b\n", "> [!NOTE]\n> a   b\n"),
    ("<div>\na   b\n</div>\n", "<div>\na   b\n</div>\n"),
    ("x $a   b$ y\n", "x $a   b$ y\n"),
    ("x `a  b` y\n", "x `a  b` y\n"),
    ("x [[a  b]] y\n", "x [[a  b]] y\n"),
    ("a\n\n\n\nb\n", "a\n\nb\n"),
    ("", "\n"),
    ("\n\n\na\n", "\na\n"),
])
def test_markdown(text, new):
    assert md(text) == new


def test_list_spacing():
    tight, loose = "- a\n- b\n", "- a\n\n- b\n"
    assert md(tight) == tight and md(loose) == loose
    assert md(tight, list_spacing=ListSpacing.LOOSE) == loose and md(loose, list_spacing=ListSpacing.TIGHT) == tight
    nested = "- a\n  - b\n- c\n"
    assert md(nested) == nested
    assert "\n\n" in md("- a\n\n  b\n- c\n", list_spacing=ListSpacing.TIGHT)
    assert ListSpacing.parse("Loose") is ListSpacing.LOOSE
    with pytest.raises(ValueError):
        ListSpacing.parse("wide")


def test_cleanups():
    assert md("# **A b**\n", cleanups=True) == "# A b\n" and md("# **A** b\n", cleanups=True) == "# **A** b\n"
    assert md("# ***A***\n", cleanups=True) == "# *A*\n"


def test_tags_keep_their_lines():
    text = "{% field %}\n- a\n- b\n{% /field %}\n"
    assert md(text) == "{% field %}\n\n- a\n- b\n\n{% /field %}\n"


def test_width_zero_and_plaintext():
    assert md("a\nb\n", width=0) == "a b\n"
    assert format_text("a\nb\n\nc", FormatOptions(plaintext=True)) == "a b\n\nc"
    assert format_text("a\nb", FormatOptions(plaintext=True, width=0)) == "a\nb"


@pytest.mark.parametrize("mark", ["> ", "- ", "> - ", "> > 1. "])
@pytest.mark.parametrize("depth", [3, 60, 5000])
def test_nesting_of_any_depth_is_formatted(mark, depth):
    from vellumry.formatting.markdown import checked_markdown

    head = mark * (depth // (len(mark) // 2))
    done, error = checked_markdown(head + "x   y\n")
    assert error is None and done.splitlines()[0].endswith("x") or done == head + "x y\n"
    assert checked_markdown("> " * depth + "x\ny\n")[1] is None


def test_regions_are_disjoint_and_exact():
    text = r"a `x` $y$ \(z\) <b> [[w]] {math}`q` `c`{.k} $$m$$ \begin{e}1\end{e} [issue:4]"
    found = regions.inline_regions(text)
    assert [text[r.start : r.end] == r.source for r in found].count(False) == 0
    assert all(a.end <= b.start for a, b in zip(found, found[1:]))
    assert {r.kind for r in found} == {
        "code_span", "math_dollar_inline", "math_paren_inline", "raw_html_inline", "wikilink_inline", "math_myst_inline", "attribute_group_inline", "math_double_dollar_inline",
        "math_environment_inline", "gitlab_reference_inline",
    }


@pytest.mark.parametrize("text,kind", [
    ("+++\na = 1\n+++\n", "toml_frontmatter"), ("Term\n: what it is\n", "definition_list"), ("+---+\n| a |\n+---+\n", "pandoc_grid_table"), (">>>\nq\n>>>\n", "gitlab_multiline_blockquote"),
    ("| a line\n| more\n", "pandoc_line_block"), ("{#id .c}\n", "attribute_group_block"), ("\\[\nx\n\\]\n", "math_bracket_block"), ("\\begin{a}\nx\n\\end{a}\n", "math_environment_block"),
    ("----- -----\na     b\n\nc     d\n----- -----\n", "pandoc_multiline_table"), ("$$\nx\n$$ (1)\n", "math_dollar_block"),
])
def test_protected_blocks(text, kind):
    assert blocks.parse(text)[0].protected == kind
    assert md(text) == text


def test_regions_of_a_document():
    text = (
        "---\nt: `no`\n---\n\n# H `a` {#id}\n\n```\n$x$ `no`\n\n<b> [[no]]\n```\n\n    `no`\n\n$$\nx `no`\n$$\n\n- <div>\n  `no`\n  </div>\n- b `c\n  d` e\n\n"
        "> q $y$\n> <i a=b>\n\n| `k|l` | $m |\n|---|---|\n| $n$ | o$ |\n\n> [!note]\n> `no`\n\nterm\n: `no`\n\n:::n\n`no`\n:::\n"
    )
    found = blocks.protected_regions(text)
    assert all(text[r.start : r.end] == r.source for r in found) and all(a.end <= b.start for a, b in zip(found, found[1:]))
    assert [(r.kind, r.source) for r in found] == [
        ("code_span", "`a`"), ("attribute_group_inline", "{#id}"), ("math_dollar_block", "$$\nx `no`\n$$\n"), ("raw_html_block", "- <div>\n  `no`\n  </div>\n"),
        ("code_span", "`c\n  d`"), ("math_dollar_inline", "$y$"), ("raw_html_inline", "<i a=b>"), ("code_span", "`k|l`"), ("math_dollar_inline", "$n$"),
        ("obsidian_callout", "> [!note]\n> `no`\n"), ("definition_list", "term\n: `no`\n"), ("colon_container", ":::n\n`no`\n:::\n"),
    ]
    assert {r.form for r in found if r.kind.endswith(("block", "callout", "list", "container"))} == {"block"}


PIECES = ["# h", "a b c", "- x", "1. y", "> q", "```\nz\n```", "    i", "|a|b|\n|-|-|\n|1|2|", "***", "<b>t</b>", "$m$", "[l](u)", "\"s\" it's...", "{% t %}", "**b** _i_", "\\* e", "[r]: u", "", "***x", "`c", "a  \nb", ":::n\nv\n:::"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=10), st.sampled_from(["\n", "\n\n"]), st.sampled_from([FormatOptions(), SEM, AUTO, FormatOptions(width=0), FormatOptions(width=20)]))
def test_never_fails_and_ends_with_one_newline(parts, joint, options):
    out = fill_markdown(joint.join(parts), options)
    assert "\r" not in out and out.endswith("\n") and (out == "\n" or not out.endswith("\n\n"))


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_any_text_is_formatted(text):
    assert format_text(text, AUTO).endswith("\n")


@given(st.lists(st.sampled_from(["word", "a", "longerword", "x,", "y.", "(z)", "—"]), min_size=1, max_size=60), st.sampled_from([40, 88]), st.sampled_from(["", "- ", "> "]))
def test_no_line_exceeds_the_width(words, width, prefix):
    out = md(prefix + " ".join(words) + "\n", width=width)
    assert all(len(line) <= width for line in out.split("\n"))


def test_long_and_odd_texts_stay_linear():
    import time

    start = time.time()
    for text in ("`" * 20_000, "[" * 20_000, "$a " * 20_000, "> " * 200 + "x", "a " * 100_000, "x" * 300_000, "* " * 2_000, "<" * 20_000, "{%" * 20_000, "\\(" * 20_000):
        fill_markdown(text, AUTO)
    assert time.time() - start < 60


@given(st.text(alphabet="ab `[](<>{}%#!-/\n", max_size=40))
@settings(max_examples=1000)
def test_unclosable_openings_change_no_word(text):
    joined = units.join_adjacent(text)
    assert [m.span() for m in units._WORDS.finditer(units._closable(joined, units._OPENINGS))] == [m.span() for m in units._WORDS.finditer(joined)]
    masked = units._closable(text, units._LINK_OPENINGS)
    assert [m.span() for m in units._INLINE_WORDS.finditer(masked)] == [m.span() for m in units._INLINE_WORDS.finditer(text)]


def test_atoms_stay_whole_in_long_texts():
    import time

    start = time.time()
    atoms = ["`a. b c`", "[d. e](f g)", "<i class='x y'>", "{% a b %}"]
    head = " ".join(atoms)
    for noise in ("a < b ", "a [ b ", "{% a ", "{{ a ", "{# a ", "<!-- a ", "[x]( a "):
        text = head + " Then done. " + noise * 20_000 + ("" if noise == "a < b " else head)
        assert units.atomic_words(text)[:4] == atoms
        assert units.sentences_atomic(text)[0] == head + " Then done."
    assert units.atomic_words("1 << 2 " * 2_000 + "`a b`")[-1] == "`a b`"
    assert "a. b c" in format_text("a < b and " * 3_000 + "x `a. b c` y", SEM).replace("\n`", "`")
    for opening in ("[", "<", "<a", "{{", "{%", "{#", "<!--", "[x](", "[x]["):
        units.atomic_words(opening * 50_000)
        units.sentences_atomic(opening * 50_000)
    assert time.time() - start < 60


@given(st.lists(st.sampled_from([*PIECES, "$$\nx\n$$", "<div>\n$a$", "| `a|b` | c$ |", "> $x\n> y$"]), max_size=10), st.sampled_from(["\n", "\n\n"]))
@settings(max_examples=300, deadline=None)
def test_regions_of_documents_are_disjoint_and_exact(parts, joint):
    import re

    from vellumry.functions.text import MAY_HOLD_REGIONS

    text = source.normalize(joint.join(parts))[0]
    found = blocks.protected_regions(text)
    assert not found or re.search(MAY_HOLD_REGIONS, text)
    assert len(blocks.line_frames(text)) == len(blocks.opaque_lines(text))
    assert all(text[r.start : r.end] == r.source for r in found) and all(a.end <= b.start for a, b in zip(found, found[1:]))


@given(st.lists(st.sampled_from(["a", "`b c`", "[d](e \"f\")", "*g*", "x.\ny", "# h\n", "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\U000f0000", "$m$"]), max_size=12))
@settings(deadline=None)
def test_authored_private_characters_are_like_any_other(parts):
    text = " ".join(parts)
    other = {0xE000 + k: chr(0xE100 + k) for k in range(5)}
    assert format_text(text, AUTO).translate(other) == format_text(text.translate(other), AUTO)


def test_a_document_with_a_private_character_is_formatted():
    assert md("icon \ue001\nand `a\ue002b` text\n") == "icon \ue001 and `a\ue002b` text\n"

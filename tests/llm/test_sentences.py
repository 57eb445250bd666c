"""Sentence units: cases by language and script, and awkward inputs."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumry.llm.sentences import AbbreviationTrie, sentence_ends, sentence_units, unit_offsets

#: "|" marks the expected ends.
CASES = [
    "One here.| Two there!| Three?|",
    "Dr. Ada met Mr. B. Cole of Quire Ltd. yesterday.| They left at 5 p.m. on Monday.| It ended at 6 p.m.| Then rain.|",
    "It rose from 3.5 to .7 on Dec. 3, i.e. by half.| See Fig. 3 and Sec. 4.2 for more.|",
    "We chose plan B.| Nothing changed.| The team of K. Oster, B. Vale et al. agreed.|",
    "Open a.b.c or file_x.txt now.| load_it() returns early... and nobody minds.| Really… we forgot.|",
    "\"Stop it!\" said the clerk.| \"Why not?\" she asked.| He asked, \"Is it? It is.\" and left.|",
    "“It fell. We saw,” wrote Ann.| Use `a. B` and `c? D` there.| Read [ch. 1. Start](./a.b.md) first.|",
    "Off (it was on. Yes. Once) now.| (Nobody saw it.)| Then more (see p. 3).| End|",
    "Rule no. 4. a) covers it, and No. 5 is empty.| Chapters 1.–3. stay.|",
    "It waits.|K. Oster of Quire left.|Dr. Vale came.| Glued to it.|Next one starts.| What?!| Done.|",
    "Etwa z. B. hier, d. h. da, usw.| Am 3. März kam Frau Dr. Lang.| „So. Und so“, rief er.|",
    "M. Roux a lu 3 notes, cf. p. 9.| « Tout va. Rien ne va. » note M. Roux.| Est-ce vrai ?| Oui !|",
    "El Sr. Paz mide 3 m, p. ej. aquí, etc.| ¿Por qué?| «No. Nunca», dijo la Dra. Sol.|",
    "Таблицы и т. д.| «Да. Нет», — сказал он.| См. рис. 3 в 2020 г. и далее.|",
    "Γιατί αλλάζει;| Ο κ. Νίκος ήρθε, π.χ. χθες.|",
    "Առաջին։| Երկրորդ։|",
    "لماذا؟| كتب د. سامي هنا.| نعم!|",
    "यह है।| डॉ. राम आए।| क्यों?|",
    "他说：“好了。走吧。”然后离开。|版本3.2可用……至少目前。|对吗？|",
    "据K. Oster说，读取器保留。|再见。|",
    "彼は「はい。いいえ。」と言った。|表（例：図4。）は残る。|終わり！|",
    "ตัวอ่านเก็บรายการ| รุ่น 2.1 ทำงาน| เราเหลือ 9 ไฟล์ที่นี่|",
    "Title\n\nText goes\non here.| No end|\n \n\nNext|",
]


@pytest.mark.parametrize("case", CASES)
def test_boundaries(case):
    case = case.replace("Title\n\n", "Title|\n\n")
    text, want = "", []
    for part in case.split("|")[:-1]:
        text += part
        want.append(len(text))
    assert sentence_ends(text + case.rsplit("|", 1)[1]) == want


@pytest.mark.parametrize("case", [
    "# Title|\n- First item|\n- Second item.| It has two.| They end|\n  - Deeper one\n    goes on|\n- Back again|",
    "1. One|\n2. Two, see vol.\n33) here on p. 4|\n3. Three|",
    "Prose with vol.\n33) inside and\n- 4 in it.|",
    "* a “b. c|\n* d” e. f|",
    "Text.|\n## Head|\nMore text|",
])
def test_list_levels_and_headings(case):
    text, want = "", []
    for part in case.split("|")[:-1]:
        text += part
        want.append(len(text))
    assert sentence_ends(text) == want


@pytest.mark.parametrize("short,long", [
    ("Τι; Ναι.", "Τι " + "a" * 400 + "; Ναι."), ("plan B. Next one.", "plan" + " " * 400 + "B. Next one."), ("x (" * 3 + "“a. b” C. D." , "x (" * 3000 + "“a. b” C. D."),
    ("“" + "(" * 3 + " a. B", "“" + "(" * 500 + " a. B"), ("“a" + "(" * 3 + "b. C” D. E", "“a" + "(" * 500 + "b. C” D. E"),
])
def test_length_and_depth_change_nothing(short, long):
    assert len(sentence_ends(short)) == len(sentence_ends(long))


def test_unit_counts(spark):
    from vellumry.llm.sentences import unit_counts

    df = spark.createDataFrame([(1, "An ab. So do.", "k"), (1, "An ab. So do.", "k"), (2, None, "k"), (3, " ", None)], "id bigint, text string, kind string")
    assert sorted(map(str, unit_counts(df, "id", ["kind"]).collect())) == sorted(["Row(kind='k', n_units=2)"] * 2 + ["Row(kind='k', n_units=0)", "Row(kind=None, n_units=0)"])


def test_offsets_count_other_characters_than_white_space():
    assert unit_offsets(" An ab.\u3000 So\xa0 do. ") == [5, 10]
    assert unit_offsets(None) == unit_offsets("") == unit_offsets(" \n\t ") == []


def test_unclosed_marks_do_not_swallow_the_text():
    assert len(sentence_ends("He said \"one. Two (three. Four [five. Six `seven. Eight.")) >= 5


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aA .!?。\n\"'()[]`“”«»…;;ก1_-", max_size=80))
def test_units_cover_the_text_once(text):
    ends = sentence_ends(text)
    offsets = unit_offsets(text)
    assert ends == sorted(set(ends)) and offsets == sorted(set(offsets))
    solid = len("".join(text.split()))
    assert not solid or offsets[-1] == solid


def test_trie_finds_the_longest_abbreviation():
    trie = AbbreviationTrie({"x": ["z.B", "B"]})
    assert trie.before("etwa z. B. so", 9, 0) == "x" and trie.before("Klub. so", 4, 0) is None


def test_operator_on_awkward_rows(spark):
    df = spark.createDataFrame([(1, "An ab. So do.", 0), (1, "An ab. So do.", 0), (2, None, 1), (3, "", 1), (None, "x", 1), (4, "w. " * 50_000, 1)], "id bigint, text string, end_at int")
    got = sentence_units(df, "id")
    assert [tuple(r) for r in got.where("id = 1").orderBy("end_at").collect()] == [(1, 5), (1, 10)]
    assert got.where("id in (2, 3) or id is null").count() == 0 and got.where("id = 4").count() >= 1
    assert sentence_units(df.limit(0), "id").count() == 0


def test_long_texts_stay_linear():
    import time

    start = time.time()
    for text in ("(" * 50_000, "\"a " * 30_000, "`" * 50_000, "a. " * 50_000, "x" * 500_000, "“" * 30_000, "." * 100_000, "\n" * 200_000, "[a](b " * 10_000):
        unit_offsets(text)
    assert time.time() - start < 60

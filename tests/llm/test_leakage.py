"""Leaks against a brute-force search, variants of passages, and awkward inputs."""

import random

import pytest

from vellumry.llm import leakage

WORDS = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
ITEM = "Explain why the quiet lantern outlives every narrow bridge. The answer names the patient river, which borrows one gilded stone near the old mill; nobody counts it twice."


def brute(doc: str, item: str) -> bool:
    """Any part of at least 12 item words, matched at both ends, within one edit in eight."""
    d, t = leakage.tokens(doc), leakage.tokens(item)
    for a in range(len(t) - 11):
        for s in range(len(d)):
            if d[s] != t[a]:
                continue
            row = list(range(len(d) - s + 1))  # edit distance of growing parts from (a, s)
            for i in range(a, len(t)):
                new = [row[0] + 1]
                for j in range(1, len(row)):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (t[i] != d[s + j - 1])))
                row = new
                n = i - a + 1
                if n >= 12 and any(row[j] * 8 <= n and d[s + j - 1] == t[i] for j in range(1, len(row))):
                    return True
    return False


def edited(words, rng, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(1, len(out) - 1)
        kind = rng.choice("rai")
        out[k : k + 1] = {"r": ["other"], "a": [out[k], "added"], "i": []}[kind]
    return out


def test_against_brute_force():
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(14, 40)))) for i in range(12)]
    own = leakage.Items(items)
    docs = []
    for _ in range(120):
        _, text = rng.choice(items)
        words = text.split()
        n = rng.randrange(6, len(words) + 1)
        a = rng.randrange(len(words) - n + 1)
        part = edited(words[a : a + n], rng, rng.choice([0, 0, 1, 1, 2, 3, 5]))
        docs.append(" ".join(rng.choices(WORDS, k=5) + part + rng.choices(WORDS, k=5)))
    got = set(own.find(docs))
    want = {(d, i) for d, doc in enumerate(docs) for i, text in items if brute(doc, text)}
    assert not got - want
    assert len(got & want) >= 0.98 * len(want)


@pytest.mark.parametrize("change", [
    lambda t: t, str.upper, lambda t: t.replace(" ", "\n * "), lambda t: t.replace("e", "e­"), lambda t: t.replace("a", "​a"),
    lambda t: "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else "　" for c in t), lambda t: " ".join(f"_{w}_" for w in t.split()), lambda t: t.replace("the", "<b>the</b>"),
    lambda t: '{"text": "' + t.replace(". ", ".\\n") + '"}', lambda t: t.replace("o", "о").replace("e", "é"), lambda t: t.replace("river", "stream"), lambda t: t.replace("patient ", ""),
    lambda t: " ".join(t.split()[5:17]), lambda t: t.replace("lantern", "[lantern](https://x.example/a_b)"),
])
def test_variants_are_found(change):
    assert leakage.Items([(7, ITEM)]).find(["Some text before. " + change(ITEM) + " and after."]) == [(0, 7)]


@pytest.mark.parametrize("text", ["", " ".join(ITEM.split()[3:12]), "The quiet bridge outlives the narrow lantern; every river names one stone near the gilded mill and nobody borrows it.", None])
def test_short_quotations_and_look_alikes_are_not(text):
    assert leakage.Items([(7, ITEM)]).find([text]) == []


def test_chinese():
    item = "旧式校对记号托起错排的诗行逢单数印张。倾斜的装订线延后空置的脚注于再校之后。"
    own = leakage.Items([(1, item)])
    assert own.find([" ".join(item), item[:26].replace("。", ""), item[3:15], "前文" + item.replace("装订线", "新线")]) == [(0, 1), (1, 1), (3, 1)]


def test_operator(spark):
    docs = spark.createDataFrame([(1, "x " + ITEM, 5), (1, "x " + ITEM, 5), (2, None, 5), (3, "", 5), (None, ITEM, 5), (4, "filler words here " * 30_000 + ITEM, 5)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, ITEM + " More."), (9, None), (10, ""), (None, ITEM)], "item_id bigint, text string")
    want = [(1, 7), (1, 8), (4, 7), (4, 8)]
    assert sorted(map(tuple, leakage.find_leaks(docs, items).collect())) == want
    assert sorted(map(tuple, leakage.find_leaks(docs, items, block_chars=100).collect())) == want
    assert leakage.find_leaks(docs.limit(0), items).count() == 0 and leakage.find_leaks(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("n", [12, 13])
@pytest.mark.parametrize("place", [1, -2])
def test_an_edit_next_to_an_end_is_part_of_the_passage(n, place):
    own = [f"w{i}" for i in range(30)]
    part = own[8 : 8 + n]
    part[place] = "other"
    items = leakage.Items([(1, " ".join(own))])
    assert items.find(["before it " + " ".join(part) + " behind it"]) == [(0, 1)]
    part[4] = "more"
    assert items.find(["before it " + " ".join(part) + " behind it"]) == []


def test_edits_in_chinese_count_half_a_word():
    own = "".join(map(chr, range(0x4E00, 0x4E00 + 40)))
    items = leakage.Items([(1, own)])
    part = own[5:29]
    assert items.find([part[:21] + "鼠龙" + part[23:]]) == [(0, 1)]  # a word replaced before the last character
    assert items.find([part[:8] + "鼠" + part[8:16] + "龙" + part[16:]]) == [(0, 1)]  # two characters added
    assert items.find([part[:6] + "鼠" + part[6:12] + "龙" + part[12:18] + "龟" + part[18:]]) == [(0, 1)]
    assert items.find([part[:5] + "鼠" + part[5:10] + "龙" + part[10:15] + "龟" + part[15:20] + "鼎" + part[20:]]) == []

"""Sentence boundaries across languages and scripts (problem 2).

A pushdown automaton reads each paragraph once.  List levels are pushed and popped by
indent, and an item ends with its level; quotations, brackets, links and code spans are
pushed when they open and popped when they close, so that terminators inside them do not
end the sentence around them.  At depth zero a terminator of any script may end a
sentence; a full stop is checked against a trie of abbreviations and against what
follows.  Blank lines, list items and headings end every unit.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumry.runtime import spread

# The characters with the property White_Space.
WS = "\t\n\x0b\x0c\r \x85\xa0  -     　"

# Abbreviations that never end a sentence.
NEVER = (
    "Mr Mrs Ms Mx Dr Dra Prof Sr Sra Srta Mme Mlle MM Hr Fr Frl Herrn St Ste Hon Rev Gen Col Capt Lt Sgt Gov Sen Rep Pres Dipl Ing "
    "e.g i.e cf vs viz approx ca bzw aprox env resp vgl evtl ggf inkl exkl bspw sog gem lt zzgl geb gest "
    "z.B d.h u.a z.T i.d.R s.o s.u o.g p.ej p.ex c.-à-d п.е т.е т.к т.н π.χ δηλ βλ κ κα κος г-н г-жа им д.р "
    "डॉ श्री د أ م ا"
).split()
# Abbreviations before a number or a name; otherwise ordinary words.
BEFORE_NUMBER = (
    "no nos No Nos nr Nr n Nº fig figs Fig Figs Abb abb Tab sec Sec secs Secs ch Ch chap Chap vol Vol p pp S Bd Kap art Art Nr num núm pág págs "
    "eq Eq Ref ref ver Ver рис табл стр гл см См п ст № rev Rev op sect par"
).split()
# Abbreviations that may also be the last word of a sentence.
MAY_END = (
    "etc usw usf al Ltd Inc Co Corp Bros Jr a.m p.m A.M P.M Ph.D M.D B.A M.A U.S U.K U.S.A U.N E.U т.д т.п т. др г гг в вв руб тыс млн "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mon Tue Wed Thu Fri Sat Sun u.s.w u.v.m κ.λπ κ.ά κλπ min max est dept Dept Ave Blvd Rd "
    "janv févr juil sept oct nov déc ene abr ago dic"
).split()
# Those of them after which a sentence may begin with a small letter or a digit.
OPEN_ENDED = "etc usw usf a.m p.m u.s.w т.д т.п κ.λπ κλπ".split()
# Month names that follow an ordinal number with a full stop.
MONTHS = "Januar Jänner Februar Feber März April Mai Juni Juli August September Oktober November Dezember".split()
# Words before a single capital letter that names a thing, not a person.
LETTERED = (
    "plan option version appendix part section group type class vitamin grade level point step item figure table chapter schedule exhibit annex case "
    "variant team unit block column row phase build branch side hepatitis model series wing gate terminal zone"
).split()
# Small words that continue a sentence after an abbreviation that may end one.
CONTINUING = (
    "a an the and or but nor so yet on in at of to by for from with without as if when while until unless because before after since than that which who "
    "whose where is are was were be been has have had do does did will would can could may might must should not never it its his her their our your my "
    "und oder aber bei mit von zu im am in den dem der die das ist sind war et ou mais de du des le la les en sur y o pero con por para el los las del и или "
    "но в на с по за из что как не και ή σε στο στη με pm am per via into onto over under"
).split()
# Sentence terminators that need no look at what follows, and those that do.
SURE = "。！？｡։؟۔।॥።፧။៕᠃᠉⸮‽"
ASKING = "!?"
CLOSERS = "\"”’»›“‘)]}」』】）〉》〗'`*_"

# Paired marks.
OPEN_TO_CLOSE = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "【": "】", "〈": "〉", "《": "》", "“": "”", "„": "“”", "«": "»", "‹": "›", "‚": "‘’", "‘": "’"}
CLOSE = {c for cs in OPEN_TO_CLOSE.values() for c in cs}

_PARAGRAPHS = re.compile(rf"(?:\r\n|[\n\r\x85  \x0b\x0c])[{WS}]*?(?:\r\n|[\n\r\x85  \x0b\x0c])[{WS}]*|\Z")
_SPACE = re.compile(f"[{WS}]+")
_MARKS = re.compile(r"`+|[(\[{（「『【〈《“„«‹‚‘)\]}）」』】〉》”»›’\"']|https?://[^\s<>\"”」』（）)。，]+")
_STOPS = re.compile(rf"[{SURE}{ASKING}.…;;]+")
#: Where the word before a stop begins: behind white space or an opening mark.
_WORD_EDGE = frozenset("([{（「『“„«\"'’`/") | frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WS}]", c))
#: Closing mark -> the opening marks that it closes.
_OPENERS = {c: [o for o, cs in OPEN_TO_CLOSE.items() if c in cs] for c in CLOSE} | {c: [c] for c in "\"'"}
_LINE = re.compile(r"[^\r\n]*")
_ITEM = re.compile(r"([ \t]*)(?:([-*+])|(\d{1,9})([.)]))[ \t]+(?=[^\s])")
_HEADING = re.compile(r"[ ]{0,3}#{1,6}[ \t]+")
_MAY_HOLD_LEVELS = re.compile(rf"{_ITEM.pattern}|{_HEADING.pattern}|[^\r\n]*[\r\n]+[ ]{{0,3}}#")
_NEXT = re.compile(rf"[^{WS}]+")
_GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
_THAI_GAP = re.compile(f"(?<=[ก-๛])[{WS}]+(?=[ก-๛]|[A-Z][a-z]+[{WS}]+[A-Za-z])")
_LABEL = re.compile(r"\(?[a-z0-9]{1,2}\)")


class AbbreviationTrie:
    """Abbreviations, reversed, so that one is found by walking left from its full stop."""

    def __init__(self, groups: dict[str, list[str]]) -> None:
        self.root: dict = {}
        for kind, words in groups.items():
            for word in words:
                node = self.root
                for c in reversed(word):
                    node = node.setdefault(c, {})
                node["kind"] = kind

    def before(self, text: str, stop: int, start: int) -> str | None:
        """The kind of the longest abbreviation that ends at ``stop``; spaces after inner stops do not matter."""
        node, i, found = self.root, stop - 1, None
        while i >= start:
            c = text[i]
            if c in " \xa0\n  " and "." in node and text[i - 1 : i] == ".":
                i -= 1
                continue
            if c not in node:
                break
            node = node[c]
            i -= 1
            if "kind" in node and (i < start or not (text[i].isalpha() or (text[i] == "." and text[i - 1 : i].isalpha() and not (text[i + 1].isupper() and text[max(start, i - 2) : i].islower() and i - start > 2)))):
                found = node["kind"]
        return found


TRIE = AbbreviationTrie({"number": BEFORE_NUMBER, "never": NEVER, "may": MAY_END, "open": OPEN_ENDED})


def pairs(text: str, start: int, stop: int) -> list[tuple[int, int, str]]:
    """Outermost matched quotations, brackets, links and code spans of a paragraph.

    The automaton pushes each opening mark and pops through it when it closes; marks
    that are never closed are dropped, so they cannot swallow the paragraph.
    """
    stack: list[tuple[str, int]] = []
    held: Counter = Counter()  # marks on the stack
    found: list[tuple[int, int, str]] = []
    pos = start
    while m := _MARKS.search(text, pos, stop):
        mark, at, pos = m.group(), m.start(), m.end()
        if mark[0] == "`":
            run = re.compile(rf"(?<!`){mark}(?!`)").search(text, pos, stop)
            if run:
                found.append((at, run.end(), "`"))
                pos = run.end()
            continue
        if mark[0] == "h":
            end = pos
            while text[end - 1] in ".,;:!?'":
                end -= 1
            found.append((at, end, "u"))
            pos = end
            continue
        before, after = text[at - 1 : at] if at > start else " ", text[at + 1 : at + 2] or " "
        known = any(held[o] for o in _OPENERS.get(mark, ()))
        if mark in "\"'":
            if mark == "'" and (before.isalnum() and (after.isalnum() or not known)):
                continue
            if not known and (mark == '"' or not before.isalnum()) and not after.isspace():
                stack.append((mark, at))
                held[mark] += 1
                continue
        elif mark in OPEN_TO_CLOSE and not (mark in "“‘" and known):
            stack.append((mark, at))
            held[mark] += 1
            continue
        elif mark == "’" and before.isalnum() and after.isalnum():
            continue
        if not known:
            continue
        while True:  # everything opened since is left open, and dropped
            opener, since = stack.pop()
            held[opener] -= 1
            if opener in _OPENERS[mark]:
                break
        found.append((since, pos, opener))
        if opener == "[" and text[pos : pos + 1] == "(":  # the target of a link belongs to it
            end = text.find(")", pos, stop)
            if end > 0 and not any(c in WS for c in text[pos:end]):
                found[-1] = (since, end + 1, "[")
                pos = end + 1
    found.sort()
    outer: list[tuple[int, int, str]] = []
    for p in found:
        if not outer or p[0] >= outer[-1][1]:
            outer.append(p)
    return outer


#: The end of a sentence and a capital behind it without a space.
_GLUED = re.compile(r".*[^\W\d_A-Z]{2}\.(?=[A-Z])")


def _word_before(text: str, begin: int, at: int) -> str:
    k = at
    while k > begin and text[k - 1] not in _WORD_EDGE and (k == at or ord(text[k - 1]) < 0x2E80):
        k -= 1  # a Latin word may stand right behind Chinese or Japanese ones
    word = text[k:at]
    return word[m.end() :] if (m := _GLUED.match(word)) else word


def _starts(token: str) -> bool:
    """Whether a following word can begin a sentence after an abbreviation."""
    bare = token.lstrip("\"'“„«‹‘([（「『¿¡*_`")
    if not bare:
        return bool(token)
    if not bare[0].islower():
        return True
    word = re.match(r"[^\W\d_]+", bare)
    return "_" in bare or "(" in bare or bare[1:2].isupper() or (word is not None and word.group() not in CONTINUING and len(word.group()) > 2)


def _stop_ends(text: str, at: int, end: int, begin: int, limit: int) -> bool:
    """Whether the full stop (or ellipsis) text[at:end] ends the sentence begun at ``begin``."""
    after = _NEXT.match(text, m.end()) if (m := _SPACE.match(text, end)) and m.end() < limit else None
    if end < limit and not m:
        before, rest = text[at - 1 : at], text[end : end + 3]
        initial = rest[1:2] == "." and rest[2:3] in WS and before.islower()
        glued = (before.islower() or before.isdigit() or before in ")%") and rest[:1].isupper() and (rest[1:2].islower() or rest[1:2] in WS or initial)
        if not glued or TRIE.before(text, at, begin) is not None or end - at > 1:
            return False
        word = _word_before(text, begin, at)
        return len(word) > 1
    if after is None:
        return True
    token = after.group()
    if end - at > 1 or text[at] == "…":
        return token.lstrip("\"“„«¿¡(")[:1].isupper()
    word = _word_before(text, begin, at)
    if not word:
        return True
    bare = token.lstrip("\"'“„«‹‘([（¿¡")
    if word[-1].isdigit():
        if bare.rstrip(".,;:!?") in MONTHS or _LABEL.match(token):
            return False
        ordinal = "–" in word or "-" in word[1:] and word[0].isdigit()
        return not (ordinal and bare[:1].islower())
    kind = TRIE.before(text, at, begin)
    single = len(word) == 1 and word.isalpha()
    if kind == "never":
        return False
    if kind == "number" and (bare[:1].isdigit() or word[0].isupper() and len(word) == 1 or token[:1] in "#§" or (bare[:1].islower() and len(word) < 4 and word not in ("no", "No"))):
        return False
    if kind == "may":
        return bool(bare) and not bare[0].islower() and not bare[0].isdigit()
    if kind == "open":
        return _starts(token)
    if single:
        if word.isupper():
            stop = at - 1
            while stop > begin and text[stop - 1].isspace():
                stop -= 1
            k = stop
            while k > begin and not text[k - 1].isspace():
                k -= 1
            return text[k:stop].strip("(\"'“„«").lower() in LETTERED and _starts(token)
        return word == "I" or not word.isascii() and not (word.isupper() or word.islower()) and _starts(token) and ord(word) > 0x2E7F
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word):
        return bare[:1].isupper() and bare in ("The", "It", "In", "This", "That", "We", "He", "She", "They", "A", "An", "But", "And")
    return True


def sentence_ends(text: str) -> list[int]:
    """Offsets just behind each sentence unit of ``text``, in code points."""
    ends: list[int] = []
    start = 0
    for gap in _PARAGRAPHS.finditer(text):
        if gap.start() < start:
            continue
        for a, b in levels(text, start, gap.start()):
            ends += _paragraph(text, a, b)
        start = gap.end()
    return ends


def levels(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """The parts of a paragraph that are units of their own: list items and headings.

    The stack holds the open list levels as (indent, kind of mark, number).  A deeper mark pushes a
    level, a shallower one pops; either way the item before it ends, and with it whatever
    was opened inside.  A list begins with a paragraph or below a heading; a number counts
    only if it is 1 or follows the one before, so wrapped prose is no item.  Marks are not
    part of their items.
    """
    if not _MAY_HOLD_LEVELS.match(text, start, stop):
        return [(start, stop)]
    parts: list[tuple[int, int]] = []
    stack: list[tuple[int, str, int]] = []
    begin, at, fresh = start, start, True
    while at < stop:
        end = _LINE.match(text, at, stop).end()
        if m := _HEADING.match(text, at, end):
            parts += [(begin, at), (m.end(), end)]
            stack, begin, fresh = [], end, True
        elif (m := _ITEM.match(text, at, end)) and (fresh or stack):
            indent, kind = len(m[1].expandtabs(4)), m[2] or m[4]
            while len(stack) > 1 and indent < stack[-1][0]:
                stack.pop()
            n = int(m[3] or 0)
            sibling = bool(stack) and stack[-1][1] == kind and abs(indent - stack[-1][0]) < 2 and (m[2] or n in (stack[-1][2], stack[-1][2] + 1))
            if fresh or sibling or m[2] or n == 1:
                stack = (stack[:-1] if sibling else [s for s in stack if s[0] < indent]) + [(indent, kind, n)]
                parts.append((begin, at))
                begin = m.end()
            fresh = False
        elif end > at:
            fresh = False
        at = end + 1
    return [(a, b) for a, b in [*parts, (begin, stop)] if a < b]


def _paragraph(text: str, start: int, stop: int) -> list[int]:
    while stop > start and _SPACE.match(text[stop - 1]):
        stop -= 1
    if m := _SPACE.match(text, start):
        start = m.end()
    if start >= stop:
        return []
    inner = pairs(text, start, stop)
    opened = [p[0] for p in inner]
    greek = [m.start() for m in _GREEK.finditer(text, start, stop)] if ";" in text else []
    ends: list[int] = []
    begin = start

    def close(at: int) -> None:
        nonlocal begin
        ends.append(at)
        m = _SPACE.match(text, at)
        begin = m.end() if m else at

    events = [(m.start(), m.end(), "stop") for m in _STOPS.finditer(text, start, stop)]
    events += [(m.start(), m.end(), "gap") for m in _THAI_GAP.finditer(text, start, stop)]
    events += [(a, b, kind) for a, b, kind in inner]
    for at, end, kind in sorted(events):
        if at < begin:
            continue
        k = bisect_right(opened, at) - 1
        if kind in ("stop", "gap") and k >= 0 and at < inner[k][1]:
            continue  # the automaton's stack is not empty here
        if kind == "gap":
            close(at)
        elif kind == "stop":
            while end < stop and text[end] in CLOSERS and not (bisect_right(opened, end) and opened[bisect_right(opened, end) - 1] == end):
                end += 1
            mark = text[at:end].rstrip(CLOSERS)
            if any(c in SURE for c in mark):
                close(end)
            elif any(c in ASKING for c in mark):
                if end >= stop or _SPACE.match(text, end) or text[end].isupper() or ord(text[end]) > 0x2E7F or end in opened:
                    close(end)
            elif ";" in mark or ";" in mark:
                letter = bisect_left(greek, begin)  # the first Greek letter of the sentence
                if (";" in mark or letter < len(greek) and greek[letter] < at) and (end >= stop or _SPACE.match(text, end)):
                    close(end)
            elif _stop_ends(text, at, at + len(mark), begin, stop):
                close(end)
        elif kind not in "`u[":
            last = text[at:end].rstrip(CLOSERS + " \xa0 ")[-1:]
            if last and last in SURE + ASKING + ".…":
                following = _NEXT.match(text, m.end()) if (m := _SPACE.match(text, end)) else None
                whole = at == begin and kind in "(（[【"
                word = following.group().lstrip("\"'“„«‹‘([（¿¡") if following else ""
                latin = word[:1].isupper() and kind not in "(（{" and last in ".!?" and len(text[at:end]) > 4
                if whole or latin:
                    close(end)
    if begin < stop:
        ends.append(stop)
    return ends


def unit_offsets(text: str | None) -> list[int]:
    """Non-white characters up to the end of each unit; null and blank texts have none."""
    if not text:
        return []
    ends = sentence_ends(text)
    out, seen, pos = [], 0, 0
    for end in ends:
        seen += len(_SPACE.sub("", text[pos:end]))
        pos = end
        if seen and (not out or out[-1] != seen):
            out.append(seen)
    return out


def sentence_units(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, end_at) for each sentence unit of each row, as defined by ``unit_offsets``.

    Rows without an id, with null, empty or blank text have no unit; repeated rows give
    equal results, which are returned once; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ends = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = unit_offsets(t)
                ids += [i] * len(found)
                ends += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(ends, pa.int64())], names=[id_col, "end_at"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, F.col(text_col).cast("string")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    return spread(rows, id_col).mapInArrow(run, f"`{id_col}` {kind}, end_at bigint").distinct()


def unit_counts(docs: DataFrame, id_col: str, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, n_units) of each row, in the pass that reads the texts: nothing is shuffled.

    Null, empty and blank texts have 0 units; repeated rows are counted each.
    """

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(unit_offsets(t)) for t in texts], dtype="int64")

    rows = spread(docs.select(id_col, *keys, F.col(text_col).cast("string").alias("_t")), id_col)
    return rows.select(*keys, count("_t").alias("n_units"))

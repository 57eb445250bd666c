"""Evaluation texts leaking into training text (problem 7).

Texts are folded to tokens (words, or single characters in Chinese) that ignore case,
white space, punctuation, markup, character variants and invisible characters.  Every
run of five item tokens is a seed.  A passage of at least 12 words with at most one
edit in eight always holds an unbroken run of five, so seeds miss no leak.  Pairs of a
document and an item that share a seed are compared by Smith-Waterman alignment,
rarest seeds first, scored by the leak rule itself, and the alignment decides.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellumry.runtime import spread

SEED = 5
#: A leak holds at least so many words of an item ...
LEAST_WORDS = 12.0
#: ... of which one in so many may be replaced, added or missing.
WORDS_PER_EDIT = 8.0
#: A Chinese character counts as half a word (24 characters are 12 words).
CJK_WEIGHT = 0.5

_ASCII_WORDS = re.compile("[a-z0-9]+").findall
_WORDS = re.compile("[㐀-䶿一-鿿豈-﫿]|[^\\W_㐀-䶿一-鿿豈-﫿]+").findall
_NON_CJK_WORDS = re.compile("[^\\W_]+").findall
_CJK = re.compile("[㐀-䶿一-鿿豈-﫿]")
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\U000e0000-\U000e01ef]")
_MARKS = re.compile("[̀-ͯ]")
_ESCAPES = re.compile(r"\\[nrt]")
_INLINE_TAG = re.compile(r"</?(?:b|i|u|s|em|strong|span|sup|sub|mark|code|a|font|small|big|del|ins|kbd|tt|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_TARGET = re.compile(r"\]\([^()\s]*\)")
_LOOKS = re.compile("[Ͱ-ϿЀ-ӿ]")
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("авекмнорстухіјѕһԛԝԁɡαορνικυ", "abekmhopctyxijshqwdgaopviku")


def tokens(text: str | None) -> list[str]:
    """The folded tokens of a text; null and empty texts have none."""
    if not text:
        return []
    if "\\" in text:
        text = _ESCAPES.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE_TAG.sub("", text))
    if "](" in text:
        text = _TARGET.sub(" ", text)
    if text.isascii():
        return _ASCII_WORDS(text.lower())
    text = _MARKS.sub("", unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))).casefold()
    if _LOOKS.search(text):
        text = text.translate(HOMOGLYPHS)
    return _WORDS(text) if _CJK.search(text) else _NON_CJK_WORDS(text)


def _weight(token: str) -> float:
    return CJK_WEIGHT if _CJK.match(token) else 1.0


def _hashes(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of SEED ids."""
    out = np.zeros(max(0, len(ids) - SEED + 1), np.uint64)
    ids = ids.astype(np.uint64)
    for k in range(SEED):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(out)] + np.uint64(1)
    return out


class Items:
    """The items of one block: their tokens, vocabulary and seeds."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.weights = [0.0]
        self.names, self.tokens = [], []
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in rows:
            ids = []
            for t in tokens(text):
                if t not in self.vocabulary:
                    self.vocabulary[t] = len(self.weights)
                    self.weights.append(_weight(t))
                ids.append(self.vocabulary[t])
            for at, h in enumerate(_hashes(np.array(ids, np.int64)).tolist()):
                postings[h].append((len(self.names), at))
            self.names.append(name)
            self.tokens.append(np.array(ids, np.int64))
        # Weights in half words; the ids of unknown tokens are 0 and, from the end, -1 (Chinese).
        self.halves = np.array([2, *(int(2 * w) for w in self.weights[1:]), 1], np.int64)
        self.postings = dict(postings)
        self.seeds = np.array(sorted(postings), np.uint64)

    def find(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(index of the text, item) of each leak."""
        get = self.vocabulary.get
        ids: list[int] = []
        starts = []
        for text in texts:
            starts.append(len(ids))
            if text and not text.isascii():
                ids += [get(t) or (-1 if _CJK.match(t) else 0) for t in tokens(text)]
            else:
                ids += [get(t, 0) for t in tokens(text)]
            ids.append(0)
        if not ids or not len(self.seeds):
            return []
        flat = np.array(ids, np.int64)
        known = np.concatenate([[0], np.cumsum(flat > 0)])
        runs = np.flatnonzero(known[SEED:] - known[:-SEED] == SEED)
        if not len(runs):
            return []
        hashes = _hashes_at(flat, runs)
        place = np.searchsorted(self.seeds, hashes)
        place[place == len(self.seeds)] = 0
        hit = self.seeds[place] == hashes
        runs, hashes = runs[hit], hashes[hit]
        owner = np.searchsorted(np.array(starts), runs, side="right") - 1
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for at, h, doc in zip(runs.tolist(), hashes.tolist(), owner.tolist()):
            posted = self.postings[h]
            for item, where in posted:
                found[doc, item].append((len(posted), at, where))
        ends = [*starts[1:], len(ids)]
        return [(doc, self.names[item]) for (doc, item), seeds in found.items() if self._leaks(flat, starts[doc], ends[doc] - 1, item, sorted(seeds))]

    def _leaks(self, flat: np.ndarray, low: int, high: int, item: int, seeds: list[tuple[int, int, int]]) -> bool:
        # A part of n words with e edits keeps at least n - 4 - 5e seeds in place: at n >= 12
        # and e <= n / 8 that is two or more, so a pair with one seed cannot be a leak.
        if len({where for _, _, where in seeds}) < 2:
            return False
        own = self.tokens[item]
        weights = self.halves[own]
        # A Chinese passage has twice the tokens of one in words.
        reach = 16 if (weights == 2).all() else 32
        covered: set[tuple[int, int]] = set()
        failed: set[tuple[int, int, bytes]] = set()
        for _, at, where in seeds:
            if (at, where) in covered:
                continue
            slack = len(own) // 4 + 8
            a, b = max(low, at - where - slack), min(high, at + len(own) - where + slack)
            near = set(flat[max(a, at - reach - 2) : at + SEED + reach + 2].tolist())
            around = own[max(0, where - reach) : where + SEED + reach]
            if sum(self.weights[t] for t in around.tolist() if t in near) < LEAST_WORDS * (1 - 1 / WORDS_PER_EDIT):
                continue
            surroundings = (where, at - a, flat[a:b].tobytes())
            if surroundings in failed:
                continue  # the same words again, as in a text that repeats itself
            doc = flat[a:b]
            if _holds(doc, own, self.halves[doc], weights, at - a, where):
                return True
            # A stretch through another seed of the same unbroken run may as well take in this one.
            k = 1
            while at + k + SEED <= b and where + k + SEED <= len(own) and flat[at + k + SEED - 1] == own[where + k + SEED - 1]:
                covered.add((at + k, where + k))
                k += 1
            k = 1
            while at - k >= a and where - k >= 0 and flat[at - k] == own[where - k]:
                covered.add((at - k, where - k))
                k += 1
            failed.add(surroundings)
        return False


def _hashes_at(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(SEED):
        out = out * np.uint64(0x9E3779B97F4A7C15) + flat[at + k].astype(np.uint64) + np.uint64(1)
    return out


def _holds(doc: np.ndarray, own: np.ndarray, doc_weights: np.ndarray, own_weights: np.ndarray, at: int, where: int) -> bool:
    """Whether a leak runs through the seed doc[at:], own[where:]; weights in half words.

    A stretch of the item is a leak if it is long enough and its slack, the length less
    WORDS_PER_EDIT for each edit, is not negative.  Both sides of the seed are aligned for
    the most slack at each length, so the rule itself chooses the stretch.
    """
    stop, end = at + SEED, where + SEED
    seed = int(own_weights[where:end].sum())
    left, right = int(own_weights[:where].sum()), int(own_weights[end:].sum())
    size, slack = _stretches(doc[:at][::-1], own[:where][::-1], doc_weights[:at][::-1], own_weights[:where][::-1], seed + right)
    size_2, slack_2 = _stretches(doc[stop:], own[end:], doc_weights[stop:], own_weights[end:], seed + left)
    long = size[:, None] + size_2[None, :] >= 2 * LEAST_WORDS - seed
    return bool((long & (slack[:, None] + slack_2[None, :] >= -seed)).any())


def _stretches(doc: np.ndarray, own: np.ndarray, doc_weights: np.ndarray, own_weights: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, most slack) of the stretches that start at both beginnings and end on a match.

    Smith-Waterman with the weights of the leak rule: a match is worth its own weight, a
    word replaced or missing costs WORDS_PER_EDIT - 1 times it, an added one WORDS_PER_EDIT.
    Only the band of cells is kept from which a leak can still come, if all that is left of
    the item matches and ``spare`` comes from the other side; no leak is lost by it.
    """
    n, m = len(own), len(doc)
    run = 0
    while run < min(n, m) and doc[run] == own[run]:
        run += 1
    size = np.concatenate([[0], np.cumsum(own_weights)])
    if run >= min(n, m):
        return size[: run + 1], size[: run + 1]
    none = -(1 << 30)
    most = np.full(n + 1, none, np.int64)
    most[: run + 1] = size[: run + 1]
    doc, m = doc[run:], m - run
    added = np.concatenate([[0], np.cumsum(doc_weights[run:] * int(WORDS_PER_EDIT))])
    row, low = size[run] - added, 0  # the band begins at column ``low``
    for i in range(run, n):
        hope = int(size[n] - size[i]) + spare
        open_ = np.flatnonzero(row + hope >= 0)
        if not len(open_):
            break
        row, low = row[open_[0] : open_[-1] + 1], low + int(open_[0])
        # One column further by a match, and as many as added words can be borne behind it.
        high = min(low + len(row) + 1 + (int(row.max()) + hope) // int(WORDS_PER_EDIT), m)
        w = int(own_weights[i])
        lost = w * int(WORDS_PER_EDIT - 1)
        same = doc[low:high] == own[i]
        before = np.full(high - low, none, np.int64)
        before[: len(row)] = row[: high - low]
        new = np.full(high - low + 1, none, np.int64)
        new[: len(row)] = row - lost
        new[1:] = np.maximum(new[1:], before + np.where(same, w, -lost))
        if same.any():
            most[i + 1] = (before[same] + w).max()
        cost = added[low : high + 1]
        row = np.maximum.accumulate(new + cost) - cost
    return size, most


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """Distinct (document, item) pairs where the document holds a passage of the item.

    Items are a query set: they are sent to the tasks in blocks of at most about
    ``block_chars`` characters, one pass over the documents per block, so what is
    broadcast never grows with the items.  Documents are read whole, without a shuffle.
    Rows without an id, and null or empty texts, have no result.
    """
    spark = docs.sparkSession
    rows = items.select(item_col, F.col(item_text).cast("string").alias("_t")).where(F.col(item_col).isNotNull() & F.col("_t").isNotNull()).distinct()
    size = rows.agg(F.sum(F.length("_t"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    schema = f"`{id_col}` {kinds[0]}, `{item_col}` {kinds[1]}"
    texts = docs.select(id_col, F.col(text_col).cast("string")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    texts, found = spread(texts, id_col), None
    for k in range(blocks):
        own = rows.where(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == k) if blocks > 1 else rows
        sent = spark.sparkContext.broadcast([tuple(r) for r in own.toLocalIterator()])
        part = texts.mapInArrow(_finder(sent, id_col, item_col, to_arrow_type(items.schema[item_col].dataType)), schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _finder(sent, id_col: str, item_col: str, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Items(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                hits = own.find(part.column(1).to_pylist())
                ids = part.column(0).take(pa.array([d for d, _ in hits], pa.int64()))
                names = pa.array([i for _, i in hits], item_type)
                yield pa.RecordBatch.from_arrays([ids, names], names=[id_col, item_col])

    return run

"""Encoding of a corpus with a public byte-level BPE vocabulary (problem 6).

Texts are encoded by merge replay.  The distinct pieces of many texts are laid out as one
linked sequence of bytes with an inverted index from token pair to positions.  Merges are
applied in rank order, each to all positions of its pair at once, and only the neighbours
it touches are indexed anew.  Merges never cross a piece, so it does not matter for the
ids which pieces share a replay.

``encode_documents`` replays the pieces of an Arrow batch that its worker does not know
yet: no text is shuffled.  ``corpus_words`` gathers the distinct pieces of the whole corpus
and replays them by hash partition, once each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.runtime import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The characters with the property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# Fixed value: the published piece pattern of the vocabulary, with \s spelled out.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^@\p{L}\p{N}]+|[@]+(?![^@])|[@]+".replace("@", WHITE_SPACE)

#: A run of other characters with one white space before it.  No piece crosses its ends.
CHUNKS = f"[{WHITE_SPACE}]?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]"


def replay(pieces: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each piece, by replaying merges over all pieces at once.

    ``ranks`` maps the bytes of a token to its id; ids of merged tokens are their ranks.
    A piece without bytes has no ids.
    """
    token: list[int] = []
    after: list[int] = []
    before: list[int] = []
    starts: list[int] = []
    single = [ranks[bytes([b])] for b in range(256)]
    for piece in pieces:
        at = len(token)
        starts.append(at if piece else -1)
        token += [single[b] for b in piece]
        after += range(at + 1, at + len(piece) + 1)
        before += range(at - 1, at + len(piece) - 1)
        if piece:
            after[-1] = before[at] = -1
    text = {i: b for b, i in ranks.items()}
    index: dict[tuple[int, int], list[int]] = {}
    waiting: list[tuple[int, tuple[int, int]]] = []
    rank_of: dict[tuple[int, int], int | None] = {}

    def note(pair: tuple[int, int], at: int) -> None:
        if pair not in rank_of:
            rank_of[pair] = ranks.get(text[pair[0]] + text[pair[1]])
        rank = rank_of[pair]
        if rank is None:
            return
        places = index.get(pair)
        if places is None:
            index[pair] = [at]
            heapq.heappush(waiting, (rank, pair))
        else:
            places.append(at)

    for at, right in enumerate(after):
        if right >= 0:
            note((token[at], token[right]), at)
    while waiting:
        rank, pair = heapq.heappop(waiting)
        for at in sorted(index.pop(pair)):
            right = after[at]
            if token[at] != pair[0] or right < 0 or token[right] != pair[1]:
                continue  # an earlier merge has taken one of the two
            token[at], token[right] = rank, -1
            beyond = after[at] = after[right]
            if beyond >= 0:
                before[beyond] = at
                note((rank, token[beyond]), at)
            if before[at] >= 0:
                note((token[before[at]], rank), before[at])
    found = []
    for at in starts:
        ids = []
        while at >= 0:
            ids.append(token[at])
            at = after[at]
        found.append(ids)
    return found


def parsed(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in content.splitlines() if x.strip())}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a file of this machine."""
    with open(path, "rb") as f:
        return parsed(f.read())


class Encoder:
    """Encodes batches of texts; remembers short chunks it has seen (bounded)."""

    MOST_KNOWN, LONGEST_KNOWN = 400_000, 40

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.chunks, self.pieces = re.compile(CHUNKS).findall, regex.compile(PIECES).findall
        self.known: dict[str, list[int]] = {}

    def _learn(self, chunks: Iterable[str]) -> dict[str, list[int]]:
        parts = {c: self.pieces(c) for c in chunks}
        distinct = sorted({p for ps in parts.values() for p in ps})
        # A lone surrogate has no bytes of its own; it is encoded as the replacement character.
        ids = dict(zip(distinct, replay([p.encode("utf-8", "replace") for p in distinct], self.ranks)))
        return {c: [i for p in ps for i in ids[p]] for c, ps in parts.items()}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.chunks(t) if t else [] for t in texts]
        new = self._learn({c for s in split for c in s}.difference(self.known))
        known = self.known
        if len(known) > self.MOST_KNOWN:
            known.clear()
            new |= self._learn({c for s in split for c in s}.difference(new))
        known.update((c, i) for c, i in new.items() if len(c) <= self.LONGEST_KNOWN)
        long = {c: i for c, i in new.items() if len(c) > self.LONGEST_KNOWN}
        out = []
        for s in split:
            ids: list[int] = []
            for c in s:
                ids += known[c] if len(c) <= self.LONGEST_KNOWN else long[c]
            out.append(ids)
        return out


class Vocabulary:
    """A vocabulary file, read once by the driver and sent to the workers (about 1 MB)."""

    _encoders: dict[str, Encoder] = {}  # of this worker

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as f:
            content = f.read()
        self.mark, self.sent = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

    def encoder(self) -> Encoder:
        known = Vocabulary._encoders
        if self.mark not in known:
            known[self.mark] = Encoder(parsed(self.sent.value))
        return known[self.mark]


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, batch_chars: int = 8_000_000, keys: list[str] | None = None) -> DataFrame:
    """(id, keys, ids array<int>) of every row, without special tokens.

    Strings that look like special tokens are ordinary text.  Null and empty texts give
    an empty list.  Repeated rows are encoded each; other columns are ignored.  Texts
    are encoded whole: ``batch_chars`` bounds how many texts share one replay, not the
    length of a text.
    """

    keys = keys or []
    words = Vocabulary(docs.sparkSession, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words.encoder()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < batch_chars):
                    size += len(texts[stop] or "")
                    stop += 1
                ids = own.encode(texts[start:stop])
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = pa.array(np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1])))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                kept = [batch.column(k).slice(start, stop - start) for k in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=[id_col, *keys, "ids"])
                start = stop

    rows = docs.select(id_col, *keys, F.col(text_col).cast("string").alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return spread(rows, id_col).mapInArrow(run, f"{schema}, ids array<int>")


def corpus_words(docs: DataFrame, text_col: str = "text", vocabulary_path: str = DEFAULT_VOCABULARY, most_held: int = 500_000, batch_chars: int = 8_000_000) -> DataFrame:
    """(piece, n, ids): the distinct pieces of the whole corpus, how often each occurs, and its ids.

    Tasks count pieces before the shuffle (at most ``most_held`` different ones are held,
    then they are passed on); pieces are partitioned by hash, and each partition is
    replayed at once, in runs of at most about ``batch_chars`` characters.  Null and empty texts have no pieces.
    """
    words = Vocabulary(docs.sparkSession, vocabulary_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, held = regex.compile(PIECES).findall, Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([p.encode("utf-8", "replace") for p in held], pa.binary()), pa.array(held.values(), pa.int64())], names=["piece", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(pieces(text))
                if len(held) > most_held:
                    yield flush()
                    held.clear()
        yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = words.encoder().ranks
        for batch in _grouped(batches, batch_chars):
            ids = replay(batch.column(0).to_pylist(), ranks)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=["piece", "n", "ids"])

    texts = docs.select(F.col(text_col).cast("string").alias("_t")).where(F.col("_t") != "")
    counted = spread(texts, "_t").mapInArrow(count, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(merge, "piece binary, n bigint, ids array<int>").withColumn("piece", F.decode("piece", "UTF-8"))


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)

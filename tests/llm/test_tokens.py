"""Token ids against published encoders, and awkward inputs."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumry.llm import tokens

PATH = tokens.DEFAULT_VOCABULARY
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


def brute(piece: bytes, ranks):
    """The textbook way: again and again the leftmost pair of least rank."""
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30).map(lambda t: t.encode("utf-8", "replace")), st.binary(max_size=12), st.sampled_from([b"aaaaaaaaa", b" the the", b"banana"])), max_size=8))
def test_replay_equals_brute_force(pieces):
    ranks = tokens.vocabulary(PATH)
    assert tokens.replay(pieces, ranks) == [brute(p, ranks) for p in pieces]


def test_equals_published_encoder(data):
    import public_tokenizers
    import pyarrow.parquet as pq
    import tiktoken

    ranks = tokens.vocabulary(PATH)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += ["a\x1cb \x1c\x1dx", "\x85\x85a  b​　 c", "<|endoftext|>", "don't I'LL we've", "﻿x", "  \n\n  x \t\ty", "\U0001f469‍\U0001f4bb", "x" * 5000, "١٢ ½", " " * 3000]
    assert tokens.Encoder(tokens.vocabulary(PATH)).encode(texts) == [own.encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    ranks = tokens.vocabulary(PATH)
    back = {i: b for b, i in ranks.items()}
    ids = tokens.Encoder(tokens.vocabulary(PATH)).encode([text])[0]
    assert b"".join(back[i] for i in ids) == text.encode("utf-8", "replace")


def test_forgetting_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "MOST_KNOWN", 5)
    rng = random.Random(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x" * 60]) + str(rng.randrange(9)) for _ in range(20)) for _ in range(20)]
    own, fresh = tokens.Encoder(tokens.vocabulary(PATH)), [tokens.Encoder(tokens.vocabulary(PATH)).encode([t])[0] for t in texts]
    assert [own.encode([t])[0] for t in texts] == fresh


def test_operator_on_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "a", 0), (4, "word " * 40_000, 0)], "doc_id bigint, text string, ids int")
    got = tokens.encode_documents(df, batch_chars=10).collect()
    assert sorted(((r["doc_id"] or 0), len(r["ids"])) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 2), (3, 2), (4, 40_001)]
    assert tokens.encode_documents(df.limit(0)).count() == 0


def test_words_of_the_corpus_add_up(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "\ud83d\ude00 a" * 5_000)], "doc_id bigint, text string"))
    words = tokens.corpus_words(docs, most_held=200, batch_chars=2_000)
    ids = tokens.encode_documents(docs)
    assert words.count() == words.select("piece").distinct().count()
    of_words = {r["id"]: r["n"] for r in words.selectExpr("explode(ids) AS id", "n").groupBy("id").sum("n").toDF("id", "n").collect()}
    of_texts = {r["id"]: r["count"] for r in ids.selectExpr("explode(ids) AS id").groupBy("id").count().collect()}
    assert of_words == of_texts
    assert tokens.corpus_words(docs.limit(0)).count() == 0

"""Packing: exactness of parts, capacity, quality and awkward inputs."""

import math
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from vellumry.llm import packing

MODES = [("m", 10, True), ("n", 0, True), ("w", 40, False)]
SCHEMA = "region_id bigint, batch_id bigint, mode string, source string, first_width int, final_width int, line string"


def first_fit(lengths, capacity):
    bins, out = [], []
    for n in lengths:
        k = next((i for i, b in enumerate(bins) if b >= n), len(bins))
        if k == len(bins):
            bins.append(capacity)
        bins[k] -= n
        out.append(k)
    return out


@given(st.lists(st.integers(0, 10), max_size=60))
def test_tournament_is_first_fit(lengths):
    tree = packing.Tournament(10)
    assert [tree.first_fit(n) for n in lengths] == first_fit(lengths, 10)


@given(st.lists(st.integers(0, 35), max_size=60))
def test_pack(lengths):
    lengths = sorted(lengths, reverse=True)
    parts = packing.pack(lengths, 10)
    used = {}
    for n, p in zip(lengths, parts):
        assert sum(x for _, x in p) == n and (len(p) == 1 if n <= 10 else len(p) == math.ceil(n / 10))
        for b, x in p:
            used[b] = used.get(b, 0) + x
    assert all(x <= 10 for x in used.values()) and sorted(used) == list(range(len(used)))
    least = math.ceil(sum(lengths) / 10)
    assert len(used) <= 11 / 9 * least + 1 or len(used) <= sum(1 for n in lengths if n % 10 > 5 or n % 10 == 0) + least


def frames(spark, rows):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(MODES, "mode string, width int, semantic boolean")


@pytest.mark.parametrize("group_rows", [50_000, 40])
def test_operator(spark, group_rows):
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(["m", "w"]), "ab\nabcdef", rng.choice([None, 3, 9, 27]), rng.choice([None, 1, 12]), "clash") for i in range(400)]
    lines = packing.pack_regions(*frames(spark, rows + rows[:50]), group_rows=group_rows).collect()
    width = {"m": 10, "w": 40}
    filled, parts = {}, {}
    for r in lines:
        filled[r["batch_id"], r["mode"], r["grp"], r["line"]] = filled.get((r["batch_id"], r["mode"], r["grp"], r["line"]), 0) + r["length"]
        parts[r["region_id"]] = parts.get(r["region_id"], 0) + r["length"]
    assert all(n <= width[k[1]] for k, n in filled.items())
    assert parts == {i: max(2 if f is None else f, 6 if x is None else x) for i, _, _, _, f, x, _ in rows}
    assert (max(r["grp"] for r in lines) > 0) == (group_rows == 40)


def test_divided_and_awkward_rows(spark):
    rows = [(1, 1, "m", None, None, None, ""), (2, 1, "m", "x" * 11, None, None, ""), (3, 1, "n", "y" * 99, 99, 99, ""), (4, 1, "?", "z", 99, 1, ""), (5, None, "m", "a\r\nbc\n", None, None, ""),
            (None, 1, "m", "a", 50, 50, ""), (6, 1, "m", "", 10, -3, ""), (7, 2, "w", "q" * 100_000, None, 1, "")]
    lines = packing.pack_regions(*frames(spark, rows))
    assert sorted(r["region_id"] for r in packing.divided(lines).collect()) == [2, 7]
    assert {r["region_id"]: r["length"] for r in lines.where("part = 0 and region_id in (1, 5, 6)").collect()} == {1: 0, 5: 1, 6: 10}
    assert lines.where("region_id = 7").count() == 2500
    assert packing.pack_regions(*frames(spark, rows[:0])).count() == 0
    assert {r["mode"] for r in packing.packing_quality(lines).collect()} == {"m", "w"}

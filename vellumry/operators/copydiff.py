"""Differences between two copies of a table (problem 1).

Rows are reduced to a digest per compared field before anything is shuffled, so
long texts never travel.  Identical rows of a key cancel by multiplicity; what is
left over within a key is paired so that the pairs differ in as few fields as
possible (minimum-cost assignment), and the pairs are reported field by field.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumry.runtime import checkpointed

ONLY_LEFT, ONLY_RIGHT = "only_left", "only_right"


def digest(column: Column) -> Column:
    """A 32-byte digest of a string's exact bytes; null stays null."""
    return F.unhex(F.sha2(column.cast("string").cast("binary"), 256))


def latest(df: DataFrame, key: str, version: list[str], fields: list[str]) -> DataFrame:
    """The newest row of each key as (key, digests of the fields).

    Rows are ordered by the ``version`` columns, then by the digests, so that equal
    versions have a defined winner.  The aggregation is partial before the shuffle.
    """
    newest = F.max(F.struct(*[F.col(v) for v in version], *[digest(F.col(f)).alias(f"_d{i}") for i, f in enumerate(fields)]))
    return df.groupBy(key).agg(newest.alias("_m")).select(key, *[f"_m._d{i}" for i in range(len(fields))])


def digested(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    return df.select(*keys, *[digest(F.col(f)).alias(f"_d{i}") for i, f in enumerate(fields)])


class LeastPairs:
    """Minimum-cost assignment of rows to rows, where a pair costs its differing fields.

    Rows are distinct, given as a whole number per field, and have multiplicities.  A pair
    gains one for each equal field, and the greatest gain is found by potentials: ``u`` of a
    row on the left and ``v`` of one on the right always add up to their gain at least, rows
    are matched only where they add up to it exactly, and rows left over have the least
    potential.  Gains are small whole numbers, so there are as many rounds as fields; in each
    round augmenting paths are taken in layers until there is none.  Pairs are never listed:
    rows that share the values of a set of fields meet in a bucket, from which a row goes
    once.  Layers are found with whole arrays; only the paths themselves are walked.
    """

    def __init__(self, left: np.ndarray, supply: np.ndarray, right: np.ndarray, demand: np.ndarray) -> None:
        n = left.shape[1]
        self.left, self.free = supply.astype(np.int64), demand.astype(np.int64)
        self.u, self.v = np.full(len(left), n, np.int32), np.zeros(len(right), np.int32)
        #: Matched row on the right -> row on the left -> how many copies.
        self.flow: dict[int, dict[int, int]] = {}
        self._buckets(left, right)
        for _ in range(n):
            if not self.left.any():
                break
            self._tight(n)
            while self._layers():
                self._augment()
            self.u -= self.level >= 0
            self.v += self.level_right >= 0

    def _buckets(self, left: np.ndarray, right: np.ndarray) -> None:
        """Per row on the left its bucket of each set of fields, -1 where no row on the right is in it."""
        n, first = left.shape[1], 0
        rows = np.concatenate([left, right])
        of_set, gains, buckets, members = {(): np.zeros(len(rows), np.int64)}, [], [np.zeros((len(left), 0), np.int32)], [np.zeros((2, 0), np.int32)]
        for c in (c for size in range(1, n + 1) for c in combinations(range(n), size)):
            code = of_set[c[:-1]] * (int(rows[:, c[-1]].max()) + 1) + rows[:, c[-1]]
            code = of_set[c] = np.unique(code, return_inverse=True)[1]
            mine, theirs = np.zeros((2, len(rows)), bool)
            mine[code[: len(left)]] = theirs[code[len(left) :]] = True
            both = mine & theirs
            number = np.where(both, np.cumsum(both) - 1 + first, -1).astype(np.int32)[code]
            first += int(both.sum())
            gains.append(len(c))
            buckets.append(number[: len(left), None])
            number = number[len(left) :]
            members.append(np.stack([number, np.arange(len(right), dtype=np.int32)])[:, number >= 0])
        self.gains = np.array(gains, np.int32)
        self.of_left = np.concatenate(buckets, 1)
        self.bucket, self.member = np.concatenate(members, 1)

    def _tight(self, n: int) -> None:
        """Groups of a bucket's rows with one potential, and per row on the left those it is tight with."""
        key = self.bucket.astype(np.int64) * (n + 1) + self.v[self.member]
        order = np.argsort(key, kind="stable")
        self.rows = self.member[order]
        keys, start = np.unique(key[order], return_index=True)
        self.start, self.end = start, np.append(start[1:], len(order))
        need = self.gains - self.u[:, None]
        wanted = self.of_left.astype(np.int64) * (n + 1) + need
        at = np.searchsorted(keys, wanted)
        hit = (self.of_left >= 0) & (need >= 0) & (at < len(keys))
        hit[hit] = keys[at[hit]] == wanted[hit]
        self.groups = np.where(hit, at, -1).astype(np.int32)

    def _layers(self) -> bool:
        """Distances from the rows left over, along tight pairs; whether a free row is reached.

        Rows from which no free row is reached are then taken out, from the last layer back.
        """
        self.level, self.level_right = np.full(len(self.left), -1, np.int32), np.full(len(self.free), -1, np.int32)
        self.opened = np.full(len(self.start), -1, np.int32)
        matched = np.fromiter(self.flow, np.int64, len(self.flow))
        sizes = np.zeros(len(self.free) + 1, np.int64)
        sizes[matched + 1] = np.fromiter(map(len, self.flow.values()), np.int64, len(self.flow))
        first = np.cumsum(sizes)
        back = np.zeros(first[-1], np.int32)
        back[_ranges(first[matched], first[matched + 1])] = np.fromiter((i for f in self.flow.values() for i in f), np.int32, len(back))
        layer = np.flatnonzero(self.left)
        self.level[layer] = 0
        depth, found, layers = 0, False, []
        while len(layer) and not found:
            groups = np.unique(self.groups[layer])
            groups = groups[groups >= 0]
            groups = groups[self.opened[groups] < 0]
            self.opened[groups] = depth
            reached = self.rows[_ranges(self.start[groups], self.end[groups])]
            reached = np.unique(reached[self.level_right[reached] < 0])
            self.level_right[reached] = depth + 1
            found = bool(self.free[reached].any())
            layers.append((layer, groups, reached))
            layer = back[_ranges(first[reached], first[reached + 1])]
            layer = np.unique(layer[self.level[layer] < 0])
            self.level[layer] = depth + 2
            depth += 2
        if found:
            open_right, open_group = self.free > 0, np.zeros(len(self.opened) + 1, bool)
            for depth, (layer, groups, reached) in reversed([*enumerate(layers)]):
                if depth + 1 < len(layers):
                    ways = back[_ranges(first[reached], first[reached + 1])]
                    open_right[reached] = _any(self.level[ways] == 2 * depth + 2, first[reached + 1] - first[reached])
                self.level_right[reached[~open_right[reached]]] = -2
                members = self.rows[_ranges(self.start[groups], self.end[groups])]
                open_group[groups] = _any(self.level_right[members] == 2 * depth + 1, self.end[groups] - self.start[groups])
                self.level[layer[~open_group[self.groups[layer]].any(1)]] = -2
                open_group[groups] = False
        return found

    def _augment(self) -> None:
        """Augmenting paths of the layers, until they block each other."""
        level, level_right, opened, left, free, rows, start = map(memoryview, (self.level, self.level_right, self.opened, self.left, self.free, self.rows, self.start))
        groups, upto, sets = memoryview(self.groups.ravel()), memoryview(self.end.copy()), len(self.gains)
        later = memoryview(np.arange(len(level)) * sets)
        flow, back = self.flow, {}

        def ahead(i: int) -> int:
            """A row on the right in the layer behind row ``i``, or -1; what is used up is never seen again."""
            at, end, depth = later[i], (i + 1) * sets, level[i]
            while at < end:
                g = groups[at]
                if g >= 0 and opened[g] == depth:
                    k, low = upto[g], start[g]
                    while k > low and level_right[rows[k - 1]] != depth + 1:
                        k -= 1
                    upto[g] = k
                    if k > low:
                        later[i] = at
                        return rows[k - 1]
                at += 1
            later[i] = at
            return -1

        def path(root: int) -> bool:
            on, through = [root], []
            while True:
                i = on[-1]
                j = ahead(i)
                if j < 0:  # nothing ahead of this row any more
                    level[i] = -2
                    on.pop()
                    if not on:
                        return False
                    back[through.pop()].pop()
                    continue
                if free[j]:
                    through.append(j)
                    break
                own = flow[j]
                ways = back.get(j)
                if ways is None:
                    ways = back[j] = list(own)
                while ways and (level[ways[-1]] != level_right[j] + 1 or ways[-1] not in own):
                    ways.pop()
                if not ways:
                    level_right[j] = -2
                    continue
                through.append(j)
                on.append(ways[-1])
            most = min(left[root], free[through[-1]], *(flow[j][i] for j, i in zip(through, on[1:])))
            left[root] -= most
            free[through[-1]] -= most
            for k, (i, j) in enumerate(zip(on, through)):
                own = flow.setdefault(j, {})
                own[i] = own.get(i, 0) + most
                if k + 1 < len(on):
                    own[on[k + 1]] -= most
                    if not own[on[k + 1]]:
                        del own[on[k + 1]]
            return True

        for root in np.flatnonzero((self.left > 0) & (self.level == 0)).tolist():
            while left[root] and path(root):
                pass

    def differing(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Per field how many matched copies differ."""
        pairs = np.array([(i, j, n) for j, row in self.flow.items() for i, n in row.items()], np.int64).reshape(-1, 3)
        return ((left[pairs[:, 0]] != right[pairs[:, 1]]) * pairs[:, 2:]).sum(0)


def _any(good: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per run of ``sizes`` rows whether any of them is good."""
    count = np.append(0, np.cumsum(good))
    end = np.cumsum(sizes)
    return count[end] > count[end - sizes]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    sizes = end - start
    return np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _parts(values: list[np.ndarray]) -> np.ndarray:
    """Per row the number of its part: rows that share a value, directly or over others (as ``components``)."""
    size = len(values[0])
    label = np.arange(size)
    while True:
        near = label.copy()
        for value in values:
            low = np.full(size, size)
            np.minimum.at(low, value, label)
            near = np.minimum(near, low[value])
        up = np.arange(size)
        np.minimum.at(up, label, near)
        if (up[label] == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = up[up][label]


def _least(codes: np.ndarray, copies: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differing pairs per field over all groups, and per group the rows left over on either side.

    ``copies`` count below zero on the right.  A field that is equal in all rows of a group
    never differs and connects nothing.  Parts of a group that share no value are groups of
    their own, and what they leave over is paired freely: any such pair differs in all
    fields that vary.  Groups of one part are matched together where the same fields vary;
    paths stay within a group, so it counts the same alone or among others.
    """
    n, size = codes.shape[1], len(codes)
    wrong, groups = np.zeros(n, np.int64), int(group.max()) + 1
    ends = np.zeros((groups, 2), np.int64)
    np.add.at(ends, (group, np.where(copies > 0, 0, 1)), np.abs(copies))
    first = np.unique(group, return_index=True)[1]
    vary = np.zeros((groups, n), bool)
    np.logical_or.at(vary, group, codes != codes[first[group]])
    vary &= ends.min(1, keepdims=True) > 0
    values = []
    for f in range(n):
        value = np.unique(codes[:, f], return_inverse=True)[1] + group * size
        value = np.unique(np.where(vary[group, f], value, groups * size + np.arange(size)), return_inverse=True)[1]
        values.append(value)
    part = _parts(values)
    parts = np.bincount(group[np.unique(part, return_index=True)[1]])
    several = (parts > 1) & (ends.min(1) > 0)
    rows = np.flatnonzero(several[group])
    if len(rows):
        inner = np.unique(part[rows], return_inverse=True)[1]
        found, over = _least(codes[rows], copies[rows], inner)
        wrong += found
        ends[several] = 0
        np.add.at(ends, group[rows][np.unique(inner, return_index=True)[1]], over)
    kind = vary @ (1 << np.arange(n)) * 2 + (ends[:, 0] > ends[:, 1])
    kind[several | ~vary.any(1)] = -1
    for k in np.unique(kind[kind >= 0]):
        rows, fields = kind[group] == k, np.flatnonzero(vary[np.argmax(kind == k)])
        few = np.where(copies > 0, 0, 1) == k % 2
        a, b = np.flatnonzero(rows & few), np.flatnonzero(rows & ~few)
        of = np.stack([values[f] for f in fields], 1)
        own = LeastPairs(of[a], np.abs(copies[a]), of[b], np.abs(copies[b]))
        wrong += own.differing(codes[a], codes[b])
        ends[kind == k] = 0
        np.add.at(ends, (group[a], k % 2), own.left)
        np.add.at(ends, (group[b], 1 - k % 2), own.free)
    pairs = ends.min(1, keepdims=True)
    return wrong + (pairs * vary).sum(0), ends - pairs


def least_differences(left: list[tuple], supply: list[int], right: list[tuple], demand: list[int]) -> tuple[list[int], int, int]:
    """(pairs that differ per field, rows left over on the left, on the right) at least cost.

    What the matching leaves over on both sides shares no value, so any pairing of it
    differs in all fields; only the longer side keeps rows over.
    """
    seen: list[dict] = [{} for _ in (left or right)[0]]
    codes = np.array([[of.setdefault(x, len(of)) for of, x in zip(seen, row)] for row in (*left, *right)], np.int64)
    wrong, over = _least(codes, np.array([*supply, *(-n for n in demand)], np.int64), np.zeros(len(codes), np.int64))
    return wrong.tolist(), *over[0].tolist()


def _pair_rows(keys: list[str], fields: list[str]):
    """Least-cost pairs of one group from distinct rows and their multiplicities."""

    def run(table: pa.Table) -> pa.Table:
        # Ranks of the digests are equal where they are; null is a value of its own.
        ranks = [pc.rank(table.column(f"_d{i}"), null_placement="at_start", tiebreaker="dense") for i in range(len(fields))]
        codes, copies = np.stack([r.to_numpy().astype(np.int64) for r in ranks], 1), table.column("_n").to_numpy()
        order = np.lexsort(codes.T[::-1])  # whatever way the rows came
        wrong, over = _least(codes[order], copies[order], np.zeros(len(order), np.int64))
        out = [(f, n) for f, n in zip([*fields, ONLY_LEFT, ONLY_RIGHT], [*wrong.tolist(), *over[0].tolist()]) if n]
        named = table.select(keys).take(pa.array([0] * len(out), pa.int64()))
        return named.append_column("diff", pa.array([f for f, _ in out], pa.string())).append_column("n", pa.array([n for _, n in out], pa.int64()))

    return run


def components(rows: DataFrame, keys: list[str], d: list[str]) -> DataFrame:
    """``rows`` with ``_part``: rows of a key that share a value, directly or over others.

    A field that has one value in all rows of a key connects nothing: it is equal in
    every pair.  Labels spread over shared values and jump to the label of their label,
    until none changes.  Everything hashes; a collision joins two parts, no more.
    """
    whole = lambda x: F.struct(F.col(x).isNull().alias("null"), F.col(x))
    varies = rows.groupBy(*keys).agg(F.array(*[F.min(whole(x)) != F.max(whole(x)) for x in d]).alias("_varies"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    rows = checkpointed(rows.alias("x").join(varies.alias("y"), same).select("x.*", "y._varies").withColumn("_id", F.xxhash64(*keys, *d)))
    values = F.array(*[F.when(F.col("_varies")[i], F.xxhash64(*keys, F.lit(i), F.col(x))) for i, x in enumerate(d)])
    edges = checkpointed(rows.select("_id", F.explode(F.filter(values, lambda v: v.isNotNull())).alias("_value")).distinct())
    labels = checkpointed(rows.select("_id", F.col("_id").alias("_part")).distinct())
    while True:
        lowest = edges.join(labels, "_id").groupBy("_value").agg(F.min("_part").alias("_low"))
        near = edges.join(lowest, "_value").groupBy("_id").agg(F.min("_low").alias("_low"))
        up = checkpointed(labels.join(near, "_id").groupBy("_part").agg(F.min("_low").alias("_up")))
        if up.where("_up <> _part").isEmpty():
            return rows.join(labels, "_id").drop("_id")
        further = up.select(F.col("_part").alias("_up"), F.col("_up").alias("_up2"))
        up = up.join(further, "_up", "left").select("_part", F.coalesce("_up2", "_up").alias("_up"))
        labels = checkpointed(labels.join(up, "_part", "left").select("_id", F.coalesce("_up", "_part").alias("_part")))


def _pair_hot(rest: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Pairs within keys of any size, part by part.

    Rows of different parts share no value that varies, so any pairing of them costs the
    same: parts are solved on their own, and what is left of them is paired freely, as
    ``_least`` does within one task.  A part is one task's work, whatever its size.
    """
    d = [f"_d{i}" for i in range(len(fields))]
    rows = checkpointed(components(rest, keys, d))
    by = [*keys, "_part"]
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in by]
    count = lambda sign: F.sum(F.greatest(F.col("_n") * sign, F.lit(0)))
    sizes = rows.groupBy(*by).agg(count(1).alias("_l"), count(-1).alias("_r"))
    two = (F.col("_l") > 0) & (F.col("_r") > 0)
    of = lambda parts: rows.alias("x").join(parts.select(*by).alias("y"), same, "left_semi")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema), "diff string", "n bigint"])
    single = sizes.where(~two).select(*by, F.when(F.col("_l") > 0, ONLY_LEFT).otherwise(ONLY_RIGHT).alias("diff"), (F.col("_l") + F.col("_r")).alias("n"))
    done = single.unionByName(of(sizes.where(two)).groupBy(*by).applyInArrow(_pair_rows(by, fields), schema))
    done = checkpointed(done.groupBy(*keys, "diff").agg(F.sum("n").alias("n")))
    of_side = lambda name: F.sum(F.when(F.col("diff") == name, F.col("n")).otherwise(0))
    ends = done.groupBy(*keys).agg(of_side(ONLY_LEFT).alias("_l"), of_side(ONLY_RIGHT).alias("_r"))
    varies = rows.select(*keys, "_varies").distinct()
    ends = ends.alias("x").join(varies.alias("y"), same[:-1]).select("x.*", "y._varies")
    pairs = F.least("_l", "_r")
    kinds = F.array(
        F.struct(F.lit(ONLY_LEFT).alias("diff"), (F.col("_l") - pairs).alias("n")), F.struct(F.lit(ONLY_RIGHT).alias("diff"), (F.col("_r") - pairs).alias("n")),
        *[F.struct(F.lit(f).alias("diff"), F.when(F.col("_varies")[i], pairs).otherwise(0).alias("n")) for i, f in enumerate(fields)],
    )
    found = done.where(~F.col("diff").isin(ONLY_LEFT, ONLY_RIGHT)).unionByName(ends.select(*keys, F.inline(kinds)).where("n > 0"))
    return found.groupBy(*keys, "diff").agg(F.sum("n").alias("n"))


def copy_differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], exact_rows: int = 20_000, large: bool = True, most: int = 100_000) -> DataFrame:
    """Differences of two multisets of rows as (keys, diff, n).

    ``diff`` is ``only_left``, ``only_right`` or the name of a field; ``n`` says how
    many rows of the key (or pairs of rows, for a field) it concerns.

    * Null equals null; null and the empty string differ.  A null key is a key.
    * Rows equal in all fields cancel, copy by copy.
    * Leftovers of a key are paired by minimum-cost assignment, in parts that share no
      value.  Parts of a key with at most ``exact_rows`` distinct rows are found and solved
      in one task; of a key with more of them they are found over the cluster and solved in
      a task each.  The result is the same, row by row, whatever ``exact_rows`` is.
    * ``most`` no longer does anything: it was the size from which parts were paired at
      some excess over the minimum.
    * Empty tables give the other side's rows; extra columns are ignored.
    """
    d = [f"_d{i}" for i in range(len(fields))]
    both = digested(left, keys, fields).withColumn("_n", F.lit(1)).unionByName(digested(right, keys, fields).withColumn("_n", F.lit(-1)))
    return _differences(both, keys, fields, d, exact_rows, large)


def latest_differences(left: DataFrame, right: DataFrame, key: str, version: list[str], fields: list[str]) -> DataFrame:
    """``copy_differences`` of the newest row of each key (a key has one row a side).

    A null version is the oldest; equal versions are settled by the fields' digests, so
    repeated rows and ties give one defined row.
    """
    d = [f"_d{i}" for i in range(len(fields))]
    both = latest(left, key, version, fields).withColumn("_n", F.lit(1)).unionByName(latest(right, key, version, fields).withColumn("_n", F.lit(-1)))
    return _differences(both, [key], fields, d, 20_000, False)


def _differences(both: DataFrame, keys: list[str], fields: list[str], d: list[str], exact_rows: int, large: bool) -> DataFrame:
    rest = both.groupBy(*keys, *d).agg(F.sum("_n").alias("_n")).where(F.col("_n") != 0)
    left, right = F.greatest(F.col("_n"), F.lit(0)), F.greatest(-F.col("_n"), F.lit(0))
    pick = lambda sign: F.max(F.when(F.col("_n") * sign > 0, F.struct(*d)))
    keyed = rest.groupBy(*keys).agg(F.sum(left).alias("_l"), F.sum(right).alias("_r"), F.count(F.lit(1)).alias("_rows"), pick(1).alias("_a"), pick(-1).alias("_b"))
    single = (F.col("_l") <= 1) & (F.col("_r") <= 1)
    kinds = F.when(F.col("_r") == 0, F.array(F.lit(ONLY_LEFT))).when(F.col("_l") == 0, F.array(F.lit(ONLY_RIGHT))).otherwise(
        F.filter(
            F.array(*[F.when(~F.col(f"_a.{x}").eqNullSafe(F.col(f"_b.{x}")), F.lit(f)) for x, f in zip(d, fields)]),
            lambda x: x.isNotNull(),
        )
    )
    simple = keyed.where(single).select(*keys, F.explode(kinds).alias("diff"), F.lit(1).cast("bigint").alias("n"))
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
    several = keyed.where(~single)
    small = several.where(F.col("_rows") <= exact_rows)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*keys).schema), "diff string", "n bigint"])
    exact = (
        rest.alias("x").join(small.select(*keys).alias("y"), same, "left_semi")
        .groupBy(*keys).applyInArrow(_pair_rows(keys, fields), schema)
    )
    found = simple.unionByName(exact)
    if large:
        hot = several.where(F.col("_rows") > exact_rows)
        rows = rest.alias("x").join(hot.select(*keys).alias("y"), same, "left_semi")
        if not rows.isEmpty():
            found = found.unionByName(_pair_hot(rows, keys, fields))
    return found

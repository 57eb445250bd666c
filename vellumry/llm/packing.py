"""Filling fixed-capacity containers with items (problem 5).

First-fit decreasing with a tournament tree over the free space of the bins, run
independently in randomised groups.  A batch is one group unless it is larger than
``group_rows``; then its items are spread over groups at random (by a hash of their
id), so no task ever holds an unbounded batch.  Each group costs at most the unfilled
part of its own last bins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Tournament:
    """Free space of bins; finds the first bin with room for a length in log time."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.leaves, self.n = capacity, 1, 0
        self.best = [-1, -1]

    def first_fit(self, length: int) -> int:
        if self.best[1] >= length:
            node = 1
            while node < self.leaves:
                node *= 2
                node += self.best[node] < length
            at = node - self.leaves
        else:
            at = self.n
            if at == self.leaves:
                self._grow()
            self.n += 1
            self.best[self.leaves + at] = self.capacity
        node = self.leaves + at
        self.best[node] -= length
        best = self.best
        if at == self.n - 1:  # a bin just opened may raise its ancestors
            while node > 1:
                node //= 2
                best[node] = max(best[2 * node], best[2 * node + 1])
        else:
            while node > 1:
                node //= 2
                top = max(best[2 * node], best[2 * node + 1])
                if top == best[node]:
                    break
                best[node] = top
        return at

    def _grow(self) -> None:
        old = self.best[self.leaves :]
        self.leaves *= 2
        self.best = [-1] * self.leaves + old + [-1] * (self.leaves - len(old))
        for node in range(self.leaves - 1, 0, -1):
            self.best[node] = max(self.best[2 * node], self.best[2 * node + 1])


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int]]]:
    """Per item its parts as (bin, length); ``lengths`` must be in falling order.

    An item longer than ``capacity`` fills bins of its own; its rest is packed like an
    item of that length.  Other items have one part.
    """
    tree, out = Tournament(capacity), []
    rests = []
    for k, length in enumerate(lengths):
        if length <= capacity:
            break
        full, rest = divmod(length, capacity)
        parts = []
        for _ in range(full):
            parts.append((tree.first_fit(capacity), capacity))
        out.append(parts)
        if rest:
            rests.append((rest, k))
    whole = [(length, k) for k, length in enumerate(lengths) if length <= capacity]
    out += [[] for _ in range(len(lengths) - len(out))]
    for length, k in sorted(whole + rests, key=lambda x: -x[0]):
        out[k].append((tree.first_fit(length), length))
    return out


def region_length() -> Column:
    """The greater width of a region; a null width is that of the source's first or last line."""
    lines = F.split("source", "\r\n|\r|\n", -1)
    first = F.coalesce("first_width", F.length(F.element_at(lines, 1)), F.lit(0))
    final = F.coalesce("final_width", F.length(F.element_at(lines, -1)), F.lit(0))
    return F.greatest(first, final, F.lit(0)).cast("bigint")


def pack_regions(regions: DataFrame, modes: DataFrame, group_rows: int = 50_000) -> DataFrame:
    """Lines for the regions of each batch, in the width of their mode.

    Result: batch_id, mode, grp, line, region_id, part, length, width.  ``line`` counts
    within (batch_id, mode, grp); ``part`` is 0 unless the region had to be divided.
    Copies of a row count once; rows without region_id, and modes that are unknown or
    have no width, have no lines.  A null batch is a batch; lengths below 0 count as 0.
    """
    widths = modes.where(F.col("width") > 0).groupBy("mode").agg(F.max("width").alias("width"))
    items = regions.select("batch_id", "mode", "region_id", region_length().alias("length")).where(F.col("region_id").isNotNull()).distinct()
    items = items.join(F.broadcast(widths) if _few(modes) else widths, "mode")
    sizes = items.groupBy("batch_id", "mode").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows)
    large = sizes.select(F.col("batch_id").alias("b"), F.col("mode").alias("m"), F.ceil(F.col("n") / group_rows).cast("int").alias("groups"))
    items = items.join(large, F.col("batch_id").eqNullSafe(F.col("b")) & (F.col("mode") == F.col("m")), "left")
    grp = F.when(F.col("groups").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("region_id"), F.col("groups"))).cast("int")
    items = items.select("batch_id", "mode", grp.alias("grp"), "width", "region_id", "length")
    keys = ["batch_id", "mode", "grp"]
    ordered = items.repartition(*keys).sortWithinPartitions(*keys, F.desc("length"), "region_id")
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    schema = f"batch_id {kinds['batch_id']}, mode string, grp int, line int, region_id {kinds['region_id']}, part int, length bigint, width int"
    return ordered.mapInArrow(_pack_partition, schema)


def _few(modes: DataFrame) -> bool:
    """Whether the mode table is small enough to broadcast (checked, at most 10,000 rows)."""
    return modes.limit(10_001).count() <= 10_000


def _pack_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["batch_id", "mode", "grp", "line", "region_id", "part", "length", "width"]
    key, ids, lengths, width, kinds = None, [], [], 0, {}

    def flush() -> pa.RecordBatch:
        rows = [(line, ids[k], p, n) for k, parts in enumerate(pack(lengths, width)) for p, (line, n) in enumerate(parts)]
        line, region, part, length = map(list, zip(*rows))
        n = len(rows)
        kind = [kinds["batch_id"], pa.string(), pa.int32(), pa.int32(), kinds["region_id"], pa.int32(), pa.int64(), pa.int32()]
        data = [[key[0]] * n, [key[1]] * n, [key[2]] * n, line, region, part, length, [width] * n]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, kind)], names=names)

    for batch in batches:
        kinds = {c: batch.schema.field(c).type for c in ("batch_id", "region_id")}
        for b, m, g, w, i, n in zip(*[batch.column(c).to_pylist() for c in ("batch_id", "mode", "grp", "width", "region_id", "length")]):
            if (b, m, g) != key:
                if ids:
                    yield flush()
                key, ids, lengths, width = (b, m, g), [], [], w
            ids.append(i)
            lengths.append(n)
    if ids:
        yield flush()


def divided(lines: DataFrame) -> DataFrame:
    """The regions that were longer than their capacity and had to be divided."""
    return lines.where(F.col("part") > 0).select("region_id").distinct()


def packing_quality(lines: DataFrame) -> DataFrame:
    """Per mode: lines used, the least possible number, and the share of space left."""
    batches = lines.groupBy("mode", "width", "batch_id").agg(
        F.countDistinct("grp", "line").alias("n"), F.sum("length").alias("used")
    )
    least = F.ceil(F.col("used") / F.col("width"))
    return batches.groupBy("mode", "width").agg(
        F.sum("n").alias("n_lines"), F.sum(least).cast("bigint").alias("least_lines"),
        F.round(1 - F.sum("used") / F.sum(F.col("n") * F.col("width")), 4).alias("unused"),
    )


def packing_check(lines: DataFrame) -> DataFrame:
    """Per mode: regions on lines, their length, lines beyond the capacity, regions that were
    divided though they fit or that lost a part."""
    of_line = lines.groupBy("mode", "width", "batch_id", "grp", "line").agg(F.sum("length").alias("used"))
    over = of_line.groupBy("mode").agg(F.count_if(F.col("used") > F.col("width")).alias("n_over"))
    regions = lines.groupBy("mode", "width", "region_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("length").alias("n"), F.max("part").alias("last"))
    torn = (F.col("parts") > 1) & (F.col("n") <= F.col("width")) | (F.col("last") != F.col("parts") - 1)
    whole = regions.groupBy("mode").agg(F.count(F.lit(1)).alias("n_regions"), F.sum("n").alias("length"), F.count_if(torn).alias("n_torn"))
    return whole.join(over, "mode").select("mode", "n_regions", "length", "n_over", "n_torn")

"""References to records that do not exist (problem 3).

Records and references are signed deltas on one key space: a record adds 1 to the
existence count of its key when it appears and takes 1 when it goes; a reference adds 1 to
the reference count of its key when it enters and takes 1 when it leaves.  A key is an
orphan while its reference count is positive and its existence count zero.

``orphans`` runs both counts over time and reports the references that enter while their
key is an orphan; ``signed_counts``, ``advance`` and ``current_orphans`` keep the same
counts as a state; ``orphan_history`` tells how many keys were orphans after each month.
Keys travel as 16-byte digests, in one shuffle.  Keys that hold more rows than a task
should get are cut into buckets of time (``runtime.running``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumry.runtime import found_hot, hot_buckets, micros, running, split_hot

#: Deltas of one instant in the order in which they take effect: records going and coming,
#: references entering, references leaving.
CHANGE, ENTER, LEAVE = range(3)


def key_of(*parts: Column) -> Column:
    """A 16-byte digest of the parts; null parts equal each other and nothing else."""
    exact = F.concat_ws("|", *[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
    return F.unhex(F.md5(exact.cast("binary")))


def existence(df: DataFrame, key: Column, since: Column, until: Column | None = None, *more: str) -> DataFrame:
    """Deltas (key, at, delta) of records that exist from ``since`` to before ``until``.

    A record without ``since``, or whose ``until`` is not after it, never exists.  ``more``
    names columns to keep.
    """
    rows = df.select(key.alias("key"), micros(since).alias("a"), (micros(until) if until is not None else F.lit(None).cast("bigint")).alias("b"), *more)
    rows = rows.where(F.col("key").isNotNull() & F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("b") > F.col("a"))))
    ends = F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("delta")))
    return rows.select("key", F.inline(ends), *more).where(F.col("at").isNotNull())


def _counted(events: DataFrame, keys: DataFrame) -> DataFrame:
    """``events`` with n_refs and n_existing, the signed counts of the key after each event.

    ``keys`` has a row per event or pair of events, for the sizes of keys.
    """
    hot = found_hot(hot_buckets(keys, ["key"]))
    ties = [F.col("step")]
    cold, warm = (events, None) if hot is None else split_hot(events, ["key"], hot)
    upto = Window.partitionBy("key").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = cold.withColumn("n_refs", F.sum("refs").over(upto)).withColumn("n_existing", F.sum("exist").over(upto))
    if warm is None:
        return out
    warm = running(warm.drop("salts"), ["key"], "at", F.col("refs"), "sum", "n_refs", ties=ties)
    return out.unionByName(running(warm, ["key"], "at", F.col("exist"), "sum", "n_existing", ties=ties))


def orphans(references: DataFrame, deltas: DataFrame) -> DataFrame:
    """The references (columns key, at and any others) whose key does not exist at ``at``.

    ``deltas`` come from ``existence``.  A reference is in force for its moment only: it
    enters at ``at``, after the records of that instant, and leaves again.  References
    without a key or a moment have no result; copies come out as often as given; empty
    tables are allowed.
    """
    own = [c for c in references.columns if c not in ("key", "at")]
    read = references.where(F.col("key").isNotNull() & F.col("at").isNotNull()).withColumn("ref", F.struct(*own))
    none = F.lit(None).cast(read.schema["ref"].dataType)
    event = lambda step, refs, exist, ref: F.struct(F.lit(step).alias("step"), F.lit(refs).alias("refs"), exist.cast("int").alias("exist"), ref.alias("ref"))
    entered = read.select("key", "at", F.inline(F.array(event(ENTER, 1, F.lit(0), F.col("ref")), event(LEAVE, -1, F.lit(0), none))))
    changed = deltas.select("key", "at", event(CHANGE, 0, F.col("delta"), none).alias("e")).select("key", "at", "e.*")
    keys = deltas.select("key").unionByName(read.select("key"))
    found = _counted(changed.unionByName(entered), keys).where((F.col("step") == ENTER) & (F.col("n_refs") > 0) & (F.col("n_existing") <= 0))
    return found.select("key", "at", "ref.*")


def signed_counts(references: DataFrame, deltas: DataFrame, *names: str) -> DataFrame:
    """The state (key, n_refs, n_existing, names) after all deltas: references count 1 each,
    existence its signed delta.  Aggregation is partial before the shuffle."""
    wide = lambda n: F.lit(n).cast("bigint")
    read = references.where(F.col("key").isNotNull() & F.col("at").isNotNull()).distinct().select("key", wide(1).alias("r"), wide(0).alias("e"), *names)
    both = read.unionByName(deltas.select("key", wide(0).alias("r"), F.col("delta").cast("bigint").alias("e")), allowMissingColumns=True)
    return both.groupBy("key").agg(F.sum("r").alias("n_refs"), F.sum("e").alias("n_existing"), *[F.max(n).alias(n) for n in names])


def advance(state: DataFrame, change: DataFrame) -> DataFrame:
    """A state with the counts of later deltas added; keys back at zero are dropped."""
    summed = state.unionByName(change).groupBy("key").agg(F.sum("n_refs").alias("n_refs"), F.sum("n_existing").alias("n_existing"))
    return summed.where((F.col("n_refs") != 0) | (F.col("n_existing") != 0))


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with positive references and no existence: the report as it stands now."""
    return state.where((F.col("n_refs") > 0) & (F.col("n_existing") <= 0))


def orphan_history(references: DataFrame, deltas: DataFrame, group: str) -> DataFrame:
    """(group, period 'YYYY-MM', n_keys): keys that are orphans at the end of each month.

    References stay in force from their moment on.  ``group`` is a column of both inputs
    that depends on the key.  A month without any delta of a group has no row.  Deltas
    are summed per key and month before the shuffle; a key has one row a month at most.
    """
    month = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("at") / 86_400_000_000).cast("int")), "yyyy-MM")
    read = references.where(F.col("key").isNotNull() & F.col("at").isNotNull()).distinct()
    both = read.select("key", group, "at", F.lit(1).alias("r"), F.lit(0).alias("e")).unionByName(deltas.select("key", group, "at", F.lit(0).alias("r"), F.col("delta").alias("e")))
    moved = both.groupBy("key", group, month.alias("period")).agg(F.sum("r").alias("r"), F.sum("e").alias("e"))
    upto = Window.partitionBy("key", group).orderBy("period")
    state = moved.select("key", group, "period", ((F.sum("r").over(upto) > 0) & (F.sum("e").over(upto) <= 0)).cast("int").alias("orphan"))
    turned = state.withColumn("turned", F.col("orphan") - F.coalesce(F.lag("orphan").over(upto), F.lit(0)))
    months = turned.groupBy(group, "period").agg(F.sum("turned").alias("turned"))
    return months.select(group, "period", F.sum("turned").over(Window.partitionBy(group).orderBy("period")).alias("n_keys"))


def mapping_orphans(tests: DataFrame, mapping: DataFrame, checks: DataFrame) -> DataFrame:
    """Orphans of the test mapping and its checks, per table and period.

    Result: distinct src_table, sync_period, row_id, ref_field, ref_key.  Null classes equal
    each other; rows without a file, function, entry or moment make no reference; repeated
    rows and equal entries count once; empty tables are allowed, other columns ignored.
    """
    found = orphans(*mapping_references(tests, mapping, checks))
    return found.select("src_table", "sync_period", "row_id", "ref_field", "ref_key").distinct()


def mapping_references(tests: DataFrame, mapping: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, existence deltas) of the test mapping and its checks.

    Both have src_table, the table whose references use the key.
    """
    python = F.col("suite") == "python"
    suite_key = key_of(F.when(python, "py").otherwise("rs"), F.col("file"), F.when(python, F.col("class_name")), F.col("function"))
    tests = tests.where(F.col("suite").isin("python", "rust") & F.col("file").isNotNull() & F.col("function").isNotNull())
    deltas = existence(tests.withColumn("src_table", F.lit("test_mapping")), suite_key, F.col("discovered_at"), F.col("removed_at"), "src_table")

    none = F.lit(None).cast("string")
    entry = lambda field, file, cls, name: F.struct(F.lit(field).alias("ref_field"), file.alias("file"), cls.alias("cls"), name.alias("name"))
    rust = F.coalesce("rust_functions", F.array().cast("array<string>"))
    entries = F.concat(
        F.array(entry("python_function", F.col("python_file"), F.col("python_class"), F.col("python_function")), entry("rust_function", F.col("rust_file"), none, F.col("rust_function"))),
        F.transform(rust, lambda name: entry("rust_functions", F.col("rust_file"), none, name)),
    )
    of_python = F.col("ref_field") == "python_function"
    named = mapping.select(F.col("mapping_id").alias("row_id"), "sync_period", "checked_at", "status", F.inline(entries))
    named = named.where(F.col("file").isNotNull() & F.col("name").isNotNull() & (of_python | F.col("status").isin("mapped", "partial")))
    shown = ["src_table", "sync_period", "row_id", "ref_field", "ref_key"]
    made = named.select(
        key_of(F.when(of_python, "py").otherwise("rs"), F.col("file"), F.col("cls"), F.col("name")).alias("key"), micros("checked_at").alias("at"),
        F.lit("test_mapping").alias("src_table"), "sync_period", "row_id", "ref_field", F.concat_ws("::", "file", "cls", "name").alias("ref_key"),
    )

    # What checks name: references recorded by mapping rows, from the moment of their own check on.
    recorded = mapping.where(F.col("rust_file").isNotNull()).select(F.lit("mapping_checks").alias("src_table"), "rust_file", "checked_at", F.explode(F.array_union(F.array("rust_function"), rust)).alias("name"))
    recorded = recorded.where(F.col("name").isNotNull())
    deltas = deltas.unionByName(existence(recorded, key_of(F.lit("map"), F.concat("rust_file", F.lit("::"), "name")), F.col("checked_at"), None, "src_table"))
    broken = checks.select(F.col("check_id").alias("row_id"), "sync_period", "checked_at", F.explode("broken_rust_refs").alias("ref_key")).where(F.col("ref_key").isNotNull())
    broken = broken.select(key_of(F.lit("map"), F.col("ref_key")).alias("key"), micros("checked_at").alias("at"), F.lit("mapping_checks").alias("src_table"), "sync_period", "row_id", F.lit("broken_rust_refs").alias("ref_field"), "ref_key")
    return made.select("key", "at", *shown).unionByName(broken.select("key", "at", *shown)), deltas


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per table, period and field."""
    return found.groupBy("src_table", "sync_period", "ref_field").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("row_id").alias("n_rows"), F.countDistinct("ref_key").alias("n_keys")
    )

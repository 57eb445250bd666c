"""Session helpers shared by all operators: reading tables, checkpoints, hot keys."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores, for work in Python that one task would do alone.

    Large inputs come in at least as many partitions as there are cores and are left as
    they are: nothing is shuffled.  Only inputs with fewer partitions (a single small
    file) are divided, by ``key``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``.  A session on this machine alone
    (``local[..]``) may do without and gets a folder of its own; elsewhere it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        given = tempfile.mkdtemp(prefix="vellumry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", given)
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(given)
    return given


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def micros(column: Column | str) -> Column:
    """A timestamp's microseconds on its own clock, whatever the session's time zone."""
    c = F.col(column) if isinstance(column, str) else column
    day = F.datediff(F.to_date(c), F.lit("1970-01-01")).cast("bigint")
    seconds = (F.hour(c) * 3600 + F.minute(c) * 60).cast("bigint")
    return (day * 86_400 + seconds) * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


#: Hash buckets of keys; a bucket is hot from so many rows on, or from so many times the mean.
BUCKETS, HOT_ROWS, HOT_MEANS = 1 << 14, 1_000_000, 4


def bucket_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, keys: list[str], rows: int = HOT_ROWS, most_salts: int = 1024) -> DataFrame:
    """Hash buckets of the keys with more rows than one task should get, with their salts.

    A bucket is hot from ``rows`` rows on; where the mean bucket comes near that, from
    ``HOT_MEANS`` times the mean on.  So at most a fourth of the 16,384 buckets can be hot
    whatever the size of ``df``, and the result (bucket, salts) is safe to broadcast.
    Finding it shuffles one counter per bucket and task.
    """
    counts = df.groupBy(bucket_of(keys).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # at most BUCKETS rows
    size = F.greatest(F.lit(rows), F.ceil(F.sum("n").over(every) * HOT_MEANS / BUCKETS))
    return counts.withColumn("size", size).where("n > size").select("bucket", F.least(F.ceil(F.col("n") / F.col("size")), F.lit(most_salts)).cast("int").alias("salts"))


def found_hot(hot: DataFrame) -> DataFrame | None:
    """The result of ``hot_buckets``, worked out once; None if no bucket is hot.

    At most a fourth of ``BUCKETS`` small rows come to the driver.
    """
    rows = hot.collect()
    return hot.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def split_hot(df: DataFrame, keys: list[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other buckets, rows of hot buckets with their ``salts``)."""
    marked = df.withColumn("bucket", bucket_of(keys))
    few = F.broadcast(hot)
    return marked.join(few.select("bucket"), "bucket", "left_anti").drop("bucket"), marked.join(few, "bucket").drop("bucket")


def salted_pair(many: DataFrame, few: DataFrame, spread: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on hot keys with a column ``salt``: rows of ``many`` are
    spread by ``spread``; rows of ``few`` are repeated once per salt of their bucket."""
    left = many.withColumn("salt", F.pmod(spread, F.col("salts")).cast("int")).drop("salts")
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return left, right


def running(df: DataFrame, keys: list[str], at: str, value: Column, how: str, out: str, descending: bool = False, ties: list[Column] | None = None, bucket_us: int = 86_400_000_000) -> DataFrame:
    """``df`` with ``out``, the aggregate of ``value`` over the rows before each row.

    Rows are ordered by ``at`` (microseconds, bigint), then by ``ties``, within
    ``keys``; ``how`` is ``sum``, ``min`` or ``max``.  The sum counts the row itself.

    One key may hold a large part of all rows, so no window spans a whole key: time
    is cut into buckets, their aggregates (partial before the shuffle) are run over
    the buckets of a key, and a window inside each bucket adds that base.
    """
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    far = F.desc if descending else F.asc
    cut = df.withColumn("_b", F.floor(F.col(at) / bucket_us)).withColumn("_v", value)
    over_buckets = Window.partitionBy(*keys).orderBy(far("_b")).rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*keys, "_b").agg(agg("_v").alias("_t")).withColumn("_base", agg("_t").over(over_buckets)).drop("_t")
    inside = Window.partitionBy(*keys, "_b").orderBy(far(at), *(ties or []))
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if how == "sum" else -1)
    condition = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]]
    joined = cut.alias("l").join(base.alias("r"), condition, "left").select("l.*", "r._base")
    mine = agg("_v").over(inside)
    if how == "sum":
        whole = F.coalesce(mine, F.lit(0)) + F.coalesce(F.col("_base"), F.lit(0))
    else:
        pick = F.least if how == "min" else F.greatest
        whole = pick(mine, F.col("_base"))
    return joined.withColumn(out, whole).drop("_b", "_v", "_base")

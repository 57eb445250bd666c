"""Processing only new or changed records (problem 4).

Two parts share one model of a work-item ledger:

* ``ledger_replay`` drives the recorded runs and file versions through the ledger of
  each root: versions are enqueued and withdrawn as they land, a run takes the next
  fencing token and leases what is pending, and exit code 0 completes the run.  A run
  that failed or was killed commits nothing: its leases end with the next token.
* ``Ledger`` keeps such a state for running jobs, as append-only files under
  deterministic paths in a shared folder.

``replay`` states the same answer as plain joins, as a second opinion for tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumry.runtime import found_hot, hot_buckets, micros, running, salted_pair, split_hot
from vellumry.sources.folders import SharedFolder


def hex64(column: Column) -> Column:
    """The unsigned 64-bit number written in hexadecimal digits, as a signed bigint.

    Any number of leading zeros and either case; anything else gives null.
    """
    good = F.when(column.rlike("^0*[0-9A-Fa-f]{1,16}$"), F.regexp_replace(column, "^0+(?=.)", ""))
    return F.conv(good, 16, -10).cast("bigint")


def _root(column: str) -> Column:
    """A root as a 16-byte digest; only equality of roots matters, and shuffles shrink."""
    return F.unhex(F.md5(F.col(column).cast("binary"))).alias("root")


def file_versions(versions: DataFrame) -> DataFrame:
    """(root, path, done_key, gone, modified, start); rows without root, path or times are none."""
    rows = versions.where(F.col("project_root").isNotNull() & F.col("path").isNotNull())
    return rows.select(
        _root("project_root"), "path", hex64(F.col("content_hash")).alias("done_key"), F.coalesce("deleted", F.lit(False)).alias("gone"),
        micros("modified_at").alias("modified"), micros("landed_at").alias("start"),
    ).dropna(subset=["modified", "start"])


def current_intervals(rows: DataFrame, hot: bool = False) -> DataFrame:
    """When each version of an item is the current one: (root, path, done_key, start, stop).

    A version counts from its landing until a row with a greater ``modified`` has landed;
    among equal ``modified`` the later landing wins.  Versions that are deleted take part
    but are not returned.  The intervals of an item are disjoint.  With ``hot``, an item
    may have any number of versions: time is cut into buckets (``runtime.running``).
    """
    ties = [F.desc("start"), F.col("gone"), F.col("done_key")]
    if hot:
        ended = running(rows, ["root", "path"], "modified", F.col("start"), "min", "stop", descending=True, ties=ties, bucket_us=90 * 86_400_000_000)
    else:
        newer = Window.partitionBy("root", "path").orderBy(F.desc("modified"), *ties).rowsBetween(Window.unboundedPreceding, -1)
        ended = rows.withColumn("stop", F.min("start").over(newer))
    return ended.where(~F.col("gone") & (F.col("stop").isNull() | (F.col("start") < F.col("stop")))).drop("gone", "modified")


def run_starts(runs: DataFrame) -> DataFrame:
    """(run_id, root, at, commit): commit describes the run if it had exit code 0."""
    rows = runs.where(F.col("run_id").isNotNull() & F.col("project_root").isNotNull()).select(
        "run_id", _root("project_root"), micros("started_at").alias("at"), "exit_code", "version", hex64(F.col("formatter_fingerprint")).alias("fingerprint"),
    ).where(F.col("at").isNotNull())
    commit = F.when(F.col("exit_code") == 0, F.struct("at", F.col("run_id").alias("base"), F.col("version").alias("v"), F.col("fingerprint").alias("f")))
    return rows.select("run_id", "root", "at", "fingerprint", commit.alias("commit"))


def fenced_runs(rows: DataFrame, hot: bool = False) -> DataFrame:
    """Each run with the commit it continues: (run_id, root, at, base_run or null).

    ``base_run`` is the last run of the root with exit code 0 and an earlier start,
    if its manifest has version 1 and the fingerprint of this run.  Runs of a root that
    start in the same instant do not see each other.
    """
    rows = rows.dropDuplicates(["root", "run_id"])
    if hot:
        instants = rows.groupBy("root", "at").agg(F.max("commit").alias("commit"))
        last = running(instants, ["root"], "at", F.col("commit"), "max", "last", bucket_us=30 * 86_400_000_000)
        rows = rows.drop("commit").join(last.select("root", "at", "last"), ["root", "at"])
    else:
        before = Window.partitionBy("root").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("last", F.max("commit").over(before))
    usable = (F.col("last.v") == 1) & (F.col("last.f") == F.col("fingerprint"))
    kept = [c for c in ("run_id", "root", "at", "salts") if c in rows.columns]
    return rows.select(*kept, F.when(usable, F.col("last.base")).alias("base_run"))


def _pending(files: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    f, r = files.alias("f"), runs.alias("r")
    same = [F.col(f"f.{k}") == F.col(f"r.{k}") for k in keys]
    inside = (F.col("r.at") >= F.col("f.start")) & (F.col("f.stop").isNull() | (F.col("r.at") < F.col("f.stop")))
    return f.join(r, [*same, inside]).select("r.run_id", "r.base_run", "f.path", "f.done_key")


def replay(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """The items each run had to process: distinct (run_id, path).

    An item without a number as hash is never known.  Empty tables give no rows.

    Files and runs are partitioned by root once; windows and the join reuse it.  Roots in
    hot buckets take another way: time buckets instead of windows, and a salted join.
    """
    files, starts = file_versions(versions), run_starts(runs)
    hot = found_hot(hot_buckets(files.select("root").unionByName(starts.select("root")), ["root"]))
    if hot is not None:
        files, hot_files = split_hot(files, ["root"], hot)
        starts, hot_starts = split_hot(starts, ["root"], hot)
    found = _pending(current_intervals(files.repartition("root")), fenced_runs(starts.repartition("root")), ["root"])
    if hot is not None:
        many = current_intervals(hot_files, hot=True)
        salts = hot_starts.groupBy("root").agg(F.max("salts").alias("salts"))
        few = fenced_runs(hot_starts.drop("salts"), hot=True).join(salts, "root")
        found = found.unionByName(_pending(*salted_pair(many, few, F.xxhash64("path")), ["root", "salt"]))
    committed = runs.where((F.col("exit_code") == 0) & (F.col("version") == 1)).select(F.col("run_id").alias("base_run"), F.explode("hashes").alias("h"))
    done = committed.select("base_run", hex64(F.col("h")).alias("done_key")).where(F.col("done_key").isNotNull())
    return found.join(done, ["base_run", "done_key"], "left_anti").select("run_id", "path")


#: Events of one instant in the order in which they take effect.
WITHDRAW, ENQUEUE, RUN, DONE = range(4)


class RootLedger:
    """The ledger of one root (or of one salt of it), fed with events in order of time.

    An item is a current path with its content.  It is done if its content was completed
    under the newest committed token and that commit fits the run that asks; leased if
    the newest token took it and nothing has ended that lease; pending otherwise.
    """

    def __init__(self) -> None:
        self.items: dict[str, int | None] = {}
        self.leased: set[str] = set()
        self.token = self.instant = None
        self.commit, self.done = None, set()
        self.next_commit, self.next_done = None, set()

    def enqueue(self, path: str, key: int | None) -> None:
        self.items[path] = key
        self.leased.discard(path)  # another content: what is under way does not cover it

    def withdraw(self, path: str) -> None:
        self.items.pop(path, None)
        self.leased.discard(path)

    def state(self, path: str, fingerprint: int | None) -> str:
        if self._fits(fingerprint) and self.items[path] in self.done:
            return "done"
        return "leased" if path in self.leased else "pending"

    def _fits(self, fingerprint: int | None) -> bool:
        return self.commit is not None and self.commit[1] == 1 and fingerprint is not None and self.commit[2] == fingerprint

    def lease(self, token: int, at: int, fingerprint: int | None) -> list[str]:
        """Take ``token``, which ends the leases of older ones; the paths leased under it."""
        if at != self.instant:
            # Runs that start in the same instant do not see each other.
            if self.next_commit is not None:
                self.commit, self.done = self.next_commit, self.next_done
                self.next_commit, self.next_done = None, set()
            self.instant = at
        self.token = token
        done = self.done if self._fits(fingerprint) else ()
        taken = [path for path, key in self.items.items() if key not in done]
        self.leased = set(taken)
        return taken

    def succeed(self, token: int, version: int | None, fingerprint: int | None) -> None:
        """Exit code 0: ``token`` commits, and nothing older counts from then on."""
        if token == self.token:
            self.next_commit, self.next_done = (token, version, fingerprint), set()
            self.leased = set()

    def complete(self, token: int, key: int) -> None:
        """A content marked done; ignored unless ``token`` is the newest to commit."""
        if self.next_commit is not None and self.next_commit[0] == token:
            self.next_done.add(key)


def _events(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Events of all ledgers: (root, salt, at, kind, token, path, key, ok, version).

    A hot root is divided by content, so that completions meet the items they concern;
    its runs go to each part.
    """
    files = file_versions(versions)
    rows = runs.where(F.col("run_id").isNotNull() & F.col("project_root").isNotNull()).select(
        _root("project_root"), micros("started_at").alias("at"), F.col("run_id").alias("token"), hex64(F.col("formatter_fingerprint")).alias("key"),
        (F.col("exit_code") == 0).alias("ok"), "version", "hashes",
    ).where(F.col("at").isNotNull())
    hot = found_hot(hot_buckets(files.select("root").unionByName(rows.select("root")), ["root"]))
    one, shown = F.lit(1).alias("salts"), ["root", "path", "done_key", "start", "stop"]
    if hot is None:
        current, rows = current_intervals(files).select(*shown, one), rows.select("*", one)
    else:
        cold_files, hot_files = split_hot(files, ["root"], hot)
        cold_rows, hot_rows = split_hot(rows, ["root"], hot)
        current = current_intervals(cold_files).select(*shown, one).unionByName(current_intervals(hot_files, hot=True).select(*shown, "salts"))
        rows = cold_rows.select("*", one).unionByName(hot_rows)
    none = lambda kind: F.lit(None).cast(kind)
    part = lambda c: F.pmod(c, F.col("salts")).cast("int").alias("salt")
    ends = F.array(F.struct(F.col("start").alias("at"), F.lit(ENQUEUE).alias("kind")), F.struct(F.col("stop").alias("at"), F.lit(WITHDRAW).alias("kind")))
    moves = current.select("root", part(F.coalesce(F.xxhash64("done_key", F.lit(0)), F.xxhash64("path"))).alias("salt"), F.inline(ends), none("bigint").alias("token"), "path", F.col("done_key").alias("key"), none("boolean").alias("ok"), none("int").alias("version"))
    starts = rows.drop("hashes").dropDuplicates(["root", "token"]).select("root", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "at", F.lit(RUN).alias("kind"), "token", none("string").alias("path"), "key", "ok", "version")
    marks = rows.where(F.col("ok") & (F.col("version") == 1)).select("root", "salts", "at", "token", F.explode("hashes").alias("h")).withColumn("key", hex64(F.col("h"))).where(F.col("key").isNotNull())
    marks = marks.select("root", part(F.xxhash64("key", F.lit(0))).alias("salt"), "at", F.lit(DONE).alias("kind"), "token", none("string").alias("path"), "key", none("boolean").alias("ok"), none("int").alias("version"))
    return moves.where(F.col("at").isNotNull()).unionByName(starts).unionByName(marks)


def _drive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run_id, path) of each lease; the events of a ledger are adjacent and in order."""
    at_root, ledger = None, RootLedger()
    ids: list[int] = []
    paths: list[str] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.string())], names=["run_id", "path"])
    for batch in batches:
        for root, salt, at, kind, token, path, key, ok, version in zip(*(c.to_pylist() for c in batch.columns)):
            if (root, salt) != at_root:
                at_root, ledger = (root, salt), RootLedger()
            if kind == DONE:
                ledger.complete(token, key)
            elif kind == ENQUEUE:
                ledger.enqueue(path, key)
            elif kind == WITHDRAW:
                ledger.withdraw(path)
            else:
                taken = ledger.lease(token, at, key)
                ids += [token] * len(taken)
                paths += taken
                if ok:
                    ledger.succeed(token, version, key)
                if len(ids) > 50_000:
                    yield flush()
                    ids, paths = [], []
    yield flush()


def ledger_replay(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """The items each run leases from the ledger of its root: distinct (run_id, path).

    Events are partitioned by ledger, sorted by time and streamed; a task holds the
    current items and the newest completions of one ledger at a time.
    """
    events = _events(runs, versions).repartition("root", "salt").sortWithinPartitions("root", "salt", "at", "kind", "token")
    return events.mapInArrow(_drive, "run_id bigint, path string")


class Ledger:
    """A ledger of work items in a folder that all machines share.

    States of an item: pending, leased (until ``expires``), done.  Every ``lease``
    call takes the next fencing token by creating the token's file, which only one caller
    can; a ``complete`` under a token that is not the item's newest is ignored when the
    state is read.  Files are written under names derived from the token, so a retried
    step finds its own result and nothing is counted twice.  The state is a DataFrame
    computed from the files; nothing is held by the driver.  ``compact`` bounds the files.
    """

    SCHEMA = "item string, kind string, token bigint, at double, expires double"

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, SharedFolder(spark, folder)

    def _write(self, df: DataFrame, name: str) -> None:
        if not self.folder.exists(f"events/{name}/_SUCCESS"):  # else a retry of a step that had finished
            df.write.mode("overwrite").parquet(f"{self.folder.path}/events/{name}")

    def _finished(self) -> list[str]:
        """Names of finished parts: the newest base and what it does not cover."""
        names = [n for n in self.folder.names("events") if self.folder.exists(f"events/{n}/_SUCCESS")]
        bases = [n for n in names if n.startswith("base-")]
        if not bases:
            return names
        covered = {r["name"] for r in self.spark.read.parquet(f"{self.folder.path}/covers/{bases[-1]}").collect()}
        return [n for n in names if n not in covered]

    def events(self) -> DataFrame:
        finished = [f"{self.folder.path}/events/{n}" for n in self._finished()]
        return self.spark.read.schema(self.SCHEMA).parquet(*finished) if finished else self.spark.createDataFrame([], self.SCHEMA)

    def enqueue(self, items: DataFrame, batch: str, at: float) -> None:
        """Add the column ``item`` as pending; repeating a ``batch`` changes nothing."""
        rows = items.select("item").where(F.col("item").isNotNull()).distinct()
        self._write(rows.select("item", F.lit("enqueue").alias("kind"), F.lit(0).cast("bigint").alias("token"), F.lit(float(at)).alias("at"), F.lit(None).cast("double").alias("expires")), f"enqueue-{batch}")

    def _next_token(self) -> int:
        token = 1 + max((int(t) for t in self.folder.names("tokens")), default=0)
        while not self.folder.claim(f"tokens/{token}"):
            token += 1
        return token

    def state(self, now: float) -> DataFrame:
        """(item, state, token): done wins only under the item's newest lease token.

        An item enqueued again after it was leased is not covered by that lease: it is
        pending from then on, whatever the lease completes.
        """
        of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
        items = self.events().groupBy("item").agg(
            of("lease", "token").alias("lease"), F.max(F.when(F.col("kind") == "lease", F.struct("token", "at", "expires"))).alias("held"),
            of("done", "token").alias("done"), of("enqueue", "at").alias("queued"),
        )
        covered = F.col("held.at") >= F.col("queued")
        done = covered & (F.col("done") == F.col("lease"))
        leased = covered & (F.col("held.expires") > now)
        return items.select("item", F.when(done, "done").when(leased & ~F.coalesce(F.col("done") == F.col("lease"), F.lit(False)), "leased").otherwise("pending").alias("state"), F.col("lease").alias("token"))

    def lease(self, now: float, seconds: float, most: int | None = None) -> int:
        """Lease all pending items (or ``most`` of them); returns the fencing token."""
        token = self._next_token()
        pending = self.state(now).where(F.col("state") == "pending").select("item")
        if most is not None:
            pending = pending.orderBy("item").limit(most)
        self._write(pending.select("item", F.lit("lease").alias("kind"), F.lit(token).cast("bigint").alias("token"), F.lit(float(now)).alias("at"), F.lit(float(now + seconds)).alias("expires")), f"lease-{token:012d}")
        return token

    def leased(self, token: int) -> DataFrame:
        return self.events().where((F.col("kind") == "lease") & (F.col("token") == token)).select("item")

    def complete(self, token: int, now: float, items: DataFrame | None = None) -> None:
        """Mark the items of a lease done; the file's name depends on the token only."""
        mine = self.leased(token) if items is None else items.select("item").join(self.leased(token), "item", "left_semi")
        self._write(mine.select("item", F.lit("done").alias("kind"), F.lit(token).cast("bigint").alias("token"), F.lit(float(now)).alias("at"), F.lit(None).cast("double").alias("expires")), f"done-{token:012d}")

    def compact(self) -> None:
        """Keep one row per item and kind, which is all that the state depends on.

        The new base names the parts it covers before it is written; until it is finished
        the old parts count.  Parts covered by the base before it are removed.  A batch
        or token that has been compacted must not be written again.
        """
        before = self._finished()
        token = self._next_token()
        old = [n for n in self.folder.names("events") if n not in before]
        newest = self.events().groupBy("item", "kind").agg(F.max(F.struct("token", "at", "expires")).alias("n")).select("item", "kind", "n.*")
        name = f"base-{token:012d}"
        self.spark.createDataFrame([(n,) for n in before], "name string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/covers/{name}")
        self._write(newest, name)
        for n in old:
            self.folder.remove(f"events/{n}")

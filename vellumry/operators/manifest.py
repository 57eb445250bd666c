"""The incremental manifest: which contents are known to be formatted.

A manifest is a table (project, fingerprint, content_hash).  Documents whose content is
known under the present fingerprint are skipped; hashes of formatted output are added at
the end of a run.  Nothing is ever evicted.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import warnings
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry import __version__
from vellumry.functions.text import content_hash
from vellumry.options import FormatOptions
from vellumry.sources.folders import SharedFolder

SCHEMA = "project string, fingerprint string, content_hash string"


def fingerprint(options: FormatOptions, config: bytes = b"", config_path: str = "") -> str:
    """A stable digest of everything that decides the output besides the content."""
    facts = {k: getattr(v, "value", v) for k, v in asdict(options).items()}
    text = json.dumps([__version__, facts, config_path], sort_keys=True).encode() + config
    return hashlib.sha256(text).hexdigest()[:16]


def project_key(root: str) -> str:
    return hashlib.sha256(os.path.realpath(root).encode()).hexdigest()[:16]


def cache_root(given: str | None = None, environment: dict[str, str] | None = None) -> tuple[str, str]:
    """(folder, how it was found): given, the user's cache, the home folder or the temporary one."""
    env = os.environ if environment is None else environment
    if given:
        return given, "given"
    if env.get("XDG_CACHE_HOME"):
        return f"{env['XDG_CACHE_HOME']}/vellumry", "cache"
    if env.get("HOME"):
        return f"{env['HOME']}/.cache/vellumry", "home"
    return f"{env.get('TMPDIR', '/tmp')}/vellumry", "temporary"


def _versions(folder: SharedFolder) -> list[str]:
    """Finished versions of a manifest, the newest last."""
    return [n for n in folder.names() if n.startswith("v-") and folder.exists(f"{n}/_SUCCESS")]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The manifest in the folder ``path``; one that is missing or damaged is empty.

    Damage is warned of: it must not stop a run, but costs formatting everything again.
    Where the folder itself cannot be listed the error is raised.
    """
    folder = SharedFolder(spark, path)
    for name in reversed(_versions(folder)):
        try:
            found = spark.read.schema(SCHEMA).parquet(f"{path}/{name}")
            found.isEmpty()
            return found
        except Exception as e:  # noqa: BLE001 - whatever a damaged file raises
            warnings.warn(f"manifest {path}/{name} is damaged: {str(e).splitlines()[0]}", stacklevel=2)
    return spark.createDataFrame([], SCHEMA)


def hashed(docs: DataFrame, content_col: str = "content") -> DataFrame:
    return docs.withColumn("content_hash", content_hash(F.col(content_col)))


def unformatted(docs: DataFrame, manifest: DataFrame, mark: str) -> DataFrame:
    """Documents (with content_hash) that are not known under the fingerprint ``mark``."""
    known = manifest.where(F.col("fingerprint") == mark).select("content_hash").distinct()
    return docs.join(known, "content_hash", "left_anti")


def known(docs: DataFrame, manifest: DataFrame, mark: str) -> DataFrame:
    return docs.join(manifest.where(F.col("fingerprint") == mark).select("content_hash").distinct(), "content_hash", "left_semi")


def merged(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Old and new entries, each once."""
    return manifest.select("project", "fingerprint", "content_hash").unionByName(done.select("project", "fingerprint", "content_hash")).distinct()


def write(manifest: DataFrame, path: str) -> None:
    """Write a manifest as the next version in the folder ``path``, in order of hashes.

    A version counts once it is finished, so a run that stops in between leaves the version
    before it.  Older ones are removed, except the one that ``manifest`` may come from.
    """
    folder = SharedFolder(manifest.sparkSession, path)
    last = _versions(folder)
    n = int(last[-1][2:]) + 1 if last else 1
    manifest.sort("project", "fingerprint", "content_hash").write.mode("overwrite").parquet(f"{path}/v-{n:09d}")
    for name in last[:-1]:
        folder.remove(name)


def hit_counts(docs: DataFrame, manifest: DataFrame, mark: str, by: list[str]) -> DataFrame:
    """(by, hits, misses, rate): documents that are known under ``mark``, and the others.

    A document without a hash is a miss.  Hashes are joined, and counted before the
    result is shuffled by group.
    """
    marks = manifest.where(F.col("fingerprint") == mark).select("content_hash", F.lit(1).alias("_hit")).distinct()
    seen = docs.select(*by, "content_hash").join(marks, "content_hash", "left")
    counts = seen.groupBy(*by).agg(F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
    total = F.col("hits") + F.col("misses")
    tenths = F.floor((F.col("hits") * 2000 + total) / (2 * total))
    return counts.withColumn("rate", F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")))


def hit_rate(hits: int, misses: int) -> str:
    """Share of hits with one decimal, rounded half up."""
    total = hits + misses
    tenths = 0 if not total else (hits * 2000 + total) // (2 * total)
    return f"{tenths // 10}.{tenths % 10}%"


def human_bytes(n: int) -> str:
    """Bytes with a unit and one decimal, cut off."""
    unit, size = 0, n
    while size >= 1024 and unit < 4:
        size, unit = size / 1024, unit + 1
    return f"{n} B" if unit == 0 else f"{int(size * 10) / 10:.1f} {'B KB MB GB TB'.split()[unit]}"


def usage(folder: str) -> tuple[int, int]:
    """(files, bytes) below a folder; a missing folder is empty."""
    sizes = [os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names]
    return len(sizes), sum(sizes)


def clear(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)

"""Corpora as DataFrames, and sinks for formatted documents."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vellumry.sources.files import Resolver, Selection

SCHEMA = "path string, content binary, error string"


def read_paths(spark: SparkSession, paths: Iterable[str], per_task: int = 64) -> DataFrame:
    """(path, content, error) of files, read by the executors.

    Reading the listed paths keeps hidden folders and avoids following links, which a
    directory scan would not.
    """
    rows = spark.createDataFrame(pd.DataFrame({"path": pd.Series(list(paths), dtype=object)}), "path string")
    n = max(1, rows.count() // per_task)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                content = error = None
                try:
                    with open(path, "rb") as f:
                        content = f.read()
                except OSError as e:
                    error = str(e)
                yield pd.DataFrame({"path": [path], "content": [content], "error": [error]})

    return rows.repartition(n, "path").mapInPandas(read, SCHEMA)


def read_corpus(spark: SparkSession, inputs: Iterable[str], selection: Selection = Selection(), cwd: str | None = None) -> DataFrame:
    """The selected files of files, folders and glob patterns."""
    return read_paths(spark, Resolver(selection, cwd).resolve(inputs))


def read_text(spark: SparkSession, text: bytes) -> DataFrame:
    """A one-row corpus for text from standard input."""
    return spark.createDataFrame([("<stdin>", bytearray(text), None)], SCHEMA)


def replace_file(path: str, content: bytes, backup: bool) -> None:
    """Write beside the file, keep its mode, rename into place; optionally keep the old one."""
    folder = os.path.dirname(path) or "."
    handle, fresh = tempfile.mkstemp(dir=folder, prefix=".vellumry-")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
        if os.path.exists(path):
            shutil.copymode(path, fresh)
            if backup:
                shutil.copy2(path, path + ".orig")
        os.replace(fresh, path)
    except BaseException:
        if os.path.exists(fresh):
            os.unlink(fresh)
        raise


def write_in_place(formatted: DataFrame, backup: bool = True) -> DataFrame:
    """Replace files whose content changes; returns (path, written).

    Bytes are compared again before writing, so a retried task writes nothing twice and
    unchanged files keep their times.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for path, text in zip(pdf["path"], pdf["formatted"]):
                new = text.encode()
                with open(path, "rb") as f:
                    changes = f.read() != new
                if changes:
                    replace_file(path, new, backup)
                done.append(changes)
            yield pd.DataFrame({"path": pdf["path"], "written": done})

    return formatted.where(F.col("changed")).select("path", "formatted").mapInPandas(write, "path string, written boolean")


def write_file(formatted: DataFrame, path: str) -> None:
    """The single document of ``formatted`` as one file; parent folders are made."""
    rows: list[Row] = formatted.select("formatted").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("an output file takes exactly one document")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    replace_file(path, rows[0]["formatted"].encode(), backup=False)


def output(formatted: DataFrame) -> Iterator[str]:
    """Formatted documents in order of path, streamed partition by partition."""
    for row in formatted.where(F.col("formatted").isNotNull()).select("path", "formatted").orderBy("path").toLocalIterator():
        yield row["formatted"]


def check(formatted: DataFrame) -> DataFrame:
    """Paths that would be reformatted, in order."""
    return formatted.where(F.col("changed")).select("path").orderBy("path")

"""Command line: format, check or list documents.

Exit codes: 0 done, 1 files would change (``--check``), 2 a document or path is in error.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellumry import __version__
from vellumry.operators import manifest
from vellumry.operators.documents import format_documents, format_metrics
from vellumry.options import ListSpacing
from vellumry.sources import config, corpus
from vellumry.sources.files import Resolver, Selection


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellumry", argument_default=argparse.SUPPRESS)
    p.add_argument("files", nargs="*", default=["-"])
    p.add_argument("-o", "--output", default=None)
    p.add_argument("-w", "--width", type=int)
    for short, name in (("-p", "plaintext"), ("-s", "semantic"), ("-c", "cleanups"), (None, "smartquotes"), (None, "ellipses"), ("-i", "inplace"), (None, "nobackup"), (None, "force-exclude")):
        p.add_argument(*filter(None, (short, f"--{name}")), action="store_true")
    p.add_argument("--list-spacing", type=lambda s: ListSpacing.parse(s).value)
    p.add_argument("--auto", action="store_true", default=False)
    p.add_argument("--check", action="store_true", default=False)
    p.add_argument("--list-files", action="store_true", default=False)
    for name in ("include", "extend-include", "exclude", "extend-exclude"):
        p.add_argument(f"--{name}", action="append")
    p.add_argument("--no-respect-gitignore", dest="respect_gitignore", action="store_false")
    p.add_argument("--files-max-size", type=int)
    p.add_argument("--config", default=None)
    p.add_argument("--cache-dir", default=None)
    p.add_argument("--no-cache", dest="cache", action="store_false", default=True)
    p.add_argument("--threads", default="*")
    for name in ("show-cache", "clear-cache", "perf-stats", "verbose"):
        p.add_argument(f"--{name}", action="store_true", default=False)
    p.add_argument("--version", action="version", version=f"vellumry {__version__}")
    return p


def main(argv: list[str] | None = None) -> int:
    given = vars(parser().parse_args(argv))
    run = {k: given.pop(k) for k in ("files", "output", "auto", "check", "list_files", "config", "cache_dir", "cache", "threads", "show_cache", "clear_cache", "perf_stats", "verbose")}
    path = run["config"] or config.find(".")
    values = config.merge(given, config.load(path) if path else {}, run["auto"])
    options = config.options(values)
    names = {"files_max_size": "max_size"}
    chosen = {names.get(k, k): v for k, v in values.items() if k in ("extend_include", "exclude", "extend_exclude", "respect_gitignore", "force_exclude", "files_max_size")}
    if "include" in given:
        chosen["include"] = given["include"]
    root = manifest.cache_root(run["cache_dir"] or values.get("cache_dir") or values.get("incremental_cache_dir"))
    if run["show_cache"] or run["clear_cache"]:
        n, size = manifest.usage(root[0])
        print(f"{root[0]} ({root[1]}): {n} files, {manifest.human_bytes(size)}")
        if run["clear_cache"]:
            manifest.clear(root[0])
        return 0
    inplace = values.get("inplace", False)
    if inplace and "-" in run["files"]:
        print("standard input cannot be replaced in place", file=sys.stderr)
        return 2
    try:
        paths = Resolver(Selection(**chosen)).resolve([f for f in run["files"] if f != "-"])
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    if run["list_files"]:
        print(*paths, sep="\n")
        return 0
    spark = SparkSession.builder.master(f"local[{run['threads']}]").config("spark.ui.enabled", "false").getOrCreate()
    docs = corpus.read_paths(spark, paths)
    if "-" in run["files"]:
        docs = docs.unionByName(corpus.read_text(spark, sys.stdin.buffer.read()))
    mark = manifest.fingerprint(options, open(path, "rb").read() if path else b"", path or "")
    folder = root[0] + "/" + manifest.project_key(".")
    cached = inplace and run["cache"] and values.get("cache", values.get("incremental", True))
    if run["verbose"]:
        print(f"{len(paths)} files, width {options.width}, cache {folder if cached else 'off'}", file=sys.stderr)
    if cached:  # only digests are joined; the misses are read again
        seen = manifest.hashed(docs).select("path", "content_hash")
        misses = manifest.unformatted(seen, manifest.read(spark, folder), mark).select("path")
        docs = corpus.read_paths(spark, [r["path"] for r in misses.toLocalIterator()])
    done = format_documents(docs, "content", options, read_error="error").cache()
    code = 0
    for row in done.where(F.col("error").isNotNull()).select("path", "error").orderBy("path").toLocalIterator():
        print(f"{row['path']}: {row['error']}", file=sys.stderr)
        code = 2
    if run["check"]:
        for row in corpus.check(done).toLocalIterator():
            print(f"Would reformat: {row['path']}")
            code = code or 1
    elif inplace:
        corpus.write_in_place(done.where(F.col("error").isNull()), not values.get("nobackup", False)).count()
        if cached:
            fresh = manifest.hashed(done.where(F.col("error").isNull()).select(F.encode("formatted", "UTF-8").alias("content")))
            fresh = fresh.select(F.lit(manifest.project_key(".")).alias("project"), F.lit(mark).alias("fingerprint"), "content_hash")
            manifest.write(manifest.merged(manifest.read(spark, folder), fresh), folder)
    elif run["output"]:
        corpus.write_file(done, run["output"])
    else:
        for text in corpus.output(done):
            sys.stdout.write(text)
    if run["perf_stats"]:
        total, misses = len(paths) + ("-" in run["files"]), done.count()
        row = format_metrics(done.select("content"), "content", options).agg(F.sum("n_chars").alias("chars"), F.sum("parse_us").alias("parse"), F.sum("render_us").alias("render")).first()
        print(f"documents {total}, cache hits {total - misses} ({manifest.hit_rate(total - misses, misses)}), characters {row['chars'] or 0}, parse {(row['parse'] or 0) / 1e3:.1f} ms, render {(row['render'] or 0) / 1e3:.1f} ms", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())

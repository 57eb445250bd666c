"""File selection, configuration, sinks, command line and streams."""

import os
import warnings

import pytest
from pyspark.sql import functions as F

from vellumry import cli
from vellumry.operators.documents import format_documents
from vellumry.options import FormatOptions, ListSpacing
from vellumry.sources import config, corpus
from vellumry.sources.files import Ignore, Resolver, Selection, matches, needs_resolution
from vellumry.streaming import documents as streams


@pytest.fixture
def tree(tmp_path):
    for name in ("README.md", "docs/api.md", "docs/deep/x.md", "node_modules/p/README.md", ".hidden/h.md", "drafts/wip.md", "src/main.rs", "big.md"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("a  b\n" if name != "big.md" else "x" * 3000)
    return tmp_path


def names(tree, inputs=(".",), **options):
    return [os.path.relpath(p, os.path.realpath(tree)) for p in Resolver(Selection(**options), str(tree)).resolve(inputs)]


def test_walk(tree):
    assert names(tree) == [".hidden/h.md", "README.md", "big.md", "docs/api.md", "docs/deep/x.md", "drafts/wip.md"]
    assert "big.md" not in names(tree, max_size=2000) and "big.md" in names(tree, max_size=0)
    assert names(tree, include=["*.rs"]) == ["src/main.rs"]
    assert "drafts/wip.md" not in names(tree, extend_exclude=["drafts/"])
    assert "drafts/wip.md" in names(tree, extend_exclude=["wip.md"])  # patterns of files prune no folder
    os.symlink(tree, tree / "docs" / "loop")
    assert len(names(tree)) == 6


def test_ignore_files(tree):
    (tree / ".gitignore").write_text("drafts/\n*.tmp\n!keep\n# c\n")
    (tree / "docs" / ".gitignore").write_text("deep/*.md\n")
    (tree / ".vellumryignore").write_text("README.md\n")
    assert names(tree) == [".hidden/h.md", "big.md", "docs/api.md"]
    assert "drafts/wip.md" in names(tree, respect_gitignore=False)
    (tree / ".gitignore").write_bytes(b"\xff\xfe")
    assert "drafts/wip.md" in names(tree)
    rules = Ignore("/r", ["*.md", "!a.md", "/top", "**/z/", "x/**", "bad["])
    assert rules.verdict("/r/b.md", False) is True and rules.verdict("/r/d/a.md", False) is False and rules.verdict("/r/top", False) is True
    assert rules.verdict("/r/d/top", False) is None and rules.verdict("/r/d/z", True) is True and rules.verdict("/r/x/y", False) is True


def test_named_files_and_globs(tree):
    assert names(tree, ["node_modules/p/README.md"]) == ["node_modules/p/README.md"]
    assert names(tree, ["node_modules/p/README.md"], force_exclude=True) == []
    assert names(tree, ["big.md"], max_size=10) == []
    assert names(tree, ["**/*.md", "README.md"]) == [".hidden/h.md", "README.md", "big.md", "docs/api.md", "docs/deep/x.md", "drafts/wip.md"]
    with pytest.raises(FileNotFoundError):
        names(tree, ["missing.md"])
    assert needs_resolution(["a*"]) and needs_resolution([str(tree)]) and not needs_resolution(["-"])
    assert matches("/r/a/b.md", ["a/"], "/r") and matches("/r/a/b.md", ["/a/b.md"], "/r") and not matches("/r/a/b.md", ["b/"], "/r")


def test_config(tmp_path):
    (tmp_path / "pyproject.toml").write_text("[tool.other]\nx = 1\n")
    assert config.find(str(tmp_path)) is None or not config.find(str(tmp_path)).startswith(str(tmp_path))
    (tmp_path / "vellumry.toml").write_text('width = 70\n[format]\nlist-spacing = "Loose"\nsemantic = "yes"\nodd = 1\n')
    path = config.find(str(tmp_path / "."))
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        values = config.load(path)
    assert values == {"width": 70, "list_spacing": "Loose"} and any("odd" in str(w.message) for w in said)
    assert config.options(values).list_spacing is ListSpacing.LOOSE
    assert config.merge({"width": 5}, {"width": 70, "semantic": False}, auto=True) | {} == config.merge({"width": 5}, {}, auto=True)
    assert config.merge({}, {"semantic": False}) == {"semantic": False}
    (tmp_path / "bad.toml").write_text("= 1")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert config.load(str(tmp_path / "bad.toml")) == {}


def test_read_and_write(spark, tree):
    done = format_documents(corpus.read_corpus(spark, [str(tree)]), "content", FormatOptions(), read_error="error")
    lost = format_documents(corpus.read_paths(spark, [str(tree / "lost.md")]), "content", read_error="error").first()
    assert lost["formatted"] is None and "lost.md" in lost["error"]
    assert [os.path.basename(r["path"]) for r in corpus.check(done).collect()] == ["h.md", "README.md", "big.md", "api.md", "x.md", "wip.md"]
    os.chmod(tree / "README.md", 0o640)
    assert corpus.write_in_place(done).where("written").count() == 6
    assert (tree / "README.md").read_text() == "a b\n" and (tree / "README.md.orig").read_text() == "a  b\n"
    assert os.stat(tree / "README.md").st_mode & 0o777 == 0o640
    assert corpus.write_in_place(done).where("written").count() == 0
    corpus.write_file(done.where(F.col("path").endswith("big.md")), str(tree / "out" / "one.md"))
    assert (tree / "out" / "one.md").read_text() == "x" * 3000 + "\n"
    with pytest.raises(ValueError):
        corpus.write_file(done, str(tree / "out" / "many.md"))
    assert next(iter(corpus.output(done))) == "a b\n"


def test_command_line(spark, tree, capsys, monkeypatch):
    monkeypatch.chdir(tree)
    assert cli.main(["--list-files", "docs"]) == 0 and "api.md" in capsys.readouterr().out
    assert cli.main(["--check", "README.md"]) == 1 and "Would reformat" in capsys.readouterr().out
    assert cli.main(["README.md"]) == 0 and capsys.readouterr().out == "a b\n"
    cache = ["--cache-dir", str(tree / "cache")]
    assert cli.main(["--auto", "README.md", *cache]) == 0 and (tree / "README.md").read_text() == "a b\n" and not (tree / "README.md.orig").exists()
    assert cli.main(["--auto", "README.md", *cache]) == 0
    assert cli.main(["--perf-stats", "--verbose", "docs"]) == 0 and "cache hits 0" in capsys.readouterr().err
    assert cli.main(["--show-cache", *cache]) == 0 and " files, " in capsys.readouterr().out
    assert cli.main(["--clear-cache", *cache]) == 0 and not (tree / "cache").exists()
    assert cli.main(["-i", "-"]) == 2 and cli.main(["missing.md"]) == 2
    (tree / "bad.md").write_bytes(b"\xff")
    assert cli.main(["--check", "bad.md"]) == 2
    monkeypatch.setattr(cli.Resolver, "resolve", lambda self, inputs: [str(tree / "vanished.md")])
    capsys.readouterr()
    assert cli.main(["--check", "vanished.md"]) == 2 and "vanished.md: " in capsys.readouterr().err


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT 1 AS id, 'a  b' AS text, timestamp'2025-01-01 00:00:00' AS at UNION ALL SELECT 2, 'a  b', timestamp'2025-01-01 01:00:00' UNION ALL SELECT 3, 'c', timestamp'2025-01-01 02:00:00'").write.parquet(source)
    stream = spark.readStream.schema("id int, text string, at timestamp").parquet(source)
    fresh = streams.format_stream(streams.new_contents(stream, "at"))
    query = fresh.writeStream.format("memory").queryName("formatted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["formatted"] for r in spark.table("formatted").collect()) == ["a b\n", "c\n"]
    counted = streams.verdicts_per_window(streams.format_stream(stream), "at")
    query = counted.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["n_docs"], r["n_changed"]) for r in spark.table("windows").collect()] == [(3, 3)]

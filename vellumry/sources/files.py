"""File selection: inputs, directory walks, patterns and ignore files (on the driver).

Selection decides which paths a run reads.  Only the list of paths is made here; contents
are read by the executors.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

# Directories that are never entered by default.
DEFAULT_EXCLUDES = [
    ".git/", ".hg/", ".svn/", ".bzr/", "_darcs/",
    ".venv/", "venv/", "__pycache__/", ".tox/", ".nox/", ".mypy_cache/", ".ruff_cache/", ".pytest_cache/", ".eggs/", "*.egg-info/",
    "build/", "dist/",
    "node_modules/", ".next/", ".nuxt/", ".output/", ".cache/", ".parcel-cache/", ".turbo/",
    ".idea/", ".vscode/", ".vs/", ".fleet/",
    "coverage/", "htmlcov/", ".coverage/",
    "vendor/", "third_party/", "Pods/", "target/", ".terraform/",
]
DEFAULT_INCLUDES = ["*.md"]
_GLOB = re.compile(r"[*?\[]")


@dataclass
class Selection:
    """Parameters of file selection.  ``max_size`` 0 means no limit."""

    tool: str = "vellumry"
    include: list[str] = field(default_factory=lambda: list(DEFAULT_INCLUDES))
    extend_include: list[str] = field(default_factory=list)
    exclude: list[str] | None = None
    extend_exclude: list[str] = field(default_factory=list)
    respect_gitignore: bool = True
    force_exclude: bool = False
    max_size: int = 1 << 20

    @property
    def includes(self) -> list[str]:
        return list(dict.fromkeys(self.include + self.extend_include))

    @property
    def excludes(self) -> list[str]:
        return (DEFAULT_EXCLUDES if self.exclude is None else self.exclude) + self.extend_exclude


class Ignore:
    """Rules of one ignore file, applied to paths below its folder; the last match wins."""

    def __init__(self, folder: str, lines: Iterable[str]) -> None:
        self.folder, self.rules = folder, []
        for line in lines:
            line = line.rstrip("\n\r")
            line = line if line.endswith("\\ ") else line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[1:] if keep else line.removeprefix("\\")
            only_dirs = line.endswith("/")
            line = line.rstrip("/")
            try:
                self.rules.append((re.compile(self._pattern(line)), keep, only_dirs))
            except re.error:
                continue

    @staticmethod
    def _pattern(glob_: str) -> str:
        anchored = "/" in glob_
        out, k = "", 0
        glob_ = glob_.lstrip("/")
        while k < len(glob_):
            c = glob_[k]
            if glob_.startswith("**/", k):
                out, k = out + "(?:.*/)?", k + 3
            elif glob_.startswith("/**", k) and k + 3 == len(glob_):
                out, k = out + "/.*", k + 3
            elif c == "*":
                out, k = out + "[^/]*", k + 1
            elif c == "?":
                out, k = out + "[^/]", k + 1
            elif c == "[" and "]" in glob_[k + 2 :]:
                end = glob_.index("]", k + 2)
                body = glob_[k + 1 : end]
                out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
            else:
                out, k = out + re.escape(glob_[k + 1] if c == "\\" and k + 1 < len(glob_) else c), k + (2 if c == "\\" else 1)
        return ("" if anchored else "(?:.*/)?") + out

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept again, None: no rule matches."""
        below = os.path.relpath(path, self.folder)
        found = None
        for pattern, keep, only_dirs in self.rules:
            if (is_dir or not only_dirs) and pattern.fullmatch(below):
                found = not keep
        return found

    @classmethod
    def read(cls, path: str) -> Ignore | None:
        """The rules of a file; None if it is missing, unreadable, not UTF-8 or empty."""
        try:
            with open(path, encoding="utf-8") as f:
                own = cls(os.path.dirname(path), f.readlines())
        except (OSError, UnicodeDecodeError):
            return None
        return own if own.rules else None


def matches(path: str, patterns: Iterable[str], cwd: str) -> bool:
    """Whether a pattern matches the name, the path below ``cwd`` or a folder above it."""
    below = os.path.relpath(path, cwd)
    parts = below.split(os.sep)
    for pattern in patterns:
        bare = pattern.lstrip("/")
        if bare.endswith("/"):
            bare = bare.rstrip("/")
            if any(fnmatchcase(p, bare) for p in parts[:-1]) or below.startswith(bare + "/"):
                return True
        elif fnmatchcase(parts[-1], bare) or fnmatchcase(below, bare) or any(fnmatchcase(p, bare) for p in parts[:-1]):
            return True
    return False


def needs_resolution(inputs: Iterable[str]) -> bool:
    return any(i != "-" and (os.path.isdir(i) or _GLOB.search(i)) for i in inputs)


class Resolver:
    def __init__(self, selection: Selection = Selection(), cwd: str | None = None) -> None:
        self.selection, self.cwd = selection, os.path.realpath(cwd or os.getcwd())

    def resolve(self, inputs: Iterable[str]) -> list[str]:
        """Absolute paths, each once, in order of bytes.  A missing input is an error."""
        found: set[str] = set()
        for given in inputs:
            path = given if os.path.isabs(given) else os.path.join(self.cwd, given)
            if os.path.isfile(path):
                found.update(self._file(path))
            elif os.path.isdir(path):
                found.update(self._walk(path))
            elif _GLOB.search(given):
                found.update(self._glob(path))
            else:
                raise FileNotFoundError(f"path not found: {given}")
        return sorted(map(os.path.realpath, found), key=os.fsencode)

    def _fits(self, path: str) -> bool:
        try:
            return not self.selection.max_size or os.path.getsize(path) <= self.selection.max_size
        except OSError:
            return True

    def _included(self, name: str) -> bool:
        return any(fnmatchcase(name, p) for p in self.selection.includes)

    def _pruned(self, name: str) -> bool:
        return any(p.endswith("/") and fnmatchcase(name, p.strip("/")) for p in self.selection.excludes)

    def _file(self, path: str) -> Iterator[str]:
        """A file named outright passes excludes (unless forced), never the size limit."""
        if self.selection.force_exclude:
            rules = self._tool_ignore(path)
            if matches(path, self.selection.excludes, self.cwd) or rules and rules.verdict(path, False):
                return
        if self._fits(path):
            yield path

    def _tool_ignore(self, path: str) -> Ignore | None:
        folder = os.path.dirname(os.path.realpath(path))
        while True:
            candidate = os.path.join(folder, f".{self.selection.tool}ignore")
            if os.path.isfile(candidate):
                return Ignore.read(candidate)
            if folder == os.path.dirname(folder):
                return None
            folder = os.path.dirname(folder)

    def _walk(self, root: str) -> Iterator[str]:
        names = ([".gitignore"] if self.selection.respect_gitignore else []) + [f".{self.selection.tool}ignore"]
        rules: dict[str, list[Ignore]] = {}
        for folder, dirs, files in os.walk(root, followlinks=False):
            inherited = rules.get(os.path.dirname(folder), []) if folder != root else []
            here = rules[folder] = inherited + [r for n in names if n in files and (r := Ignore.read(os.path.join(folder, n)))]

            def ignored(name: str, is_dir: bool) -> bool:
                verdicts = [v for r in here if (v := r.verdict(os.path.join(folder, name), is_dir)) is not None]  # noqa: B023
                return bool(verdicts) and verdicts[-1]

            dirs[:] = sorted(d for d in dirs if not self._pruned(d) and not ignored(d, True) and not os.path.islink(os.path.join(folder, d)))
            for name in files:
                path = os.path.join(folder, name)
                if self._included(name) and not ignored(name, False) and not os.path.islink(path) and self._fits(path):
                    yield path

    def _glob(self, pattern: str) -> Iterator[str]:
        for path in glob.glob(pattern, recursive=True, include_hidden=True):
            if os.path.isfile(path) and self._included(os.path.basename(path)) and self._fits(path) and not any(map(self._pruned, path.split(os.sep)[:-1])):
                yield path

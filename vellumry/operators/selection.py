"""File selection over a table of paths, with native expressions.

The same rules as ``sources.files`` without a file system: names must match an include
pattern, no folder above may match an exclude pattern, and the size must fit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumry.sources.files import Selection


def glob_regex(pattern: str, any_char: str = ".") -> str:
    """A file-name pattern as a regular expression of the Java kind."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += f"{any_char}*"
        elif c == "?":
            out += any_char
        elif end > 0:
            body = pattern[k + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"\&&")
            out, k = out + (f"[^{body[1:]}]" if body[0] == "!" else f"[{body}]"), end
        else:
            out += re.escape(c)
        k += 1
    return out


def is_included(path: Column, selection: Selection) -> Column:
    """Whether the name matches an include pattern."""
    return path.rlike(rf"(?s)(?:\A|/)(?:{'|'.join(glob_regex(p, '[^/]') for p in selection.includes)})\z")


def is_pruned(path: Column, selection: Selection) -> Column:
    """Whether a folder above the file matches an exclude pattern for folders."""
    folders = [glob_regex(p.strip("/"), "[^/]") for p in selection.excludes if p.endswith("/")]
    return path.rlike(rf"(?s)(?:\A|/)(?:{'|'.join(folders)})/") if folders else F.lit(False)


def fits(size: Column, selection: Selection) -> Column:
    """Whether a file is within the size limit; an unknown size fits, as an unreadable file does."""
    return F.coalesce(size <= selection.max_size, F.lit(True)) if selection.max_size else F.lit(True)


def select_paths(df: DataFrame, selection: Selection = Selection(), path_col: str = "path", size_col: str | None = None) -> DataFrame:
    """The rows of ``df`` whose path is selected; rows without a path are not.

    Filters only: nothing is shuffled, and they reach the scan.  Repeated rows stay.
    """
    path = F.col(path_col)
    kept = df.where(is_included(path, selection) & ~is_pruned(path, selection))
    return kept.where(fits(F.col(size_col), selection)) if size_col else kept

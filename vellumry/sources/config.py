"""Configuration files: discovery, reading and merging (on the driver)."""

from __future__ import annotations

import os
import tomllib
import warnings
from collections.abc import Callable
from dataclasses import fields, replace
from typing import Any

from vellumry.options import FormatOptions, ListSpacing

#: Name -> kind of every known key.
KEYS = {
    "width": int, "semantic": bool, "cleanups": bool, "smartquotes": bool, "ellipses": bool, "list_spacing": str, "inplace": bool, "nobackup": bool,
    "include": list, "extend_include": list, "exclude": list, "extend_exclude": list, "respect_gitignore": bool, "force_exclude": bool, "files_max_size": int,
    "cache": bool, "incremental": bool, "cache_dir": str, "incremental_cache_dir": str,
}
#: Fields that the automatic preset decides, whatever a file says.
LOCKED_BY_AUTO = {"semantic", "cleanups", "smartquotes", "ellipses", "inplace", "nobackup"}


def find(start: str, tool: str = "vellumry") -> str | None:
    """The nearest configuration file at or above ``start``; a pyproject.toml counts only
    with a section of the tool."""
    folder = os.path.realpath(start)
    while True:
        for name in (f".{tool}.toml", f"{tool}.toml"):
            if os.path.isfile(os.path.join(folder, name)):
                return os.path.join(folder, name)
        project = os.path.join(folder, "pyproject.toml")
        if os.path.isfile(project) and tool in _read(project).get("tool", {}):
            return project
        if folder == os.path.dirname(folder):
            return None
        folder = os.path.dirname(folder)


def _read(path: str) -> dict:
    try:
        with open(path, "rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        warnings.warn(f"{path}: {e}", stacklevel=2)
        return {}


def load(path: str, tool: str = "vellumry") -> dict[str, Any]:
    """Known values of a file.  Sections are flattened one level, hyphens are underscores,
    unknown keys warn, and values of the wrong kind are left out."""
    raw = _read(path)
    if os.path.basename(path) == "pyproject.toml":
        raw = raw.get("tool", {}).get(tool, {})
    flat: dict[str, Any] = {}
    for key, value in raw.items():
        flat |= value if isinstance(value, dict) else {key: value}
    out: dict[str, Any] = {}
    for key, value in flat.items():
        name = key.replace("-", "_")
        kind = KEYS.get(name)
        if kind is None:
            warnings.warn(f"{path}: unknown key {key!r}", stacklevel=2)
        elif kind is int and isinstance(value, int) and not isinstance(value, bool) and value >= 0 or kind is not int and type(value) is kind:
            if kind is not list or all(isinstance(x, str) for x in value):
                out[name] = value
    return out


def merge(explicit: dict[str, Any], config: dict[str, Any], auto: bool = False, apply: Callable[[str, Any], None] | None = None) -> dict[str, Any]:
    """Effective values: explicit flag, else file (unless the preset locks it), else absent.

    ``apply`` is called with the name and value of each value of the file that takes effect.
    """
    for name, value in config.items():
        if apply and name not in explicit and not (auto and name in LOCKED_BY_AUTO):
            apply(name, value)
    kept = {k: v for k, v in config.items() if not (auto and k in LOCKED_BY_AUTO)}
    preset = dict.fromkeys(LOCKED_BY_AUTO, True) if auto else {}
    return kept | preset | explicit


def options(values: dict[str, Any], base: FormatOptions = FormatOptions()) -> FormatOptions:
    names = {f.name for f in fields(FormatOptions)}
    given = {k: v for k, v in values.items() if k in names}
    if isinstance(given.get("list_spacing"), str):
        given["list_spacing"] = ListSpacing.parse(given["list_spacing"])
    return replace(base, **given)

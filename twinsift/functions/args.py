"""Arguments that name folders and extensions."""

from __future__ import annotations

import os
import re
from pathlib import Path

_ONE = re.compile(r"\s*(?:[*]?[.])?(?P<body>[0-9A-Za-z]{1,10})\s*", re.ASCII)
# Suffixes that, written with their dot, name a script and are refused
_SCRIPTS = (".bat", ".cmd", ".com", ".exe", ".js", ".ps1", ".sh", ".vbs")


class ArgumentError(ValueError):
    """An argument that names no folder or no extension."""


def extension(raw: str) -> str:
    """`mp4`, `.mp4` and `*.MP4` as `.mp4`."""
    found = _ONE.fullmatch(raw) if raw.isprintable() else None
    if found is None or raw.strip().lower().lstrip("*") in _SCRIPTS:
        raise ArgumentError(f"{raw!r} is no extension; write one as mp4 or .mp4")
    return f".{found['body'].lower()}"


def extensions(raw: list[str] | None) -> list[str] | None:
    """A list's distinct extensions in order, blank entries aside; None, which stands for every file, if there are none."""
    return sorted({extension(x) for x in raw or () if x.strip()}) or None


def folder(raw: str) -> Path:
    """The real path of a folder that exists; ~ is the home folder."""
    try:
        path = Path(os.path.realpath(os.path.expanduser(raw)))
        exists = path.is_dir()
    except (OSError, ValueError) as e:
        raise ArgumentError(f"{raw!r} can't be looked up") from e
    if not exists:
        raise ArgumentError(f"there is no folder {raw!r}")
    return path

"""Small files of the driver: written whole or not at all."""

from __future__ import annotations

import hashlib
import json
import math
import os
import shutil
import tempfile
from pathlib import Path


def atomic_text(path: str, text: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, held = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(held, path)
    except BaseException:
        Path(held).unlink(missing_ok=True)
        raise


def plain(x):
    """A value for JSON: NaN and infinities are null."""
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def atomic_json(path: str, value) -> None:
    atomic_text(path, json.dumps(plain(value), indent=2, sort_keys=True, default=str) + "\n")


def write_immutable(path: str, text: str) -> bool:
    """Writes a file that must never change; False if it is there with this very text."""
    if os.path.exists(path):
        if Path(path).read_text(encoding="utf-8") != text:
            raise FileExistsError(f"{path} exists with other content")
        return False
    atomic_text(path, text)
    return True


def sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def tree_sha256(root: str, pattern: str = "**/*.py") -> str:
    """One digest of the names and contents below a folder."""
    out = hashlib.sha256()
    for p in sorted(Path(root).glob(pattern)):
        if p.is_file():
            out.update(f"{p.relative_to(root)}\0{sha256(str(p))}\n".encode())
    return out.hexdigest()


def promote(made: str, place: str, overwrite: bool = False) -> None:
    """Moves a finished file or folder to its place; what was there is kept aside until the move has worked."""
    if os.path.exists(place) and not overwrite:
        raise FileExistsError(place)
    aside = f"{place}.aside"
    if os.path.exists(place):
        os.replace(place, aside)
    try:
        os.replace(made, place)
    except BaseException:
        if os.path.exists(aside):
            os.replace(aside, place)
        raise
    if os.path.isdir(aside):
        shutil.rmtree(aside)
    else:
        Path(aside).unlink(missing_ok=True)

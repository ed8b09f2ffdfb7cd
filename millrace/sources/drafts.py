"""Documents written on the driver: only to places that are safe to write, and whole or not at all."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from pathlib import Path


def contains(folder: str, path: str) -> bool:
    """Whether path, with links followed, is folder or lies in it. Neither has to exist. Linear in the path's length."""
    inner, outer = os.path.realpath(path), os.path.realpath(folder)
    return inner == outer or inner.startswith(outer.rstrip(os.sep) + os.sep)


def refusal(path: str, *, within: Iterable[str], never: Iterable[str] = ()) -> str | None:
    """Why a draft must not go to path, or None: it is a link or no plain file, lies in none of the folders it may, or in one it must not."""
    if not path or "\0" in path:
        return "the destination is empty or holds a null character"
    if os.path.islink(path):
        return f"{path} is a link"
    if os.path.exists(path) and not os.path.isfile(path):
        return f"{path} is not a plain file"
    if not any(contains(f, path) for f in within):
        return f"{path} lies outside the folders a draft may go to"
    if any(contains(f, path) for f in never):
        return f"{path} lies in a folder that drafts stay out of"
    return None


def write_draft(path: str, pieces: Iterable[str], *, within: Iterable[str], never: Iterable[str] = ()) -> int:
    """Writes the pieces one after another in place of what path held; its size in bytes. If a piece fails, no draft is left."""
    if why := refusal(path, within=list(within), never=list(never)):
        raise ValueError(why)
    try:
        with open(path, "w", encoding="utf-8", newline="") as f:
            for piece in pieces:
                f.write(piece)
    except BaseException:
        Path(path).unlink(missing_ok=True)
        raise
    return os.path.getsize(path)


def to_document(value: object) -> str:
    """JSON indented by two, with <, > and & escaped, ending in a new line."""
    text = json.dumps(value, indent=2, ensure_ascii=False)
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e") + "\n"

"""Hook registrations in a hooks.json: one command added to every event, or taken out again, with all else left as it was."""

from __future__ import annotations

import copy
import json
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

#: The events that a command is registered for.
EVENTS = (
    "sessionStart", "sessionEnd", "beforeSubmitPrompt", "preToolUse", "postToolUse", "postToolUseFailure", "beforeShellExecution", "afterShellExecution", "beforeMCPExecution", "afterMCPExecution", "beforeReadFile",
    "afterFileEdit", "beforeTabFileRead", "afterTabFileEdit", "subagentStart", "subagentStop", "afterAgentResponse", "afterAgentThought", "stop", "preCompact", "workspaceOpen",
)


def is_ours(entry: Any, command: str) -> bool:
    """An entry is known by a command that is a text; entries of any other shape are someone else's."""
    return isinstance(entry, dict) and entry.get("command") == command


def _table(document: dict) -> dict:
    return document["hooks"] if isinstance(document.get("hooks"), dict) else {}


def registered(document: dict, command: str, events: tuple[str, ...] = EVENTS) -> dict:
    """The document with the command under every event. A version of 1 is added where there is none, and no version is changed."""
    old = _table(document)
    listed = {e: old[e] if isinstance(old.get(e), list) else [] for e in events}
    new = {e: [*entries, {"command": command}] for e, entries in listed.items() if not any(is_ours(x, command) for x in entries)}
    return {"version": 1} | copy.deepcopy(document) | {"hooks": copy.deepcopy(old | new)}


def unregistered(document: dict, command: str) -> dict:
    """The document without the command. An event goes with its last entry."""
    left = {e: [x for x in entries if not is_ours(x, command)] if isinstance(entries, list) else [] for e, entries in _table(document).items()}
    return copy.deepcopy(document) | {"hooks": copy.deepcopy({e: entries for e, entries in left.items() if entries})}


def count(document: dict, command: str) -> int:
    return sum(is_ours(x, command) for entries in _table(document).values() if isinstance(entries, list) for x in entries)


def _read(path: Path) -> tuple[dict, bytes | None]:
    """The document and its bytes; none of either if there is no file. What isn't a JSON object is refused, since it couldn't be kept."""
    if not path.exists():
        return {}, None
    data = path.read_bytes()
    try:
        document = json.loads(data)
    except ValueError as e:
        raise ValueError(f"{path} is not valid JSON and stays untouched: {e}") from e
    if document is None:
        document = {}
    if not isinstance(document, dict):
        raise ValueError(f"{path} holds no JSON object and stays untouched")
    return document, data


def _write(path: Path, document: dict, before: bytes | None, now: datetime) -> str | None:
    """Writes by way of a second file, for the owner alone. The place of the old file's copy, if there was one."""
    path.parent.mkdir(mode=0o700, parents=True, exist_ok=True)
    backup = None
    if before is not None:
        backup = path.with_name(f"{path.name}.bak-{now:%Y%m%dT%H%M%SZ}")
        backup.write_bytes(before)
        backup.chmod(0o600)
    new = path.with_name(path.name + ".new")
    new.write_text(json.dumps(document, indent=2, sort_keys=True, ensure_ascii=False) + "\n")
    new.chmod(0o600)
    new.replace(path)
    return backup and str(backup)


def install(path: str, command: str, *, now: datetime | None = None) -> dict:
    """Registers the command. Writes nothing where nothing changes. hooks_json, backup, events_registered, events_removed, schema_version_added."""
    document, data = _read(Path(path))
    after = registered(document, command)
    added, version = count(after, command) - count(document, command), "version" not in document
    backup = _write(Path(path), after, data, now or datetime.now(UTC)) if added or version else None
    return {"hooks_json": path, "backup": backup, "events_registered": added, "events_removed": 0, "schema_version_added": version}


def uninstall(path: str, command: str, *, now: datetime | None = None) -> dict:
    """Takes the command out. A file without it, or no file, stays as it is."""
    document, data = _read(Path(path))
    removed = count(document, command)
    backup = _write(Path(path), unregistered(document, command), data, now or datetime.now(UTC)) if removed else None
    return {"hooks_json": path, "backup": backup, "events_registered": 0, "events_removed": removed, "schema_version_added": False}

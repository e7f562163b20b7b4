"""Tools of the user: Python handlers by plugin, and Spark SQL templates in a JSON file."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

HANDLERS: dict[str, Callable] = {}
_LOCKS: dict[str, threading.RLock] = {}
_GUARD = threading.Lock()


def register_tool(plugin: str, handler: Callable) -> None:
    """``handler(inputs, config, ctx) -> {anchor: DataFrame}`` for a plugin, or for a tool kind."""
    HANDLERS[plugin] = handler


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


@dataclass
class Entry:
    """``sql`` is Spark SQL with {input0}, {input1}, ... for the inputs."""

    plugin: str
    sql: str
    config_hash: str = ""
    notes: str = ""
    created: str = ""
    uses: int = 0


class Registry:
    """Entries by plugin in a JSON file, replaced as a whole. A file that can't be read counts as empty."""

    def __init__(self, path: str | Path | None = None):
        self.path = Path(path or os.environ.get("TOOL_REGISTRY_PATH") or Path.home() / ".weftline" / "tools.json")
        with _GUARD:
            self.lock = _LOCKS.setdefault(str(self.path.resolve()), threading.RLock())

    def _load(self) -> dict[str, dict]:
        try:
            found = json.loads(self.path.read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def _store(self, entries: dict[str, dict]) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(dir=self.path.parent, suffix=".tmp")
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(entries, f, indent=2, sort_keys=True)
        os.replace(name, self.path)

    def get(self, plugin: str) -> Entry | None:
        with self.lock:
            found = self._load().get(plugin)
            return Entry(**found) if found else None

    def put(self, plugin: str, sql: str, config: dict | None = None, notes: str = "") -> Entry:
        entry = Entry(plugin, sql, config_hash(config or {}), notes, datetime.now(UTC).isoformat(timespec="seconds"))
        with self.lock:
            entries = self._load()
            entries[plugin] = asdict(entry)
            self._store(entries)
        return entry

    def used(self, plugin: str) -> None:
        with self.lock:
            entries = self._load()
            if plugin in entries:
                entries[plugin]["uses"] = entries[plugin].get("uses", 0) + 1
                self._store(entries)

    def all(self) -> list[Entry]:
        with self.lock:
            return [Entry(**e) for _, e in sorted(self._load().items())]

    def clear(self) -> int:
        with self.lock:
            n = len(self._load())
            self._store({})
            return n

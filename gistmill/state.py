"""State of a session on the driver: a bounded cache, texts that can be restored by handle, notes of a conversation."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable


class BoundedCache:
    """Least recently used entries go beyond ``entries`` or ``size`` bytes; older ones than ``seconds`` and those of another version count as absent."""

    def __init__(self, entries: int = 100, size: int = 50 << 20, seconds: float | None = 1800, clock: Callable[[], float] = time.monotonic):
        self.entries, self.size, self.seconds, self.clock = entries, size, seconds, clock
        self._held: OrderedDict[str, tuple[object, int, str | None, float]] = OrderedDict()
        self.bytes = 0

    def __len__(self) -> int:
        return len(self._held)

    def put(self, key: str, value: object, size: int, version: str | None = None) -> bool:
        """Whether the value was kept: one larger than the cache is not."""
        self.remove(key)
        if size > self.size:
            return False
        self._held[key] = (value, size, version, self.clock())
        self.bytes += size
        while len(self._held) > self.entries or self.bytes > self.size:
            self.remove(next(iter(self._held)))
        return True

    def get(self, key: str, version: str | None = None) -> object | None:
        if key not in self._held:
            return None
        value, _, kept, at = self._held[key]
        if kept != version or (self.seconds is not None and self.clock() - at > self.seconds):
            self.remove(key)
            return None
        self._held.move_to_end(key)
        return value

    def remove(self, key: str) -> None:
        if key in self._held:
            self.bytes -= self._held.pop(key)[1]


class OriginStore:
    """Whole texts behind the handles that condensed ones carry."""

    def __init__(self, entries: int = 64, size: int = 32 << 20):
        self._cache = BoundedCache(entries, size, seconds=None)

    def keep(self, text: str) -> str:
        data = text.encode("utf-8")
        handle = "d" + hashlib.sha1(data).hexdigest()[:10]
        self._cache.put(handle, text, len(data))
        return handle

    def restore(self, handle: str) -> str | None:
        return self._cache.get(handle)


class Memory:
    """Notes of conversations by name."""

    def __init__(self):
        self._notes: dict[str, dict] = {}

    def set(self, conversation: str, **notes: object) -> None:
        self._notes.setdefault(conversation, {}).update(notes)

    def get(self, conversation: str) -> dict:
        return dict(self._notes.get(conversation, {}))

    def clear(self, conversation: str | None = None) -> None:
        if conversation is None:
            self._notes.clear()
        else:
            self._notes.pop(conversation, None)

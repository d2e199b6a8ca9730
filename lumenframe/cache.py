"""Answers that are kept on the driver while the history they were computed from stands.

An answer belongs to a version of the history, the name of an operator and its arguments. When the history's pointer
moves, all answers of older versions go at once, so an answer is never older than the data; ``max_age`` bounds it
further for operators whose result depends on the clock. Only small, finished results belong here: the least recently
used go beyond ``capacity``.
"""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable
from threading import Lock


class Answers:
    """``version`` gives the history's current version, ``clock`` seconds; both are parameters for tests."""

    def __init__(self, version: Callable[[], object] = lambda: None, clock: Callable[[], float] = time.monotonic, capacity: int = 1000):
        self.version, self.clock, self.capacity = version, clock, capacity
        self._kept: OrderedDict = OrderedDict()
        self._of, self._lock, self.asked, self.found = None, Lock(), 0, 0

    def ask(self, operator: str, compute: Callable, max_age: float = 60.0, **arguments):
        """The kept answer if it is younger than ``max_age``, else that of ``compute(**arguments)``. None isn't kept."""
        name, version = (operator, json.dumps(arguments, sort_keys=True, default=repr)), self.version()
        with self._lock:
            if version != self._of:
                self._kept.clear()
                self._of = version
            self.asked += 1
            if name in self._kept and self.clock() - self._kept[name][0] < max_age:
                self._kept.move_to_end(name)
                self.found += 1
                return self._kept[name][1]
        answer = compute(**arguments)
        with self._lock:
            if answer is not None and version == self._of:
                self._kept[name] = (self.clock(), answer)
                self._kept.move_to_end(name)
                while len(self._kept) > self.capacity:
                    self._kept.popitem(last=False)
        return answer

    def forget(self, operator: str | None = None) -> None:
        """Drops the answers of one operator, or all."""
        with self._lock:
            for name in [n for n in self._kept if not operator or n[0] == operator]:
                del self._kept[name]

    def usage(self) -> dict:
        with self._lock:
            rate = round(self.found / self.asked, 2) if self.asked else 0
            return {"asked": self.asked, "found": self.found, "hit_rate": rate, "kept": len(self._kept)}

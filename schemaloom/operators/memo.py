"""What was made of a text, kept by a Python worker from task to task, so that texts that repeat are planned once.

It lives in a module of its own: functions sent to executors refer to it by name, and so share it within a worker.
"""

from __future__ import annotations

import sys

#: Bytes that a worker keeps at most, by its own count of texts and results.
LIMIT = 32 << 20
#: What an entry takes beside its values.
ENTRY = 400


class Memo:
    """Two generations: what is asked for again moves to the younger one, and the older one goes when that is full."""

    def __init__(self, limit: int = LIMIT) -> None:
        self.limit, self.young, self.old, self.held = limit, {}, {}, 0

    def get(self, kind, text: str, make) -> list[tuple]:
        """make(text), a list of rows. kind tells apart what is made of the same text."""
        key = (kind, text)
        if (found := self.young.get(key)) is not None:
            return found
        found = self.old[key] if key in self.old else make(text)
        size = ENTRY + sys.getsizeof(text) + sum(sys.getsizeof(v) for row in found for v in (row, *row))
        if size > self.limit // 2:
            return found
        if self.held + size > self.limit // 2:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = found
        self.held += size
        return found


_KEPT = Memo()


def rows_of(kind, text: str, make) -> list[tuple]:
    return _KEPT.get(kind, text, make)

"""A logarithmic family of sorted arrays: new rows become a level of their own and
levels of about equal size merge, so n rows cost n log n in all and a probe looks
at log n levels."""

from __future__ import annotations

import numpy as np


class LevelFamily:
    """Levels sorted by ``key``; ``payload`` columns travel with it.

    ``ordered(key, payload)`` gives the sort order of a level.
    """

    def __init__(self, order):
        self.order = order
        self.levels: list[dict[str, np.ndarray]] = []

    def add(self, rows: dict[str, np.ndarray]) -> None:
        """Adds rows that are already in order, then merges geometrically."""
        if not len(next(iter(rows.values()))):
            return
        self.levels.append(rows)
        size = lambda level: len(next(iter(level.values())))
        while len(self.levels) > 1 and 2 * size(self.levels[-1]) >= size(self.levels[-2]):
            new, old = self.levels.pop(), self.levels.pop()
            both = {k: np.concatenate((old[k], new[k])) for k in old}
            at = self.order(both)
            self.levels.append({k: v[at] for k, v in both.items()})

"""Where cells cross their thresholds, for whole blocks of updates at once.

A cell adds up its updates; when it reaches its threshold it is sent and starts from nothing.  From then on a block's course depends
on the place alone, so a block is a function from what the cell holds before it to what it holds after it.  Such functions
are small tables; blocks of one cell are judged side by side and strung together by their functions.
"""

from __future__ import annotations

import numpy as np


class Reach:
    """The first place, from one on, whose value is at least a bound: by the largest values of spans of 1, 2, 4, ... places."""

    def __init__(self, values: np.ndarray, longest: int):
        self.spans = [values]
        while 2 << (len(self.spans) - 1) <= longest:
            half, last = 1 << (len(self.spans) - 1), self.spans[-1]
            self.spans.append(np.maximum(last[:-half], last[half:]))

    def first(self, start: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Of places ``start .. end - 1``; ``end`` where there is none."""
        at = start.copy()
        for k in reversed(range(len(self.spans))):
            inside = np.flatnonzero(at + (1 << k) <= end)
            skip = inside[self.spans[k][at[inside]] < bound[inside]]
            at[skip] += 1 << k
        return at


class Blocks:
    """Updates of blocks, one after the other: block b has updates ``start[b] .. start[b + 1] - 1``, and may have none.

    ``tau`` is the threshold at each update; signed cells are sent at either sign.
    """

    def __init__(self, w: np.ndarray, tau: np.ndarray, start: np.ndarray, signed: bool):
        n, size = len(w), np.diff(start)
        longest = int(size.max(initial=0))
        self.start, self.signed, self.tau, self.n = start, signed, tau, n
        self.sum = np.zeros(n + 1)
        np.cumsum(w, out=self.sum[1:])
        self.up = Reach(self.sum[1:] - tau, longest)
        self.down = Reach(-self.sum[1:] - tau, longest) if signed else None
        self.end = np.repeat(start[1:], size)
        # From nothing, at each update.
        at = np.arange(n)
        self.next = self._first(at, self.end, self.sum[:n])
        after = self.next + 1
        jump = np.where(after < self.end, after, at)
        self.jumps = [jump]
        while (1 << len(self.jumps)) < longest:
            self.jumps.append(self.jumps[-1][self.jumps[-1]])
        last = at
        for j in self.jumps:
            last = j[last]
        self.rest = np.where(self.next[last] < self.end, 0.0, self.sum[self.end] - self.sum[last]) if n else np.zeros(0)

    def _first(self, start: np.ndarray, end: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The first crossing of cells that held ``self.sum[start] - base`` before ``start``."""
        found = self.up.first(start, end, base)
        return found if self.down is None else np.minimum(found, self.down.first(start, end, -base))

    def run(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(places, sent, left)``: the updates that make cells cross, in order, what is sent at each, and what each block holds at its end."""
        a, b = self.start[:-1], self.start[1:]
        base = self.sum[a] - held
        first = self._first(a, b, base)
        hit = first < b
        on = np.flatnonzero(hit)
        left = self.sum[b] - base
        begun = first[on] + 1
        inside = begun < b[on]
        left[on] = 0.0
        left[on[inside]] = self.rest[begun[inside]]
        seen = np.zeros(self.n, bool)
        seen[begun[inside]] = True
        for j in reversed(self.jumps):
            seen[j[seen]] = True
        from_ = np.flatnonzero(seen)
        from_ = from_[self.next[from_] < self.end[from_]]
        places = np.concatenate([first[on], self.next[from_]])
        sent = np.concatenate([self.sum[first[on] + 1] - base[on], self.sum[self.next[from_] + 1] - self.sum[from_]])
        order = np.argsort(places, kind="stable")
        return places[order], sent[order], left

    def function(self, b: int) -> tuple[list, list, list, list, list, list, float]:
        """Block b from what is held to what is left: see :func:`applied`.

        The first crossing is the first update whose ``tau - sum`` is at most what is held, or, with signs, whose ``-tau - sum`` is at least
        that; only updates that lower the least so far, or raise the most, can be it.  Where every value crosses the table ends.
        """
        i, j = int(self.start[b]), int(self.start[b + 1])
        p = self.sum[i + 1 : j + 1] - self.sum[i]
        tau = self.tau[i:j]
        low = np.minimum.accumulate(tau - p) if j > i else p
        high = np.maximum.accumulate(-tau - p) if self.signed and j > i else np.full(j - i, 0.0 if j == i or np.diff(self.sum[i : j + 1]).min() >= 0 else -np.inf)
        done = np.flatnonzero(low <= high)
        n = int(done[0]) + 1 if len(done) else j - i
        rest = np.zeros(n)
        more = np.arange(n) + i + 1 < j
        rest[more] = self.rest[np.arange(n)[more] + i + 1]
        ups = np.flatnonzero(np.diff(low[:n], prepend=np.inf) < 0)
        downs = np.flatnonzero(np.diff(high[:n], prepend=-np.inf) > 0) if self.signed else np.zeros(0, int)
        return (*(x.tolist() for x in (low[ups], ups, rest[ups], high[downs], downs, rest[downs])), float(p[-1]) if j > i else 0.0)


def applied(function: tuple, held: float) -> float:
    """What is left of ``held`` behind a block."""
    low, low_at, low_rest, high, high_at, high_rest, total = function
    # `low` falls, `high` rises.
    i = int(np.searchsorted(-np.asarray(low), -held, "left")) if len(low) else 0
    j = int(np.searchsorted(np.asarray(high), held, "left")) if len(high) else 0
    up, down = (low_at[i] if i < len(low) else np.inf), (high_at[j] if j < len(high) else np.inf)
    if up == down == np.inf:
        return held + total
    return float(low_rest[i] if up <= down else high_rest[j])

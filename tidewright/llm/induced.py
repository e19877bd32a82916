"""Suffix arrays by external induced sorting.

The text is split into L- and S-type suffixes. The leftmost S-type ones are ranked by recursion on
their named substrings; two scans then induce all other suffixes from them, each scan taking
suffixes in order from a priority queue and pushing their left neighbours back into it. The queue
keeps sorted runs on disk once it holds more than ``limit`` items, and the text and the suffix
array are files too, so a shard may be far larger than memory. Items of one first symbol leave the
queue together, which makes each step an array operation.

A reduced text of up to ``base`` names is ranked in memory by doubling.

Defined cases: a text of no or one symbol is its own order; symbols may repeat in any way (periodic
texts too) and need not be dense; equal suffixes can't occur, as one ends before the other: the
shorter comes first.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass

import numpy as np

#: Items of a queue in memory, and names that are ranked in memory: less than a piece of a shard has, so that
#: production pieces spill and recurse.
LIMIT = 1 << 17
BASE = 1 << 18
#: Up to so many suffixes of a symbol are handled one by one, more as arrays.
FEW = 48


@dataclass
class Work:
    """What was done: runs written by the queues, and levels of recursion below the first."""

    spills: int = 0
    recursions: int = 0


class DiskQueue:
    """A priority queue of (symbol, suffix): all items of a symbol leave together, in the order pushed.

    The scans ask for symbols in order and push only symbols that are still to come, so the first item
    is always one of the symbol asked for.
    """

    def __init__(self, folder: str, limit: int, name: str, work: Work | None = None) -> None:
        self.folder, self.limit, self.name = folder, limit, name
        self.work = work or Work()
        self.near: dict[int, list[np.ndarray | list[int]]] = {}
        self.held = 0
        self.files: list[tuple[np.ndarray, dict[int, tuple[int, int]]]] = []

    def push(self, symbols: np.ndarray, suffixes: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        ordered = symbols[order]
        cuts = np.flatnonzero(np.diff(ordered)) + 1
        for symbol, part in zip(ordered[np.concatenate([[0], cuts])].tolist(), np.split(suffixes[order], cuts), strict=True):
            self.near.setdefault(symbol, []).append(part)
        self.held += len(symbols)
        if self.held > self.limit:
            self._spill()

    def add(self, symbol: int, suffix: int) -> None:
        """Push one item."""
        parts = self.near.get(symbol)
        if parts is None:
            self.near[symbol] = [[suffix]]
        elif type(parts[-1]) is list:
            parts[-1].append(suffix)
        else:
            parts.append([suffix])
        self.held += 1
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        """Write what is in memory as one run, sorted by symbol, in the order pushed."""
        self.work.spills += 1
        keys = sorted(self.near)
        parts = [np.concatenate([np.asarray(p, np.int64) for p in self.near[k]]) for k in keys]
        ends = np.cumsum([len(p) for p in parts]).tolist()
        path = os.path.join(self.folder, f"run-{self.name}-{len(self.files)}.npy")
        np.save(path, np.concatenate(parts))
        where = {k: (e - len(p), e) for k, p, e in zip(keys, parts, ends, strict=True)}
        self.files.append((np.load(path, mmap_mode="r"), where))
        self.near = {}
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray | None:
        """All items of this symbol, oldest first, or None."""
        parts = []
        for data, where in self.files:
            if (at := where.pop(symbol, None)) is not None:
                parts.append(np.array(data[at[0] : at[1]]))
        near = self.near.pop(symbol, None)
        if near is not None:
            own = [np.array(p, np.int64) if type(p) is list else p for p in near]
            self.held -= sum(map(len, own))
            parts += own
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes: smaller than their right neighbour. The last one is L, before the empty suffix."""
    n = len(t)
    s = np.zeros(n, bool)
    if n < 2:
        return s
    rising, level = t[:-1] < t[1:], t[:-1] == t[1:]
    s[:-1] = rising
    # Within a run of equal symbols the type is that of its last member.
    at = np.where(np.append(level, False), n, np.arange(n))
    last = np.minimum.accumulate(at[::-1])[::-1]
    return s[last]


def _dense(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rank of each item, from the sorted order and where a new value begins in it."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank


def names_of(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Dense ranks of the substrings from each leftmost S-type position to the next, symbols with types."""
    ends = np.append(lms[1:], len(t) - 1)
    sizes = ends - lms + 1
    bits = int(t.max()).bit_length() + 2
    per = max(1, 62 // bits)
    v = (t.astype(np.int64) << 1 | s) + 1
    rank, done = None, 0
    while True:
        # Pack the next ``per`` symbols of each substring; nothing stands beyond its end.
        live = np.arange(len(lms)) if rank is None else np.flatnonzero(sizes > done)
        if not len(live):
            return rank
        word = np.zeros(len(live), np.int64)
        for k in range(done, done + per):
            at = lms[live] + k
            word = word << bits | np.where(k < sizes[live], v[np.minimum(at, len(t) - 1)], 0)
        if rank is None:
            order = np.argsort(word, kind="stable")
            w = word[order]
            rank = _dense(order, np.append(True, w[1:] != w[:-1]))
        else:
            # Only substrings that go on are told further apart; a whole one has no equal that goes on.
            order = np.lexsort((word, rank[live]))
            r, w = rank[live][order], word[order]
            fresh = np.append(False, (r[1:] == r[:-1]) & (w[1:] != w[:-1]))
            if fresh.any():
                start = np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), np.arange(len(r)), 0))
                step = np.cumsum(fresh)
                fine = np.zeros(len(lms), np.int64)
                fine[live[order]] = step - step[start]
                both = np.lexsort((fine, rank))
                a, b = rank[both], fine[both]
                rank = _dense(both, np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        done += per


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of a text of dense names, in memory: ranks of twice as many names each round."""
    n = len(names)
    rank = names.astype(np.int64) + 1
    order = np.argsort(rank, kind="stable")
    # ranks leave room for the members of a group, so only groups are sorted again
    new = np.append(True, np.diff(rank[order]) > 0)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = first + 1
    k = 1
    while True:
        grouped = ~(new & np.append(new[1:], True))
        at = np.flatnonzero(grouped)
        if not len(at):
            return order
        own = order[at]
        after = np.where(own + k < n, rank[np.minimum(own + k, n - 1)], 0)
        key = rank[own] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        own, key = own[by], key[by]
        order[at] = own
        new[at] = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[own] = first[at] + 1
        k *= 2


def suffix_array(t: np.ndarray, folder: str | None = None, limit: int = LIMIT, base: int = BASE, work: Work | None = None) -> np.ndarray:
    """Starts of all suffixes of ``t`` (small non-negative integers) in ascending order, as a file in ``folder``. work: counts what was done."""
    work = work or Work()
    if folder is None:
        with tempfile.TemporaryDirectory(prefix="induced-") as made:
            return np.array(suffix_array(t, made, limit, base, work))
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms):
        names = names_of(t, s, lms)
        if len(lms) <= base:
            order = doubled(names)
        else:
            deeper = os.path.join(folder, "deeper")
            os.makedirs(deeper)
            work.recursions += 1
            order = suffix_array(names, deeper, limit, base, work)
        lms = lms[order]
    file = np.lib.format.open_memmap(os.path.join(folder, "sa.npy"), "w+", np.int64, (n,))
    sa = np.asarray(file)
    symbols, counts = np.unique(t, return_counts=True)
    bounds = dict(zip(symbols.tolist(), zip((np.cumsum(counts) - counts).tolist(), np.cumsum(counts).tolist(), strict=True), strict=True))
    # The sorted S-type seeds of each symbol.
    heads = t[lms]
    lows, highs = np.searchsorted(heads, symbols, "left"), np.searchsorted(heads, symbols, "right")
    seeds = {c: (a, b) for c, a, b in zip(symbols.tolist(), lows.tolist(), highs.tolist(), strict=True) if b > a}
    kinds, letters = s.tobytes(), memoryview(np.ascontiguousarray(t))

    def push_left(queue: DiskQueue, suffixes: np.ndarray, wanted: bool) -> None:
        """Push the left neighbours of that type."""
        if len(suffixes) <= FEW:
            for x in suffixes.tolist():
                if x and kinds[x - 1] == wanted:
                    queue.add(letters[x - 1], x - 1)
            return
        left = suffixes[suffixes > 0] - 1
        left = left[s[left] == wanted]
        queue.push(t[left].astype(np.int64), left)

    # Ascending scan: L-type suffixes. The last suffix comes first of its symbol, before all longer ones.
    queue = DiskQueue(folder, limit, "up", work)
    queue.add(int(t[n - 1]), n - 1)
    filled: dict[int, int] = {}
    for c in symbols.tolist():
        at = bounds[c][0]
        while (found := queue.pop(c)) is not None:
            sa[at : at + len(found)] = found
            at += len(found)
            push_left(queue, found, False)
        filled[c] = at
        if c in seeds:
            push_left(queue, lms[slice(*seeds[c])], False)
    # Descending scan: S-type suffixes, from all.
    queue = DiskQueue(folder, limit, "down", work)
    for c in symbols[::-1].tolist():
        at = bounds[c][1]
        while (found := queue.pop(c)) is not None:
            sa[at - len(found) : at] = found[::-1]
            at -= len(found)
            push_left(queue, found, True)
        push_left(queue, np.array(sa[bounds[c][0] : filled[c]])[::-1], True)
    return file

"""External induced sorting of suffixes with common-prefix values.

The sort follows the eSAIS scheme. Suffixes are of type S or L; those of the
leftmost S of each run (LMS) are sorted first, by naming their substrings and
recursing on the names until few are left; all others are induced from them: the
sorted suffixes are read in order, and each puts its left neighbour into a
priority queue as a tuple (symbol, position, common prefix with the tuple of the
same symbol before it). The queue's keys only rise (for S the alphabet is turned
round), so it is kept as one run of tuples for each range of symbols; a range is
read when it is due. Substrings are named by distributing them over the same
kind of ranges.

Common prefixes are carried: two neighbours induced from one bucket share one
symbol more than the least common prefix between the suffixes that induced them;
those from different buckets share the symbol alone. On the way up a recursion's
values, in names, become symbols by the positions of the names.

Buckets of a range are handled together as far as none puts a tuple into another
of them; the first that receives one ends such a batch. Ranges have about the
root of all suffixes, so a batch is rarely cut.

Everything that grows with the text (the text itself, types, names, queues, the
suffix arrays and common prefixes of every level) lies in files of the work
folder beyond `held` rows and is read in blocks of so many; a bucket larger than
that is streamed. In memory are a few blocks, the limits of the ranges and, for
one bucket or one pass of names at a time, its distinct neighbouring symbols.
Without a folder all stays in memory.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterable, Iterator

import numpy as np

I64 = np.int64
#: Names that a recursion sorts in memory rather than by inducing them.
BASE = 1 << 12
#: Rows that a queue, a tape or a block holds in memory.
HELD = 1 << 16


class Disk:
    """Arrays and rows in files of a folder; in memory without one."""

    def __init__(self, folder: str | None, held: int = HELD):
        self.folder, self.held = folder, max(1, held)
        self.written = 0  # files

    def path(self) -> str:
        self.written += 1
        return os.path.join(self.folder or "", uuid.uuid4().hex)

    def empty(self, n: int, dtype=I64) -> np.ndarray:
        if not self.folder or n <= self.held:
            return np.zeros(n, dtype)
        return np.memmap(self.path(), dtype, "w+", shape=(n,))

    def drop(self, *arrays: np.ndarray | None) -> None:
        """Removes the files of arrays, or of what they are views of; the space
        is given back when nobody refers to them any more."""
        for a in arrays:
            while isinstance(a, np.ndarray):
                if isinstance(a, np.memmap) and a.filename and os.path.exists(a.filename):
                    os.remove(a.filename)
                a = a.base

    def spans(self, n: int) -> Iterator[tuple[int, int]]:
        for a in range(0, n, self.held):
            yield a, min(n, a + self.held)


class Tape:
    """Rows that are appended, then read."""

    def __init__(self, disk: Disk, width: int):
        self.disk, self.width, self.size, self.saved = disk, width, 0, 0
        self.parts: list[np.ndarray] = []
        self.file: str | None = None

    def append(self, rows: np.ndarray) -> None:
        if len(rows):
            self.parts.append(rows)
            self.size += len(rows)
            if self.disk.folder and self.size - self.saved > self.disk.held:
                self._save()

    def _save(self) -> None:
        self.file = self.file or self.disk.path()
        with open(self.file, "ab") as f:
            for p in self.parts:
                f.write(np.ascontiguousarray(p, I64).tobytes())
        self.parts.clear()
        self.saved = self.size

    def rows(self) -> np.ndarray:
        if self.file:
            self._save()
            return np.memmap(self.file, I64, "r", shape=(self.size, self.width))
        return np.concatenate(self.parts).reshape(-1, self.width) if self.parts else np.zeros((0, self.width), I64)

    def free(self) -> None:
        self.parts.clear()
        if self.file:
            os.remove(self.file)


class Queue:
    """Rows by ranges of their first column, in the order they were put in.

    bounds has the least key of each range. Rows beyond `held` go to files, each
    a run that is ordered by range.
    """

    def __init__(self, disk: Disk, bounds: np.ndarray):
        self.disk, self.bounds, self.size = disk, bounds, 0
        self.parts: dict[int, list[np.ndarray]] = {}
        self.runs: list[tuple[str, dict[int, tuple[int, int]]]] = []

    def put(self, rows: np.ndarray) -> None:
        """rows that are sorted by key."""
        if not len(rows):
            return
        slot = np.searchsorted(self.bounds, rows[:, 0], "right") - 1
        cuts = (np.flatnonzero(slot[1:] != slot[:-1]) + 1).tolist()
        for s, a, b in zip(slot[[0, *cuts]].tolist(), [0, *cuts], [*cuts, len(rows)]):
            self.parts.setdefault(s, []).append(rows[a:b])
        self.size += len(rows)
        if self.disk.folder and self.size > self.disk.held:
            self._spill()

    def _spill(self) -> None:
        path, places, at = self.disk.path(), {}, 0
        with open(path, "wb") as f:
            for s in sorted(self.parts):
                rows = np.ascontiguousarray(np.concatenate(self.parts[s]), I64)
                f.write(rows.tobytes())
                places[s] = at, rows.size
                at += rows.size
                self.width = rows.shape[1]
        self.runs.append((path, places))
        self.parts.clear()
        self.size = 0

    def blocks(self, slot: int) -> Iterator[np.ndarray]:
        """The range's rows, in blocks; they are given once."""
        for path, places in self.runs:
            at, n = places.pop(slot, (0, 0))
            step = self.disk.held * getattr(self, "width", 1)
            for a in range(0, n, step):
                yield np.fromfile(path, I64, min(step, n - a), offset=8 * (at + a)).reshape(-1, self.width)
            if not places and os.path.exists(path):
                os.remove(path)
        parts = self.parts.pop(slot, [])
        self.size -= sum(map(len, parts))
        yield from parts

    def load(self, slot: int) -> np.ndarray | None:
        """The range's rows, sorted by key."""
        parts = list(self.blocks(slot))
        if not parts:
            return None
        rows = np.concatenate(parts)
        return rows[np.argsort(rows[:, 0], kind="stable")]

    def free(self) -> None:
        for path, _ in self.runs:
            if os.path.exists(path):
                os.remove(path)


def ranges(disk: Disk, counts: np.ndarray, most: int) -> np.ndarray:
    """Least keys of ranges with about `most` counts; a key of more has its own."""
    out, before, alone = [np.zeros(1, I64)], 0, True
    for a, b in disk.spans(len(counts)):
        c = np.asarray(counts[a:b])
        upto = before + np.cumsum(c)
        part, big = (upto - c) // most, c > most
        new = np.empty(len(c), bool)
        new[0] = big[0] or alone or (a > 0 and part[0] != last)
        new[1:] = (part[1:] != part[:-1]) | big[1:] | big[:-1]
        out.append(np.flatnonzero(new) + a)
        before, last, alone = int(upto[-1]), part[-1], bool(big[-1])
    return np.unique(np.concatenate(out))


def histogram(disk: Disk, values: Iterable[np.ndarray], size: int) -> np.ndarray:
    counts = disk.empty(size)
    for v in values:
        if isinstance(counts, np.memmap):
            keys, n = np.unique(v, return_counts=True)
            counts[keys] += n
        else:
            counts += np.bincount(v, minlength=size)
    return counts


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each pair, lo < hi."""
    span = hi - lo
    if not len(span):
        return span
    level = np.frexp(span.astype(np.float64))[1] - 1
    out = np.empty(len(span), I64)
    table, top = values, int(level.max())
    for k in range(top + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        if k < top:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


def types(disk: Disk, text: np.ndarray) -> np.ndarray:
    """True for suffixes of type S; the last suffix is one."""
    n = len(text)
    out = disk.empty(n, bool)
    out[n - 1] = True
    for a, b in reversed(list(disk.spans(n - 1))):
        step = np.sign(np.diff(text[a : b + 1]))
        at = np.where(step != 0, np.arange(len(step)), len(step))
        nearest = np.minimum.accumulate(at[::-1])[::-1]
        real = nearest < len(step)
        kinds = np.full(b - a, out[b])
        kinds[real] = step[nearest[real]] > 0
        out[a:b] = kinds
    return out


def leftmost(disk: Disk, kinds: np.ndarray) -> np.ndarray:
    """Positions of the leftmost S of each run, but for the first suffix."""
    tape = Tape(disk, 1)
    for a, b in disk.spans(len(kinds) - 1):
        own = kinds[a : b + 1]
        tape.append((np.flatnonzero(own[1:] & ~own[:-1]) + a + 1)[:, None])
    return tape.rows()[:, 0]


def named(text: np.ndarray, at: np.ndarray, ends: np.ndarray, off: int) -> tuple[np.ndarray, int]:
    """Dense ranks of substrings at:ends (inclusive), of which `off` symbols are
    known equal, and how many differ."""
    rank = np.zeros(len(at), I64)
    live = np.arange(len(at))
    while len(live):
        more = at[live] + off <= ends[live]
        # one that ended did so in an S symbol, one that goes on has the lesser L symbol there
        key = np.where(more, text[np.minimum(at[live] + off, len(text) - 1)].astype(I64), np.iinfo(I64).max)
        order = np.lexsort((key, rank[live]))
        r, k = rank[live][order], key[order]
        fresh = np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
        start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        base = np.repeat(start, np.diff(np.append(start, len(r))))
        # a new rank is the old one plus the elements of its class that come before
        where = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
        rank[live[order]] = r + (where - base)
        size = np.diff(np.append(np.flatnonzero(fresh), len(r)))
        again = np.repeat(size > 1, size)
        keep = np.zeros(len(live), bool)
        keep[order] = again
        live = live[keep & more]
        off += 1
    return _dense(rank)


def names(disk: Disk, text: np.ndarray, lms: np.ndarray, symbols: int) -> tuple[np.ndarray, int]:
    """The name of each LMS substring, in order and dense, and how many there are."""
    m, out = len(lms), disk.empty(len(lms))

    def ends(i: np.ndarray) -> np.ndarray:  # a substring reaches to the next LMS symbol
        return np.where(i + 1 < m, lms[np.minimum(i + 1, m - 1)], len(text) - 1)

    def name(blocks: Iterable[np.ndarray], size: int, off: int, base: int) -> int:
        if size <= disk.held or not disk.folder:
            i = np.concatenate(list(blocks))
            rank, many = named(text, lms[i], ends(i), off)
            out[i] = rank + base
            return many
        tape = Tape(disk, 2)
        for i in blocks:
            at = lms[i] + off
            tape.append(np.column_stack([np.where(at <= ends(i), text[np.minimum(at, len(text) - 1)], symbols), i]))
        rows, many = tape.rows(), 0
        counts = histogram(disk, (np.asarray(rows[a:b, 0]) for a, b in disk.spans(size)), symbols + 1)
        queue = Queue(disk, ranges(disk, counts, max(1, disk.held // 2)))
        for a, b in disk.spans(size):
            part = np.asarray(rows[a:b])
            queue.put(part[np.argsort(part[:, 0], kind="stable")])
        tape.free()
        for slot, low in enumerate(queue.bounds.tolist()):
            high = int(queue.bounds[slot + 1]) if slot + 1 < len(queue.bounds) else symbols + 1
            own = int(counts[low:high].sum()) if high - low < disk.held else sum(int(counts[low + a : low + b].sum()) for a, b in disk.spans(high - low))
            if not own:
                continue
            mine = (r[:, 1] for r in queue.blocks(slot))
            if low == symbols:  # all of these have ended, and are equal
                for i in mine:
                    out[i] = base + many
                many += 1
            else:  # one symbol is known; several may differ in it
                many += name(mine, own, off + (high - low == 1), base + many)
        queue.free()
        return many

    return out, name((np.arange(a, b) for a, b in disk.spans(m)), m, 0, 0)


def _dense(rank: np.ndarray) -> tuple[np.ndarray, int]:
    values, out = np.unique(rank, return_inverse=True)
    return out.astype(I64), len(values)


def _extend(text: np.ndarray, a: np.ndarray, b: np.ndarray, got: np.ndarray) -> np.ndarray:
    """Common prefixes of suffix pairs, of which `got` symbols are known equal."""
    out, live = got.copy(), np.arange(len(a))
    n = len(text)
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        live = live[ok]
        out[live] += 1
    return out


def doubled(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by prefix doubling, for a recursion of few names. The ranks of
    each round give the common prefixes."""
    names = np.asarray(names)
    n, rank, ranks = len(names), names, [names]
    while int(rank.max()) < n - 1:
        step = 1 << len(ranks) - 1
        after = np.zeros(n, I64)
        after[: n - step] = rank[step:] + 1
        rank = _dense(rank * (n + 1) + after)[0]
        ranks.append(rank)
    order = np.argsort(rank)
    a, b, got = order[:-1], order[1:], np.zeros(n - 1, I64)
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + got, b + got
        ok = (x < n) & (y < n)
        ok[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        got[ok] += 1 << k
    return order, np.concatenate([[0], got])


def sort(text: np.ndarray, folder: str | None = None, held: int = HELD, base: int = BASE, note: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of text and, for each entry, the symbols that it shares with
    the entry before. The last symbol of text must be less than all others. With
    a folder the results are arrays in files there, which the caller removes.
    note: gets the depth of the recursion and the number of files."""
    disk = Disk(folder, held)
    note = {} if note is None else note
    note |= {"levels": 0}
    out = _sort(text, disk, base, note)
    return out if note.update(files=disk.written) is None else out


def _sort(text: np.ndarray, disk: Disk, base: int, note: dict) -> tuple[np.ndarray, np.ndarray]:
    n = len(text)
    note["levels"] += 1
    if n < 2:
        return np.arange(n), np.zeros(n, I64)
    symbols = 1 + max(int(text[a:b].max()) for a, b in disk.spans(n))
    kinds = types(disk, text)
    lms = leftmost(disk, kinds)
    m = len(lms)
    name, distinct = names(disk, text, lms, symbols)
    if distinct == m:
        order, common = disk.empty(m), None
        for a, b in disk.spans(m):
            order[name[a:b]] = np.arange(a, b)
    elif m <= base:
        order, common = doubled(name)
    else:
        # names of the recursion end with that of the last LMS, which is least
        order, common = _sort(name, disk, base, note)
    first = Tape(disk, 3)
    for a, b in disk.spans(m):
        i = np.asarray(order[max(0, a - 1) : b])
        at = lms[i]
        shared = np.zeros(len(i), I64)
        if len(i) > 1:
            # names in common become symbols by where they end
            q = np.asarray(common[max(0, a - 1) + 1 : b]) if common is not None else np.zeros(len(i) - 1, I64)
            end = i[:-1] + q
            known = np.where(q > 0, np.where(end < m, lms[np.minimum(end, m - 1)], n) - at[:-1], 0)
            shared[1:] = _extend(text, at[:-1], at[1:], known)
        first.append(np.column_stack([text[at], at, shared])[1 if a else 0 :])
    disk.drop(order, common, name, lms)
    counts = histogram(disk, (np.asarray(text[a:b]) for a, b in disk.spans(n)), symbols)
    bounds = ranges(disk, counts, max(1, min(disk.held // 2, max(64, int(n**0.5)))))
    disk.drop(counts)
    del order, common, name, counts, lms
    level = Level(text, kinds, symbols, disk, bounds)
    l_type = level.induce(first.rows(), False)
    first.free()
    out = level.induce(l_type.rows(), True)
    l_type.free()
    disk.drop(kinds)
    out.append(np.zeros((1, 3), I64))
    rows = out.rows()
    # an entry's common prefix is with the one above it, which becomes the one after it
    return rows[:n, 1][::-1], rows[:, 2][::-1][:n]


class Level:
    """The inducing of one level of the recursion."""

    def __init__(self, text: np.ndarray, kinds: np.ndarray, symbols: int, disk: Disk, bounds: np.ndarray):
        self.text, self.kinds, self.symbols, self.disk, self.rising = text, kinds, symbols, disk, bounds

    def induce(self, rows: np.ndarray, falling: bool) -> Tape:
        """From sorted LMS suffixes the L ones, or, falling, from these all, last
        first: key (the symbol, turned round if falling), position, common prefix
        with the entry before. rows: (symbol, position, common prefix)."""
        self.want, self.falling = falling, falling
        self.bounds = self.symbols - np.append(self.rising[1:], self.symbols)[::-1] if falling else self.rising
        self.second = rows
        self.queue, self.out = Queue(self.disk, self.bounds), Tape(self.disk, 3)
        if falling:  # the last suffix is an S one that nothing induces
            n = len(self.text)
            self.queue.put(np.array([[self.symbols - 1 - int(self.text[n - 1]), n - 1, 0]], I64))
        for slot, low in enumerate(self.bounds.tolist()):
            high = int(self.bounds[slot + 1]) if slot + 1 < len(self.bounds) else self.symbols
            self.late: list[np.ndarray] = []
            a, b = self._below(low), self._below(high)
            if high - low == 1:
                self._bucket(low, self.queue.blocks(slot), ((x, min(b, x + self.disk.held)) for x in range(a, b, self.disk.held)), high)
            else:
                self._range(slot, a, b, high)
        self.queue.free()
        self.second = None
        return self.out

    def _below(self, key: int) -> int:
        """How many rows of the second part have a lesser key."""
        if self.falling:
            return len(self.second) - int(np.searchsorted(self.second[:, 0], self.symbols - key))
        return int(np.searchsorted(self.second[:, 0], key))

    def _second(self, a: int, b: int) -> np.ndarray:
        if not self.falling:
            return np.asarray(self.second[a:b])
        m = len(self.second)
        own = np.array(self.second[m - b : m - a][::-1])
        own[:, 0] = self.symbols - 1 - own[:, 0]
        above = np.zeros(len(own), I64)  # the common prefix is with the entry that now comes before
        top = np.asarray(self.second[m - b + 1 : m - a + 1, 2][::-1])
        above[len(own) - len(top) :] = top
        own[:, 2] = above
        return own

    def _lefts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which entries induce a left neighbour, and its key."""
        src = np.flatnonzero(at > 0)
        src = src[self.kinds[at[src] - 1] == self.want]
        sym = self.text[at[src] - 1].astype(I64)
        return src, self.symbols - 1 - sym if self.falling else sym

    def _put(self, at: np.ndarray, lcp: np.ndarray, src: np.ndarray, key: np.ndarray, high: int, carry: dict | None = None) -> None:
        if not len(src):
            return
        order = np.argsort(key, kind="stable")
        key, src = key[order], src[order]
        shared = np.zeros(len(key), I64)
        pair = np.flatnonzero(key[1:] == key[:-1]) + 1
        if len(pair):
            shared[pair] = range_min(lcp, src[pair - 1] + 1, src[pair] + 1)
        if carry is not None:
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            if carry:
                known = np.searchsorted(carry["key"], key[head])
                seen = (known < len(carry["key"])) & (carry["key"][np.minimum(known, len(carry["key"]) - 1)] == key[head])
                upto = np.minimum.accumulate(lcp)
                shared[head[seen]] = np.minimum(carry["least"][known[seen]], upto[src[head[seen]]])
            tail = np.append(head[1:], len(key)) - 1
            back = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.iinfo(I64).max)
            fresh_key, fresh = key[head], back[src[tail] + 1]
            if carry:
                old = ~np.isin(carry["key"], fresh_key, assume_unique=True)
                fresh_key, fresh = np.append(fresh_key, carry["key"][old]), np.append(fresh, np.minimum(carry["least"][old], back[0]))
                o = np.argsort(fresh_key)
                fresh_key, fresh = fresh_key[o], fresh[o]
            carry |= {"key": fresh_key, "least": fresh}
        rows = np.column_stack([key, at[src] - 1, shared])
        own = int(np.searchsorted(key, high))
        if own:
            self.late.append(rows[:own])
        self.queue.put(rows[own:])

    def _range(self, slot: int, a: int, b: int, high: int) -> None:
        """The buckets of a range that fits into memory."""
        none = np.zeros((0, 3), I64)
        first, second = self.queue.load(slot), self._second(a, b)
        first = none if first is None else first
        while True:
            if self.late:
                first = np.concatenate([first, *self.late])
                first = first[np.argsort(first[:, 0], kind="stable")]
                self.late = []
            if not len(first) and not len(second):
                return
            rows = np.concatenate([first, second])
            order = np.argsort(rows[:, 0], kind="stable")
            rows, induced = rows[order], order < len(first)
            key, at = rows[:, 0], rows[:, 1]
            lcp = rows[:, 2] + induced
            same = key[1:] == key[:-1]
            lcp[0] = 0
            lcp[1:][~same] = 0
            lcp[1:][same & induced[:-1] & ~induced[1:]] = 1  # their runs of the symbol differ, and one is of length 1
            src, left = self._lefts(at)
            inside = left[left < high]
            stop = int(inside.min()) if len(inside) else high
            ready = int(np.searchsorted(key, stop))
            if ready:
                done = int(np.searchsorted(src, ready))
                self._put(at[:ready], lcp[:ready], src[:done], left[:done], high)
                out = np.column_stack([key[:ready], at[:ready], lcp[:ready]])
                self.out.append(out if self.falling else out[induced[:ready]])
            else:
                ready = int(np.searchsorted(key, stop + 1))
                n = int(induced[:ready].sum())
                self._bucket(stop, [rows[:n]] if n else [], [rows[n:ready]] if ready > n else [], high)
            first, second = rows[ready:][induced[ready:]], rows[ready:][~induced[ready:]]

    def _bucket(self, c: int, first: Iterable[np.ndarray], second: Iterable, high: int) -> None:
        """One bucket, block by block: the tuples that others put in, then those
        that it induces itself, by the length of their run of c, then the second
        part."""
        carry: dict = {}
        begun, run = False, 0

        def give(at: np.ndarray, lcp: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
            src, left = self._lefts(at)
            other = left != c
            self._put(at, lcp, src[other], left[other], high, carry)
            if not len(src[other]) and carry:
                carry["least"] = np.minimum(carry["least"], lcp.min())
            if own or self.falling:
                self.out.append(np.column_stack([np.full(len(at), c), at, lcp]))
            return src[~other], at

        blocks: Iterable[tuple[np.ndarray, np.ndarray]] = ((r[:, 1], r[:, 2] + 1) for r in first if len(r))
        tape = None
        while True:
            grown, least, met = Tape(self.disk, 2), 0, False
            for at, lcp in blocks:
                lcp = np.array(lcp)
                if not begun:
                    lcp[0], begun = 0, True
                src, _ = give(np.asarray(at), lcp, True)
                if len(src):
                    new = np.empty(len(src), I64)
                    # the run of the generation before is one shorter
                    new[0] = min(least, int(lcp[: src[0] + 1].min())) + 1 if met else run + 1
                    new[1:] = 1 + range_min(lcp, src[:-1] + 1, src[1:] + 1)
                    grown.append(np.column_stack([at[src] - 1, new]))
                    met, least = True, int(lcp[src[-1] + 1 :].min(initial=np.iinfo(I64).max))
                else:
                    least = min(least, int(lcp.min()))
            if tape is not None:
                tape.free()
            run += begun
            if not grown.size:
                break
            tape, rows = grown, grown.rows()
            blocks = ((rows[a:b, 0], rows[a:b, 1]) for a, b in self.disk.spans(grown.size))
        for part in second:
            rows = self._second(*part) if isinstance(part, tuple) else part
            lcp = np.array(rows[:, 2])
            if run >= 0:
                lcp[0] = min(run, self._run(int(rows[0, 1]), c, run)) if begun else 0
                run = -1
            give(rows[:, 1], lcp, False)

    def _run(self, at: int, c: int, most: int) -> int:
        """How many times the bucket's symbol stands at a position, `most` at most."""
        sym = self.symbols - 1 - c if self.falling else c
        own = np.asarray(self.text[at : at + most]) == sym
        return len(own) if own.all() else int(np.argmin(own))


def ranked(disk: Disk, values: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Dense ranks of any int64 values, how many differ, and whether each occurs
    again; by distributing them over ranges of their leading bits."""
    n = len(values)
    rank, again = disk.empty(n), disk.empty(n, bool)
    if not disk.folder or n <= disk.held:
        distinct, inverse, counts = np.unique(np.asarray(values), return_inverse=True, return_counts=True)
        rank[:], again[:] = inverse, counts[inverse] > 1
        return rank, len(distinct), again
    slots = min(1 << 16, 4 * -(-n // disk.held))  # values are hashes, spread evenly; a repeated one is streamed as part of its range
    queue = Queue(disk, np.arange(slots, dtype=I64))
    for a, b in disk.spans(n):
        v = np.asarray(values[a:b])
        slot = (((v.view(np.uint64) >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(I64)
        order = np.argsort(slot, kind="stable")
        queue.put(np.column_stack([slot[order], v[order], order + a]))
    many = 0
    for slot in range(slots):
        blocks = Tape(disk, 2)
        keys, counts = np.zeros(0, I64), np.zeros(0, I64)
        for r in queue.blocks(slot):
            blocks.append(r[:, 1:])
            k, c = np.unique(r[:, 1], return_counts=True)
            merged, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([counts, c]), len(merged)).astype(I64)
            keys = merged
        if blocks.size:
            rows = blocks.rows()
            for a, b in disk.spans(blocks.size):
                at = np.searchsorted(keys, rows[a:b, 0])
                rank[rows[a:b, 1]], again[rows[a:b, 1]] = at + many, counts[at] > 1
        blocks.free()
        many += len(keys)
    queue.free()
    return rank, many, again


def remove(folder: str) -> None:
    shutil.rmtree(folder, ignore_errors=True)

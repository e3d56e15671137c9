"""Suffix arrays with common-prefix values by external induced sorting, in memory that doesn't grow with the text.

The text, its leftmost-S suffixes, all queues and the result are files; at most about ``budget`` entries of
each are in memory at once (some 300 bytes an entry in all). One level does this:

1. A backward scan finds the leftmost-S suffixes (seeds). Their substrings, up to the next seed, are sorted by
   distribution on packed characters and named in order; the names in text order are the next level's text.
2. The next level is sorted in the same way, recursively, until a text fits the budget. Its result puts the seeds
   in order. The prefix two seeds share follows from the number of names they share.
3. Two passes induce all other suffixes. Each takes suffixes from a monotone priority queue on disk whose keys are
   ranges of first characters: what a suffix induces goes behind in its own range or to a later one. A queue entry is a
   tuple of position, least common prefix since the range's entry before (of the suffixes that induced them), and
   first character. A range of one character is streamed first in, first out; a range of several holds few enough
   entries to be ordered in memory as a whole, chains within it by pointer doubling.

Only the first ``cap`` characters count: suffixes that agree in them stand in any order among themselves, and
prefix lengths stop there. So a level needs half the depth of the one below.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from itertools import count

import numpy as np

BLOCK = 1 << 16


class Column:
    """An array on disk: appended to at the end, read anywhere, a block of positions at a time."""

    def __init__(self, folder: str, dtype):
        self.path = os.path.join(folder, uuid.uuid4().hex)
        self.dtype, self.n = np.dtype(dtype), 0
        self.file = open(self.path, "wb+", buffering=1 << 18)
        self.dirty = False

    def append(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.dtype).data)
        self.n += len(values)
        self.dirty = True

    def read(self, a: int, b: int) -> np.ndarray:
        if self.dirty:
            self.file.flush()
            self.dirty = False
        a, b = max(a, 0), min(b, self.n)
        size = self.dtype.itemsize
        return np.frombuffer(os.pread(self.file.fileno(), max(b - a, 0) * size, a * size), self.dtype)

    def take(self, at: np.ndarray, width: int = 0) -> np.ndarray:
        """Values at the positions; with ``width``, rows of as many values from each on, 0 behind the end."""
        out = np.zeros((len(at), width) if width else len(at), self.dtype)
        if not len(at):
            return out
        order = np.argsort(at)
        at = at[order]
        lo = int(at[0]) // BLOCK
        cuts = np.searchsorted(at, np.arange(lo, int(at[-1]) // BLOCK + 2) * BLOCK)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if j > i:
                a, b = int(at[i]), int(at[j - 1]) + max(width, 1)
                part = self.read(a, b)
                if width:
                    if b > self.n:
                        part = np.concatenate((part, np.zeros(b - a - len(part), self.dtype)))
                    out[order[i:j]] = np.lib.stride_tricks.sliding_window_view(part, width)[at[i:j] - a]
                else:
                    out[order[i:j]] = part[at[i:j] - a]
        return out

    def drop(self) -> None:
        if not self.file.closed:
            self.file.close()
            os.remove(self.path)


class Queue:
    """First-in-first-out records by key. What is pending goes to a file for each key when it exceeds ``budget``."""

    spilled = 0  # entries that any queue of this process wrote to a file

    def __init__(self, folder: str, budget: int):
        self.path, self.budget = os.path.join(folder, uuid.uuid4().hex), budget
        self.parts: dict[int, list] = {}
        self.filed: dict[int, list[int]] = {}  # [bytes taken, bytes written]
        self.total = 0

    def push(self, key: int, record: np.ndarray) -> None:
        self.parts.setdefault(key, []).append(record)
        self.total += len(record)
        if self.total > self.budget:
            for k, parts in self.parts.items():
                with open(f"{self.path}-{k}", "ab") as f:
                    for part in parts:
                        f.write(np.ascontiguousarray(part).data)
                        self.filed.setdefault(k, [0, 0])[1] += part.nbytes
            Queue.spilled += self.total
            self.parts, self.total = {}, 0

    def pop(self, key: int, limit: int, dtype) -> np.ndarray | None:
        """The key's oldest records, at most ``limit``, or None."""
        if key in self.filed:
            a, b = self.filed[key]
            n = min(limit, (b - a) // dtype.itemsize)
            with open(f"{self.path}-{key}", "rb") as f:
                f.seek(a)
                out = np.frombuffer(f.read(n * dtype.itemsize), dtype)
            self.filed[key][0] = a = a + out.nbytes
            if a == b:
                os.remove(f"{self.path}-{key}")
                del self.filed[key]
            return out
        parts = self.parts.get(key)
        if not parts:
            return None
        taken, n = [], 0
        while parts and n < limit:
            part = parts.pop(0)
            if len(part) > limit - n:
                parts.insert(0, part[limit - n :])
                part = part[: limit - n]
            taken.append(part)
            n += len(part)
        if not parts:
            del self.parts[key]
        self.total -= n
        return np.concatenate(taken) if len(taken) > 1 else taken[0]

    def size(self, key: int, dtype) -> int:
        a, b = self.filed.get(key, (0, 0))
        return (b - a) // dtype.itemsize + sum(map(len, self.parts.get(key, ())))


def least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of values[a + 1 .. b] for each pair a < b, from a table of minima over powers of two."""
    widest = int((b - a).max())
    levels = [values]
    while 2 << (len(levels) - 1) <= widest:
        step = 1 << (len(levels) - 1)
        now = levels[-1].copy()
        np.minimum(now[:-step], levels[-1][step:], out=now[:-step])
        levels.append(now)
    level = (np.frexp(b - a)[1] - 1).astype(np.int64)
    table = np.stack(levels)
    return np.minimum(table[level, a + 1], table[level, b + 1 - (1 << level)])


def starts_of(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


class Level:
    """A text on disk, with what sorting it needs. ``high``: one more than the largest character."""

    def __init__(self, text: Column, high: int, cap: int, folder: str, budget: int):
        self.text, self.n, self.high, self.cap, self.folder, self.budget = text, text.n, high, cap, folder, budget
        self.step = max(budget // 4, 1)
        self.place = np.dtype("<u4" if self.n < 1 << 32 else "<u8")
        self.one = np.dtype([("p", self.place), ("g", "u1")])
        self.many = np.dtype([("p", self.place), ("g", "u1"), ("s", "<u4")])
        self.bits = (high + 1).bit_length()
        self.per = 63 // self.bits  # characters in a packed word

    # ------------------------------------------------------------ seeds

    def find_seeds(self) -> Column:
        """Positions of the leftmost-S suffixes, in order: a backward scan finds them block by block."""
        parts, edges = [], list(range(0, self.n, self.step)) or [0]
        backward = Column(self.folder, self.place)
        later = None  # is the suffix behind the block of type S?
        for a in reversed(edges):
            b = min(a + self.step, self.n)
            chars = self.text.read(a, b + 1)
            if b == self.n:  # the last suffix is L: the empty one is smaller
                s_last, body = False, chars
            else:
                body = chars[:-1]
                s_last = bool(chars[-2] < chars[-1]) if chars[-2] != chars[-1] else later
            n = len(body)
            change = np.flatnonzero(body[1:] != body[:-1])
            up = np.append(body[change] < body[change + 1], s_last)
            s = np.repeat(up, np.diff(np.concatenate(([-1], change, [n - 1]))))
            found = np.flatnonzero(s[1:] & ~s[:-1]) + 1 + a
            # the block's first suffix is a seed if the one before the block is L
            if a and s[0] and self.text.read(a - 1, a)[0] > body[0]:
                found = np.concatenate(([a], found))
            backward.append(found[::-1])
            later = bool(s[0])
        seeds = Column(self.folder, self.place)
        for b in range(backward.n, 0, -self.step):
            seeds.append(backward.read(b - self.step, b)[::-1])
        backward.drop()
        return seeds

    def words(self, at: np.ndarray, size: np.ndarray, last: np.ndarray, w: int) -> np.ndarray:
        """Packed word ``w`` of substrings: characters plus one, behind them a mark that is larger than all (0 behind the text's end)."""
        rows = self.text.take(at + w * self.per, self.per)
        out = np.zeros(len(at), np.uint64)
        for j in range(self.per):
            k = w * self.per + j
            char = np.where(k < size, rows[:, j].astype(np.uint64) + np.uint64(1), np.where((k == size) & ~last, np.uint64(self.high + 1), np.uint64(0)))
            out = (out << np.uint64(self.bits)) | char
        return out

    def name(self, seeds: Column) -> tuple[Column, Column]:
        """(names of the seeds' substrings in text order, how many seeds each name has)."""
        record = np.dtype([("i", self.place), ("p", self.place), ("z", self.place), ("k", "<u8")])
        deepest = -(-(self.cap + 2) // self.per)
        queue = Queue(self.folder, self.step)

        def keyed(i, at, size, w):
            out = np.empty(len(i), record)
            out["i"], out["p"], out["z"] = i, at, size
            out["k"] = self.words(at.astype(np.int64), size.astype(np.int64), i == seeds.n - 1, w)
            return out

        fresh = count()

        def deal(batches):
            """Spreads records over parts of about ``step`` by sampled splitters; returns the parts in order."""
            splits = None
            sizes: dict[int, int] = {}
            for rows, sample, n in batches:
                if splits is None:
                    cut = np.sort(sample)
                    parts = max(2, 2 * n // self.step)
                    splits = np.unique(cut[np.linspace(0, len(cut) - 1, min(parts, len(cut))).astype(int)])
                    ids = [next(fresh) for _ in range(2 * len(splits) + 1)]
                at = np.searchsorted(splits, rows["k"], "left") + np.searchsorted(splits, rows["k"], "right")  # a splitter has a part of its own
                order = np.argsort(at, kind="stable")
                head = starts_of(at[order])
                for a, b in zip(head.tolist(), [*head[1:].tolist(), len(order)]):
                    part = ids[at[order[a]]]
                    queue.push(part, rows[order[a:b]])
                    sizes[part] = sizes.get(part, 0) + b - a
            return sorted(sizes)

        def first_words():
            probe = np.unique(np.linspace(0, seeds.n - 1, min(seeds.n, 4096)).astype(np.int64))
            ends = np.where(probe + 1 < seeds.n, seeds.take(np.minimum(probe + 1, seeds.n - 1)).astype(np.int64), self.n - 1)
            at = seeds.take(probe).astype(np.int64)
            sample = self.words(at, ends - at + 1, probe == seeds.n - 1, 0)
            for a in range(0, seeds.n, self.step):
                at = seeds.read(a, a + self.step + 1).astype(np.int64)
                end = at[1:] if len(at) > self.step else np.append(at[1:], self.n - 1)
                at = at[: self.step]
                yield keyed(np.arange(a, a + len(at)), at, end - at + 1, 0), sample, seeds.n

        def in_order(part: int, w: int):
            """(seed numbers, whether a substring differs from the one before) of a part whose words before ``w`` agree."""
            n = queue.size(part, record)
            if n <= 2 * self.step:
                rows = queue.pop(part, n, record)
                while (more := queue.pop(part, n, record)) is not None:
                    rows = np.concatenate((rows, more))
                yield self._sorted(rows, w, deepest, seeds.n)
                return
            sample = queue.pop(part, self.step, record)
            low, high = sample["k"].min(), sample["k"].max()
            rest = lambda: queue.pop(part, self.step, record)
            some = lambda rows: rows["k"][:: max(1, len(rows) // 4096)]
            if low != high or not self._single(part, queue, record, low):
                for p in deal((x, some(sample), n) for x in _chain(sample, rest)):
                    yield from in_order(p, w)
                return
            done = self.per * (w + 1) > int(sample["z"].min()) or w + 1 >= deepest
            if done:  # words are equal and hold the end: all substrings are equal
                new = True
                for rows in _chain(sample, rest):
                    flags = np.zeros(len(rows), bool)
                    flags[0], new = new, False
                    yield rows["i"].astype(np.int64), flags
                return
            deeper = (keyed(x["i"], x["p"].astype(np.int64), x["z"].astype(np.int64), w + 1) for x in _chain(sample, rest))
            first = next(deeper)
            for p in deal((x, some(first), n) for x in _chain(first, lambda: next(deeper, None))):
                yield from in_order(p, w + 1)

        counts, numbered = Column(self.folder, "<u4"), Queue(self.folder, self.step)
        pair = np.dtype([("i", self.place), ("s", "<u4")])
        name, open_count = -1, 0
        for part in deal(first_words()):
            for i, new in in_order(part, 0):
                names = name + np.cumsum(new)
                head = np.flatnonzero(new)
                if len(head):
                    tally = np.diff(np.append(head, len(i)))
                    if name >= 0:
                        counts.append(np.array([open_count + head[0]]))
                    counts.append(tally[:-1])
                    open_count = int(tally[-1])
                else:
                    open_count += len(i)
                name = int(names[-1])
                rows = np.empty(len(i), pair)
                rows["i"], rows["s"] = i, names
                where = i // self.step
                order = np.argsort(where, kind="stable")
                cut = starts_of(where[order])
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
                    numbered.push(int(where[order[a]]), rows[order[a:b]])
        counts.append(np.array([open_count]))
        names = Column(self.folder, "<u4")
        for a in range(0, seeds.n, self.step):
            out = np.zeros(min(self.step, seeds.n - a), np.uint32)
            while (rows := numbered.pop(a // self.step, self.step, pair)) is not None:
                out[rows["i"].astype(np.int64) - a] = rows["s"]
            names.append(out)
        return names, counts

    def _single(self, part: int, queue: Queue, record, value) -> bool:
        """Whether all words of the part are ``value``. What is read goes back behind."""
        n, same = queue.size(part, record), True
        seen = 0
        while seen < n:
            rows = queue.pop(part, min(self.step, n - seen), record)
            same &= bool((rows["k"] == value).all())
            seen += len(rows)
            queue.push(part, rows)
        return same

    def _sorted(self, rows: np.ndarray, w: int, deepest: int, n_seeds: int):
        """Seed numbers in order of their substrings, and where a substring differs from the one before."""
        order = np.argsort(rows["k"], kind="stable")
        rows = rows[order]
        new = np.concatenate(([True], rows["k"][1:] != rows["k"][:-1]))
        while (w := w + 1) < deepest:
            tied = ~new
            tied[:-1] |= ~new[1:]
            tied &= rows["z"] >= self.per * w
            at = np.flatnonzero(tied)
            if not len(at):
                break
            key = self.words(rows["p"][at].astype(np.int64), rows["z"][at].astype(np.int64), rows["i"][at] == n_seeds - 1, w)
            group = np.cumsum(new)[at]
            by = np.lexsort((key, group))
            rows[at] = rows[at[by]]
            key = key[by]
            # rows of one group stand side by side, whether all of it goes on or none
            new[at[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
        return rows["i"].astype(np.int64), new

    # ------------------------------------------------------------ induction

    def cut_ranges(self, counts: Column | None) -> None:
        """``low``: the first character of each range; ``single``: whether a range is streamed as one character."""
        if counts is None:
            self.low, self.single = np.arange(self.high), np.ones(self.high, bool)
            return
        low, before, heavy_before = [], 0, True
        for a in range(0, counts.n, self.step):
            count = counts.read(a, a + self.step).astype(np.int64)
            heavy = count > self.step
            slot = (before + np.cumsum(count) - count) // self.step
            cut = heavy | np.concatenate(([heavy_before], heavy[:-1]))
            cut[1:] |= slot[1:] != slot[:-1]
            cut[0] |= not low or slot[0] != self._slot
            low.append(np.stack([np.flatnonzero(cut) + a, heavy[cut]], 1))
            before, heavy_before, self._slot = before + int(count.sum()), bool(heavy[-1]), int(slot[-1])
        both = np.concatenate(low)
        self.low, self.single = both[:, 0], both[:, 1].astype(bool)

    def range_of(self, chars: np.ndarray) -> np.ndarray:
        return chars.astype(np.int64) if len(self.low) == self.high else np.searchsorted(self.low, chars, "right") - 1

    def run(self, at: np.ndarray) -> np.ndarray:
        """How often the character at each position repeats from there, up to ``cap``."""
        first, out = self.text.take(at), np.ones(len(at), np.int64)
        alive = np.arange(len(at))
        while len(alive):
            alive = alive[(at[alive] + out[alive] < self.n) & (out[alive] < self.cap)]
            alive = alive[self.text.take(at[alive] + out[alive]) == first[alive]]
            out[alive] += 1
        return out

    def before(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(character before each position as int64, whether there is one)."""
        ok = at > 0
        return self.text.take(np.maximum(at - 1, 0)).astype(np.int64), ok

    def induce(self, seeds: "Sorted", emit) -> None:
        """Calls ``emit(positions, lcp)`` with all suffixes in falling order; lcp is with the one before, which is larger."""
        n_ranges = len(self.low)
        larges = Sorted(self.folder, self.place)
        n_large = np.zeros(n_ranges, np.int64)
        down = _Pass(self, 1)
        start = np.array([self.n - 1])
        down.send(start, self.text.take(start).astype(np.int64), np.zeros(1, np.uint8))  # induced by the empty suffix
        at = 0
        for r in range(n_ranges):
            n_seeds = int(seeds.count[r])

            def take(pos, lcp, kind):
                if kind < 2:
                    larges.append(pos, lcp)
                    n_large[r] += len(pos)

            down.range(r, lambda a, b, at=at: seeds.rising(at + a, at + b), n_seeds, take)
            at += n_seeds
        seeds.drop()
        up = _Pass(self, -1)
        at = larges.n
        for r in range(n_ranges - 1, -1, -1):
            at -= int(n_large[r])
            end = at + int(n_large[r])
            up.range(r, lambda a, b, end=end, at=at: larges.falling(end - b, end - a, end), int(n_large[r]), lambda pos, lcp, kind: emit(pos, lcp))
        larges.drop()


def _chain(first, more):
    while first is not None:
        yield first
        first = more()


class Sorted:
    """Positions in order with the prefix each shares with the one before; ``count``: how many are in each range."""

    def __init__(self, folder: str, place):
        self.pos, self.lcp, self.count = Column(folder, place), Column(folder, "u1"), None

    @property
    def n(self) -> int:
        return self.pos.n

    def append(self, pos, lcp) -> None:
        self.pos.append(pos)
        self.lcp.append(lcp)

    def rising(self, a: int, b: int):
        return self.pos.read(a, b).astype(np.int64), self.lcp.read(a, b)

    def falling(self, a: int, b: int, end: int):
        """Entries b - 1 down to a, each with the prefix it shares with the entry above (0 at ``end``)."""
        lcp = self.lcp.read(a + 1, b + 1) if b < end else np.append(self.lcp.read(a + 1, b), np.uint8(0))
        return self.pos.read(a, b)[::-1].astype(np.int64), lcp[::-1]

    def drop(self) -> None:
        self.pos.drop()
        self.lcp.drop()


class _Pass:
    """Induces in one direction: 1 rises over suffixes of type L, -1 falls over those of type S."""

    def __init__(self, level: Level, way: int):
        self.level, self.way = level, way
        self.queue = Queue(level.folder, level.step)
        self.since = np.zeros(len(level.low), np.uint8)  # least common prefix since each range's last entry

    def send(self, pos: np.ndarray, char: np.ndarray, gap: np.ndarray) -> None:
        target = self.level.range_of(char)
        order = np.argsort(target, kind="stable")
        head = starts_of(target[order])
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(order)]):
            r, at = int(target[order[a]]), order[a:b]
            rows = np.empty(b - a, self.level.one if self.level.single[r] else self.level.many)
            rows["p"], rows["g"] = pos[at], gap[at]
            if not self.level.single[r]:
                rows["s"] = char[at]
            self.queue.push(r, rows)

    def push(self, pos: np.ndarray, char: np.ndarray, wanted: np.ndarray, lcp: np.ndarray) -> None:
        """Sends the suffixes before the ``wanted`` ones of ``pos``, which are in order with their common prefixes."""
        pick = np.flatnonzero(wanted)
        target = self.level.range_of(char[pick])
        order = np.argsort(target.astype(np.int16) if len(self.level.low) < 1 << 15 else target, kind="stable")
        at, target = pick[order], target[order]
        head = starts_of(target)
        gap = np.zeros(len(at), np.uint8)
        inner = np.ones(len(at), bool)
        inner[head] = False
        inner = np.flatnonzero(inner)
        if len(inner):
            gap[inner] = least_between(lcp, at[inner - 1], at[inner])
        if len(head):
            key = target[head]
            gap[head] = np.minimum(self.since[key], np.minimum.accumulate(lcp)[at[head]])
            rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(self.level.cap))
        np.minimum(self.since, lcp.min(), out=self.since)
        ends = np.append(head[1:], len(at)) if len(head) else head
        if len(head):
            self.since[key] = rest[at[ends - 1] + 1]
        for a, b in zip(head.tolist(), ends.tolist()):
            r, i = int(target[a]), at[a:b]
            rows = np.empty(b - a, self.level.one if self.level.single[r] else self.level.many)
            rows["p"], rows["g"] = pos[i] - 1, gap[a:b]
            if not self.level.single[r]:
                rows["s"] = char[i]
            self.queue.push(r, rows)

    def range(self, r: int, stops, n_stops: int, take) -> None:
        """One range: its queue, and the ``n_stops`` suffixes of the other type, which ``stops(a, b)`` reads.

        ``take(positions, lcp, kind)`` gets them in order, kind 2 for the latter (mixed where the range falls).
        """
        (self._stream if self.level.single[r] else self._window)(r, stops, n_stops, take)

    def _stream(self, r, stops, n_stops, take) -> None:
        lv, c, last = self.level, int(self.level.low[r]), None
        while (rows := self.queue.pop(r, lv.step, lv.one)) is not None:
            pos = rows["p"].astype(np.int64)
            lcp = np.minimum(rows["g"], lv.cap - 1) + np.uint8(1)
            if last is None:
                lcp[0] = 0
            take(pos, lcp, 0)
            char, ok = lv.before(pos)
            self.push(pos, char, ok & (char * self.way >= c * self.way), lcp)
            last = pos[-1:]
        for a in range(0, n_stops, lv.step):
            pos, lcp = stops(a, min(a + lv.step, n_stops))
            if not a:
                lcp = lcp.copy()
                lcp[0] = 0 if last is None else lv.run(np.concatenate((last, pos[:1]))).min()
            take(pos, lcp, 2)
            char, ok = lv.before(pos)
            self.push(pos, char, ok & (char * self.way > c * self.way), lcp)

    def _window(self, r, stops, n_stops, take) -> None:
        lv = self.level
        got = []
        while (rows := self.queue.pop(r, lv.budget, lv.many)) is not None:
            got.append(rows)
        rows = np.concatenate(got) if got else np.zeros(0, lv.many)
        stop, stop_lcp = stops(0, n_stops) if n_stops else (np.zeros(0, np.int64), np.zeros(0, np.uint8))
        n_e = len(rows)
        if not n_e and not len(stop):
            return
        pos = [np.concatenate((rows["p"].astype(np.int64), stop))]
        sym = [np.concatenate((rows["s"].astype(np.int64), lv.text.take(stop).astype(np.int64)))]
        kind = [np.repeat(np.array([0, 2], np.int8), (n_e, len(stop)))]
        parent, out, goes = [np.arange(len(pos[0]))], [], []
        base = 0
        while len(pos[-1]):  # what the range induces in itself, step by step
            char, ok = lv.before(pos[-1])
            ok &= (char * self.way > sym[-1] * self.way) | ((char == sym[-1]) & (kind[-1] < 2))
            target = lv.range_of(char)
            stay = np.flatnonzero(ok & (target == r))
            out.append(char)
            goes.append(ok & (target != r))
            size = len(pos[-1])
            pos.append(pos[-1][stay] - 1)
            sym.append(char[stay])
            kind.append(np.ones(len(stay), np.int8))
            parent.append(base + stay)
            base += size
        depth = len(out)
        pos, sym, kind, parent, out, goes = (np.concatenate(x) for x in (pos, sym, kind, parent, out, goes))
        key = sym * self.way
        order = np.lexsort((kind, key))  # stable: entries as they came, stops as they stand
        rank = np.empty(len(pos), np.int64)
        rank[order] = np.arange(len(pos))
        mine = np.flatnonzero(kind == 1)
        if len(mine):
            # induced suffixes of one character tie at first; each round compares twice as many steps of their chains
            mixed = order[kind[order] == 1]
            head = starts_of(key[mixed])
            rank[mixed] = np.repeat(rank[mixed[head]], np.diff(np.append(head, len(mixed))))
            up, steps = parent.copy(), 1
            while True:
                by = np.lexsort((rank[up[mine]], rank[mine]))
                now, next_ = rank[mine[by]], rank[up[mine[by]]]
                new = np.concatenate(([True], (now[1:] != now[:-1]) | (next_[1:] != next_[:-1])))
                group = np.maximum.accumulate(np.where(np.concatenate(([True], now[1:] != now[:-1])), np.arange(len(by)), 0))
                tie = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
                rank[mine[by]] = now + tie - group
                if new.all() or steps > depth:
                    break
                up, steps = up[up], 2 * steps
            order = np.empty(len(pos), np.int64)
            order[rank] = np.arange(len(pos))
        lcp = self._prefixes(order, key, kind, parent, rows["g"], stop_lcp, pos, n_e)
        seq = pos[order]
        if self.way > 0:
            large = kind[order] < 2
            take(seq[large], lcp[large], 0)
        else:
            take(seq, lcp, 0)
        self.push(seq, out[order], goes[order], lcp)

    def _prefixes(self, order, key, kind, parent, gaps, stop_lcp, pos, n_e) -> np.ndarray:
        """Common prefix of each suffix of the order with the one before: chains are followed while both go on with one character."""
        cap = self.level.cap
        lcp = np.zeros(len(order), np.int64)
        alive = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
        x, y, t = order[alive - 1], order[alive], 0
        while len(alive):
            kx, ky = kind[x], kind[y]
            lcp[alive] = t + 1
            for k, values, shift in ((0, gaps, 1), (2, stop_lcp, 0)):
                both = np.flatnonzero((kx == k) & (ky == k))
                if len(both):
                    i = n_e if k else 0
                    lcp[alive[both]] = t + shift + least_between(values, x[both] - i, y[both] - i).astype(np.int64)
            runs = np.flatnonzero(((kx == 1) & (ky == 2)) | ((kx == 2) & (ky == 1)))
            if len(runs):
                lcp[alive[runs]] = t + np.minimum(self.level.run(pos[x[runs]]), self.level.run(pos[y[runs]]))
            on = (kx == 1) & (ky == 1)
            alive, x, y, t = alive[on], parent[x[on]], parent[y[on]], t + 1
            if t >= cap:
                break
            same = key[x] == key[y]
            alive, x, y = alive[same], x[same], y[same]
        return np.minimum(lcp, cap).astype(np.uint8)


def in_memory(text: np.ndarray, bits: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp) of a text that fits in memory, to ``cap`` characters: packed words, only ties go on."""
    n, per = len(text), 63 // bits
    wide = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(per, np.uint64)))
    word = np.zeros(n, np.uint64)
    for j in range(per):
        word = (word << np.uint64(bits)) | wide[j : j + n]
    order = np.argsort(word, kind="stable")
    new = np.concatenate(([True], word[order][1:] != word[order][:-1]))
    for depth in range(per, cap, per):
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        after = order[at] + depth
        key = np.where(after < n, word[np.minimum(after, n - 1)], np.uint64(0))
        group = np.cumsum(new)[at]
        by = np.lexsort((key, group))
        order[at] = order[at[by]]
        key = key[by]
        new[at[1:]] |= (group[1:] == group[:-1]) & (key[1:] != key[:-1])
    lcp = np.zeros(n, np.uint8)
    alive = np.arange(1, n)
    for j in range(cap):
        a, b = order[alive - 1] + j, order[alive] + j
        ok = (a < n) & (b < n)
        alive = alive[ok]
        alive = alive[text[a[ok]] == text[b[ok]]]
        if not len(alive):
            break
        lcp[alive] += 1
    return order, lcp


def sort_text(text: Column, high: int, cap: int, folder: str, budget: int, emit, counts: Column | None = None) -> None:
    """Calls ``emit(positions, lcp)`` with the text's suffixes in falling order. ``counts``: how often each character occurs, if there are many."""
    if text.n <= budget:
        chars = text.read(0, text.n)
        order, lcp = in_memory(chars, (high + 1).bit_length(), cap)
        if len(order):
            emit(order[::-1], np.append(np.uint8(0), lcp[:0:-1]))
        return
    level = Level(text, high, cap, folder, budget)
    level.cut_ranges(counts)
    seeds = level.find_seeds()
    ordered = Sorted(folder, level.place)
    ordered.count = np.zeros(len(level.low), np.int64)
    if seeds.n:
        names, n_names = level.name(seeds)
        back, deeper = Sorted(folder, level.place), cap // 2 + 1
        sort_text(names, n_names.n, deeper, folder, budget, back.append, n_names)
        names.drop()
        n_names.drop()
        last = None
        for b in range(back.n, 0, -level.step):
            i, shared = back.falling(max(b - level.step, 0), b, back.n)
            _add_seeds(level, seeds, ordered, i, shared.astype(np.int64), last, deeper)
            last = i[-1:]
        back.drop()
    seeds.drop()
    level.induce(ordered, emit)


def _add_seeds(level: Level, seeds: Column, ordered: Sorted, i: np.ndarray, shared: np.ndarray, last, deeper: int) -> None:
    """Appends seeds in order with their common prefixes: the names they share, and what the next substrings share."""
    cap, n = level.cap, level.n
    before = np.concatenate((last, i[:-1])) if last is not None else np.concatenate((i[:1], i[:-1]))
    at = seeds.take(i).astype(np.int64)
    ours, theirs = (seeds.take(np.minimum(x + shared, seeds.n - 1)).astype(np.int64) for x in (i, before))
    lcp = np.minimum(ours - at, cap)
    lcp[shared >= deeper] = cap
    alive = np.flatnonzero(lcp < cap)
    width = 8
    while len(alive):
        ok = (ours[alive] < n) & (theirs[alive] < n)
        alive = alive[ok]
        a, b = level.text.take(ours[alive], width), level.text.take(theirs[alive], width)
        room = np.minimum(n - np.maximum(ours[alive], theirs[alive]), width)
        equal = (a == b) & (np.arange(width) < room[:, None])
        k = np.where(equal.all(1), width, equal.argmin(1))
        lcp[alive] += k
        ours[alive] += k
        theirs[alive] += k
        alive = alive[(k == width) & (lcp[alive] < cap)]
    lcp = np.minimum(lcp, cap)
    if last is None:
        lcp[0] = 0
    ordered.append(at, lcp)
    ordered.count += np.bincount(level.range_of(level.text.take(at)), minlength=len(ordered.count))


def suffix_array(text: np.ndarray, cap: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, lcp to ``cap``) of a text in memory, through files in a temporary folder. For texts whose result fits in memory."""
    if not 1 <= cap <= 254:
        raise ValueError("cap must be from 1 to 254")
    got: list = []
    with tempfile.TemporaryDirectory() as folder:
        column = Column(folder, "<u4")
        column.append(text)
        sort_text(column, int(text.max(initial=0)) + 1, cap, folder, max(budget, 8), lambda p, x: got.append((p, x)))
        column.drop()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    pos, lcp = (np.concatenate(x) for x in zip(*got))
    return pos[::-1], np.append(np.uint8(0), lcp[:0:-1])

"""Suffix and common-prefix arrays by external induced sorting.

Suffixes are split into those smaller than their successor (S) and larger ones (L). The leftmost
S of each stretch are sorted by recursion on the names of the strings between them; a scan
upwards then induces all L suffixes and a scan downwards all S suffixes. Both scans take
(key, position, common prefix) tuples from a priority queue and put the tuples of the
preceding positions into it. Equal keys leave the queue as they came, which is the order of
their suffixes. The common prefix of two neighbours in a bucket is one more than the least one
between the suffixes that induced them, so that it is carried along, up to a limit.

The queue works on blocks: a block is the longest run of tuples that no tuple which it induces
could precede. Its sorted runs go to files once they exceed the memory given to it, and all
arrays of a text's length are files above that size, made and read block by block. The files are
unlinked when made and belong to one task alone: a task that is lost leaves nothing behind and is
run again from its input.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes that a queue or an array holds in memory.
MEMORY = 64 << 20
#: The common prefix of the first tuple of a bucket, which nothing precedes there.
FIRST = 255


def scratch(n: int, kind, memory: int = MEMORY) -> np.ndarray:
    """An array, in an unlinked file if it is larger than the memory."""
    kind = np.dtype(kind)
    if n * kind.itemsize <= memory:
        return np.empty(n, kind)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, kind, "w+", shape=(n,))


class Queue:
    """Tuples (key, position, prefix) in order of key, equal keys in order of arrival."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held = memory, 0
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # oldest first
        self.at: list[int] = []
        self.filed: list[bool] = []

    def push(self, key: np.ndarray, position: np.ndarray, prefix: np.ndarray) -> None:
        """Tuples in order of key; they come after equal keys that are there already."""
        if not len(key):
            return
        self.runs.append((key, position, prefix))
        self.at.append(0)
        self.filed.append(False)
        self.held += len(key)
        while len(self.runs) > 1 and not self.filed[-2] and len(self.runs[-2][0]) - self.at[-2] <= 2 * (len(self.runs[-1][0]) - self.at[-1]):
            self._merge()
        if self.held * 17 > self.memory:
            while len(self.runs) > 1 and not self.filed[-2]:
                self._merge()
            moved = []
            for x in self.runs[-1]:
                y = scratch(len(x), x.dtype, 0)
                y[:] = x
                moved.append(y)
            self.runs[-1], self.filed[-1], self.held = tuple(moved), True, 0

    def _merge(self) -> None:
        """The two youngest runs become one."""
        (a, b), (i, j) = self.runs[-2:], self.at[-2:]
        key = np.concatenate([a[0][i:], b[0][j:]])
        order = np.argsort(key, kind="stable")
        self.held -= i + j
        self.runs[-2:] = [(key[order], *(np.concatenate([x[i:], y[j:]])[order] for x, y in zip(a[1:], b[1:], strict=True)))]
        self.at[-2:], self.filed[-2:] = [0], [False]

    def peek(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first tuples, up to `most` of each run, and the run of each; nothing left out precedes any of them."""
        most = max(16, min(most, self.memory // (4 * max(1, len(self.runs)))))
        last, of = None, -1
        for i, (r, at) in enumerate(zip(self.runs, self.at, strict=True)):
            if len(r[0]) - at > most and (last is None or r[0][at + most] < last):
                last, of = r[0][at + most], i
        parts, origin = [], []
        for i, (r, at) in enumerate(zip(self.runs, self.at, strict=True)):
            stop = len(r[0]) if last is None else at + most if i == of else at + int(np.searchsorted(r[0][at : at + most], last, "right" if i < of else "left"))
            if stop > at:
                parts.append([x[at:stop] for x in r])
                origin.append(np.full(stop - at, i, np.int32))
        if len(parts) == 1:
            return *map(np.asarray, parts[0]), origin[0]
        if not parts:
            return *[np.empty(0, np.int32)] * 4,
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] + [np.concatenate(origin)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)

    def drop(self, origin: np.ndarray) -> None:
        """Removes the first tuples of the runs named."""
        for i, n in enumerate(np.bincount(origin, minlength=len(self.runs)).tolist()):
            self.at[i] += n
        keep = [i for i, (r, at) in enumerate(zip(self.runs, self.at, strict=True)) if at < len(r[0])]
        if len(keep) < len(self.runs):
            self.held -= sum(len(self.runs[i][0]) for i in set(range(len(self.runs))) - set(keep) if not self.filed[i])
            self.runs, self.at, self.filed = ([x[i] for i in keep] for x in (self.runs, self.at, self.filed))


def _lowest(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least values over low..high, both included, from a table of minima over powers of two."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.uint8)
    for k in np.unique(level).tolist():
        at = level == k
        out[at] = np.minimum(table[k][low[at]], table[k][high[at] - (1 << k) + 1])
    return out


def _minima(x: np.ndarray) -> list[np.ndarray]:
    table, m = [x], 1
    while 2 * m <= len(x):
        table.append(np.minimum(table[-1][:-m], table[-1][m:]))
        m *= 2
    return table


class Text:
    """A text of numbers under `size` that ends in its only 0, with the type of each suffix."""

    def __init__(self, chars: np.ndarray, size: int, memory: int = MEMORY):
        self.size, self.memory, self.n, self.step = size, memory, len(chars), max(64, memory // 64)
        self.chars = chars
        if chars.dtype != (kind := np.min_scalar_type(size - 1)):
            self.chars = scratch(self.n, kind, memory)
            for a, b in self._blocks(self.n):
                self.chars[a:b] = chars[a:b]
        # small types keep the scattered reads of the scans in the cache and let keys be sorted by radix
        self.key = np.uint16 if 2 * size + 2 < 65535 else np.int64
        self.place = np.int32 if self.n < 2**31 else np.int64
        self.smaller = scratch(self.n, bool, memory)  # S
        self.runs = scratch(self.n, np.uint8, memory)  # how often a character stands from here on
        self.typed = scratch(self.n, self.key, memory)  # character and type in one
        self._classify()
        found = 0
        for a, b in self._blocks(self.n):
            found += int(np.count_nonzero(self._first_of_stretch(a, b)))
        self.leftmost = scratch(found, self.place, memory)
        found = 0
        for a, b in self._blocks(self.n):
            at = np.flatnonzero(self._first_of_stretch(a, b)) + a
            self.leftmost[found : found + len(at)] = at
            found += len(at)

    def _blocks(self, n: int):
        return ((a, min(n, a + self.step)) for a in range(0, n, self.step))

    def _first_of_stretch(self, a: int, b: int) -> np.ndarray:
        """Which positions of a block are S after an L."""
        s = np.asarray(self.smaller[max(0, a - 1) : b])
        return np.concatenate([[False], s[1:] & ~s[:-1]]) if a == 0 else s[1:] & ~s[:-1]

    def _classify(self) -> None:
        """Types and runs, from the end on: a block needs the first character of the next one, its type and its run."""
        char, smaller, run = None, True, 0
        for a, b in reversed(list(self._blocks(self.n))):
            c = np.asarray(self.chars[a:b])
            after = np.concatenate([c[1:], c[-1:] if char is None else [char]])
            change = c != after
            if char is None:
                change[-1] = True  # the text's end, an S of its own
            rising = c < after
            rising[-1] |= char is None
            # the change at or after each position; the block's length where its last run goes on
            n = b - a
            at = np.minimum.accumulate(np.where(change, np.arange(n), n)[::-1])[::-1]
            on = at == n
            own = np.where(on, smaller, rising[np.minimum(at, n - 1)])
            length = np.where(on, n - np.arange(n) + run, at - np.arange(n) + 1)
            self.smaller[a:b] = own
            self.runs[a:b] = np.minimum(length, FIRST - 1)
            np.add(c.astype(self.key) << 1, own, out=self.typed[a:b], casting="unsafe")
            char, smaller, run = c[0], bool(own[0]), int(length[0])

    def _counted(self, of: np.ndarray, beyond: int = 1) -> np.ndarray:
        """Of each character how many of some positions have a lesser one (beyond 0: the same or a lesser one)."""
        less = scratch(self.size + 1, np.int64, self.memory)
        less[:] = 0
        for a, b in self._blocks(len(of)):
            char, n = np.unique(self.chars[of[a:b]], return_counts=True)
            less[char.astype(np.int64) + beyond] += n
        np.cumsum(less, out=less)
        return less

    def _by_char(self, of: np.ndarray) -> np.ndarray:
        """Positions in order of their characters, equal ones as they come."""
        if len(of) <= self.step:
            return of[np.argsort(self.chars[of], kind="stable")]
        out, free = scratch(len(of), self.place, self.memory), self._counted(of)
        for a, b in self._blocks(len(of)):
            at = np.asarray(of[a:b])
            char = self.chars[at].astype(np.int64)
            order = np.argsort(char, kind="stable")
            char = char[order]
            head = np.flatnonzero(np.concatenate([[True], char[1:] != char[:-1]]))
            n = np.diff(np.concatenate([head, [len(char)]]))
            out[np.repeat(free[char[head]] - head, n) + np.arange(len(char))] = at[order]
            free[char[head]] += n
        return out

    def induce(self, seeds: np.ndarray, prefixes: np.ndarray | None, upwards: bool, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and prefixes of the L suffixes in order (upwards) or the S suffixes in falling order, from sorted seeds of the other type."""
        memory, endless = self.memory, np.iinfo(self.key).max
        # keys: twice the character, counted from the end going downwards; one more for seeds, which come after what is induced
        turned = (lambda typed: typed & ~self.key(1)) if upwards else (lambda typed: self.key(2 * self.size - 2) - (typed & ~self.key(1)))
        wanted = int(np.count_nonzero(self.smaller)) - 1 if not upwards else self.n - int(np.count_nonzero(self.smaller))
        out, out_prefix = scratch(wanted, self.place, memory), scratch(wanted if prefixes is not None else 0, np.uint8, memory)
        carried, done = prefixes is not None, 0
        queue = Queue(memory)
        step = max(1, memory // 64)
        for i in range(0, len(seeds), step):
            s = seeds[i : i + step]
            queue.push(turned(self.typed[s]) + self.key(1), s, prefixes[i : i + step] if carried else np.zeros(len(s), np.uint8))
        low = np.full(2 * self.size + 2, FIRST, np.uint8) if carried else None
        pushed = np.zeros(2 * self.size + 2, bool) if carried else None
        before_key, before_at, most = -1, 0, 4096
        while True:
            key, at, prefix, origin = queue.peek(most)
            if not len(key):
                break
            back = np.maximum(at - 1, 0)
            typed = self.typed[back]
            ok = (at > 0) & ((typed & 1) != upwards)
            to = np.where(ok, turned(typed), self.key(endless))
            early = np.flatnonzero(np.minimum.accumulate(to)[:-1] < key[1:])
            n = int(early[0]) + 1 if len(early) else len(key)
            most = max(1, min(memory // 128, max(256, (4 if n == len(key) else 2) * n)))
            key, at, ok, to = key[:n], at[:n], ok[:n], to[:n]
            queue.drop(origin[:n])
            own = (key & 1) == 0
            if carried:
                prefix = prefix[:n].copy()
                first = np.flatnonzero(prefix == FIRST)
                if len(first):
                    same = np.where(first > 0, key[first - 1], before_key) >> 1 == key[first] >> 1
                    other = np.where(first > 0, at[first - 1], before_at)
                    prefix[first] = np.where(same, np.minimum(np.minimum(self.runs[other], self.runs[at[first]]), cap), 0)
                before_key, before_at = int(key[-1]), int(at[-1])
                out_prefix[done : done + int(own.sum())] = prefix[own]
            kept = at[own]
            out[done : done + len(kept)] = kept
            done += len(kept)
            source = np.flatnonzero(ok)
            if len(source):
                order = np.argsort(to[source], kind="stable")
                source = source[order]
                k = to[source]
                if carried:
                    table = _minima(prefix)
                    new = np.concatenate([[True], k[1:] != k[:-1]])
                    k = k.astype(np.int64)
                    value = np.empty(len(k), np.uint8)
                    inner = np.flatnonzero(~new)
                    value[inner] = np.minimum(_lowest(table, source[inner - 1] + 1, source[inner]), cap - 1) + 1
                    heads = np.flatnonzero(new)
                    least = np.minimum(low[k[heads]], _lowest(table, np.zeros(len(heads), np.int64), source[heads]))
                    value[heads] = np.where(pushed[k[heads]], np.minimum(least, cap - 1) + 1, FIRST)
                    np.minimum(low, prefix.min(), out=low)
                    tails = np.concatenate([heads[1:], [len(k)]]) - 1
                    rest = source[tails] + 1
                    inside = rest < n
                    low[k[tails]] = FIRST
                    low[k[tails[inside]]] = _lowest(table, rest[inside], np.full(int(inside.sum()), n - 1))
                    pushed[k[heads]] = True
                else:
                    value = np.zeros(len(k), np.uint8)
                queue.push(to[source], back[source], value)
            elif carried:
                np.minimum(low, prefix.min(), out=low)
        assert done == wanted, (done, wanted)
        return out, out_prefix

    def _differ(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Characters that the suffixes at a and b have in common, up to a limit each."""
        out, live, offset = np.zeros(len(a), np.int64), np.flatnonzero(limit > 0), 0
        top = self.n - 1
        while len(live):
            same = self.chars[np.minimum(a[live] + offset, top)] == self.chars[np.minimum(b[live] + offset, top)]
            live = live[same]
            offset += 1
            out[live] = offset
            live = live[limit[live] > offset]
        return out

    def sorted_leftmost(self) -> np.ndarray:
        """The leftmost S suffixes in order, by induction and recursion."""
        lms = self.leftmost
        if len(lms) < 2:
            return lms
        larger, _ = self.induce(self._by_char(lms), None, True, 0)
        falling, _ = self.induce(larger[::-1], None, False, 0)
        del larger
        order, done = scratch(len(lms), self.place, self.memory), 1
        order[0] = self.n - 1
        for a, b in self._blocks(len(falling)):
            at = np.asarray(falling[::-1][a:b])
            at = at[~self.smaller[at - 1] & (at > 0)]
            order[done : done + len(at)] = at
            done += len(at)
        del falling
        def strings(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Places and lengths of the strings from some leftmost S to the next."""
            place = np.searchsorted(lms, at)
            return place, np.where(place + 1 < len(lms), lms[np.minimum(place + 1, len(lms) - 1)] - at + 1, 1)

        reduced, name = scratch(len(lms), np.int64, self.memory), 0
        reduced[-1] = 0
        for a, b in self._blocks(len(lms) - 1):
            at = np.asarray(order[a : b + 1])
            place, length = strings(at)
            own = length[1:]
            limit = np.where(length[:-1] == own, own, 0)
            names = name + np.cumsum((self._differ(at[:-1], at[1:], limit) < own) | (limit == 0))
            reduced[place[1:]] = names
            name = int(names[-1])
        if name + 1 == len(lms):
            return order
        found = doubled(np.asarray(reduced)) if len(lms) <= self.memory // 64 else suffixes(reduced, name + 1, self.memory)
        for a, b in self._blocks(len(lms)):
            order[a:b] = lms[found[a:b]]
        return order

    def merged(self, larger: np.ndarray, falling: np.ndarray, *columns: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """L suffixes in order and S suffixes in falling order, the end left out, become all suffixes in order; so do columns beside them (out, of L, of falling S)."""
        at = scratch(self.n, self.place, self.memory)
        after, before = self._counted(falling), self._counted(larger, 0)
        at[0] = self.n - 1
        for out, _, _ in columns:
            out[0] = 0
        for a, b in self._blocks(len(larger)):
            own = np.asarray(larger[a:b])
            to = np.arange(a, b) + 1 + after[self.chars[own].astype(np.int64)]
            at[to] = own
            for out, of, _ in columns:
                out[to] = of[a:b]
        rising = falling[::-1]
        for a, b in self._blocks(len(rising)):
            own = np.asarray(rising[a:b])
            to = np.arange(a, b) + 1 + before[self.chars[own].astype(np.int64)]
            at[to] = own
            for out, _, of in columns:
                out[to] = of[::-1][a:b]
        return at


def doubled(chars: np.ndarray) -> np.ndarray:
    """The recursion's end, for texts that fit into the memory: start positions of all suffixes by doubling, over what is still tied."""
    order = np.argsort(chars, kind="stable")
    n, step = len(chars), 1
    rank = np.empty(n, np.int64)

    def ranked(order: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Ranks positions by their keys, a tie by its first place; tells which are tied."""
        head = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        rank[order] = place[first]
        return ~(head & np.concatenate([head[1:], [True]]))

    places = np.flatnonzero(ranked(order, chars[order], np.arange(n)))
    while len(places):
        at = order[places]
        after = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[places] = at = at[by]
        places = places[ranked(at, key[by], places)]
        step *= 2
    return order


def suffixes(chars: np.ndarray, size: int, memory: int = MEMORY) -> np.ndarray:
    """Start positions of all suffixes in order; chars end in their only 0."""
    text = Text(chars, size, memory)
    if text.n < 2:
        return np.zeros(text.n, np.int64)
    larger, _ = text.induce(text.sorted_leftmost(), None, True, 0)
    falling, _ = text.induce(larger[::-1], None, False, 0)
    return text.merged(larger, falling)


def suffixes_with_prefixes(chars: np.ndarray, size: int, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all suffixes in order and the characters that each has in common with the one before, up to cap (under 254)."""
    text = Text(chars, size, memory)
    if text.n < 2:
        return np.zeros(text.n, np.int64), np.zeros(text.n, np.uint8)
    lms = text.sorted_leftmost()
    seed = scratch(len(lms), np.uint8, memory)
    seed[0] = FIRST
    for a, b in text._blocks(len(lms) - 1):
        one, two = np.asarray(lms[a:b]), np.asarray(lms[a + 1 : b + 1])
        common = text._differ(one, two, np.full(b - a, cap))
        seed[a + 1 : b + 1] = np.where(common == 0, FIRST, common)
    larger, larger_prefix = text.induce(lms, seed, True, cap)
    # going down, a suffix is compared with the one above it
    above = scratch(len(larger), np.uint8, memory)
    for a, b in text._blocks(len(larger)):
        last = b == len(larger)
        char = text.chars[np.asarray(larger[a : b + 1])]
        same = np.concatenate([char[:-1] == char[1:], [False]]) if last else char[:-1] == char[1:]
        follow = np.concatenate([larger_prefix[a + 1 : b + 1], [FIRST]]) if last else larger_prefix[a + 1 : b + 1]
        above[a:b] = np.where(same, follow, FIRST)
    falling, falling_prefix = text.induce(larger[::-1], above[::-1], False, cap)
    # a prefix that was carried down belongs to the suffix above; the lowest has none
    own = scratch(len(falling), np.uint8, memory)
    for a, b in text._blocks(len(falling)):
        own[a:b] = np.concatenate([falling_prefix[a + 1 : b + 1], [0] * (b == len(falling))])
    prefix = scratch(text.n, np.uint8, memory)
    at = text.merged(larger, falling, (prefix, larger_prefix, own))
    for a, b in text._blocks(text.n - 1):
        both = np.asarray(at[a : b + 1])
        char, smaller, runs = text.chars[both], text.smaller[both], text.runs[both]
        same = char[1:] == char[:-1]
        # where S follows L of the same character, both start with that character alone
        meet = same & smaller[1:] & ~smaller[:-1]
        prefix[a + 1 : b + 1] = np.where(meet, np.minimum(np.minimum(runs[1:], runs[:-1]), cap), np.where(same, prefix[a + 1 : b + 1], 0))
    return at, prefix

"""Suffix sorting by induction, with bucket queues that go to disk when they grow.

Only the order of the first `depth` bytes matters here. The suffixes that start at a local
minimum are sorted first: their substrings are ordered by one induction and named, and the string
of names, about a third as long, is sorted in turn, again by induction while its alphabet is
small and by doubling ranks else. A second induction then orders all suffixes from those.

Induction is a monotone priority queue keyed by first symbol: suffixes leave it in order, and the
predecessor of each goes back in under its own first symbol, behind all that are there. A bucket
is therefore read and written in whole arrays, first in, first out, and arrays beyond `memory`
bytes wait in a temporary file of the task."""

from __future__ import annotations

import tempfile

import numpy as np

SMALL_ALPHABET = 1024


class BucketQueue:
    """Arrays under integer keys, each key first in, first out; the overflow is kept on disk."""

    def __init__(self, memory: int):
        self.memory, self.held, self.file = memory, 0, None
        self.parts: dict[int, list] = {}

    def put(self, key: int, part: np.ndarray) -> None:
        if self.held + part.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            place = self.file.tell()
            self.file.write(part.tobytes())
            self.parts.setdefault(key, []).append((place, len(part), part.dtype))
        else:
            self.held += part.nbytes
            self.parts.setdefault(key, []).append(part)

    def take(self, key: int) -> np.ndarray | None:
        parts = self.parts.pop(key, None)
        if parts is None:
            return None
        out = []
        for part in parts:
            if isinstance(part, tuple):
                place, n, kind = part
                self.file.seek(place)
                part = np.frombuffer(self.file.read(n * kind.itemsize), kind)
            else:
                self.held -= part.nbytes
            out.append(part)
        return np.concatenate(out) if len(out) > 1 else out[0]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _kinds(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last symbol is the smallest."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    after = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    small = np.ones(n, bool)
    inside = after < n
    small[:-1][inside] = step[after[inside]] > 0
    return small


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, memory: int) -> np.ndarray:
    """All suffixes in order, from the local minima in order."""
    symbols = np.unique(text)
    first = text[seeds]
    bounds = np.searchsorted(first, symbols), np.searchsorted(first, symbols, "right")
    seed_of = {int(c): seeds[a:b] for c, a, b in zip(symbols, *bounds)}
    none = np.empty(0, seeds.dtype)
    queue = BucketQueue(memory)

    def back(batch: np.ndarray, own: int, want_small: bool) -> np.ndarray:
        """Queue the predecessors of one kind; those with the symbol in hand are returned."""
        before = batch[batch > 0] - 1
        before = before[small[before] == want_small]
        if not len(before):
            return none
        symbol = text[before]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        same = none
        for part in np.split(before, cuts):
            c = int(text[part[0]])
            if c == own:
                same = part
            else:
                queue.put(c, part)
        return same

    done = BucketQueue(memory)
    for c in symbols.tolist():
        batch = queue.take(c)
        while batch is not None and len(batch):
            done.put(2 * c, batch)
            batch = back(batch, c, False)
        if len(seed_of[c]):
            back(seed_of[c], c, False)
    large = {c: done.take(2 * c) for c in symbols.tolist()}
    order = BucketQueue(memory)
    for c in symbols.tolist()[::-1]:
        batch = queue.take(c)
        while batch is not None and len(batch):
            order.put(2 * c + 1, batch)
            batch = back(batch, c, True)
        if large[c] is not None:
            back(large[c][::-1], c, True)
    out = []
    for c in symbols.tolist():
        if large[c] is not None:
            out.append(large[c])
        part = order.take(2 * c + 1)
        if part is not None:
            out.append(part[::-1])
    for q in (queue, done, order):
        q.close()
    # The last suffix, a lone smallest symbol, precedes all and is nobody's predecessor.
    last = np.array([len(text) - 1], seeds.dtype)
    return np.concatenate([last, *out])


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a string of names in the order of their first `depth` symbols at least."""
    n, k = len(names), 1
    rank = np.unique(names, return_inverse=True)[1].astype(np.int64)
    while True:
        follow = np.zeros(n, np.int64)
        follow[:-k or None] = rank[k:] + 1 if k < n else 0
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= depth or k >= n:
            return order


def suffix_order(text: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """The suffixes of a text by their first `depth` symbols; its last symbol must be smaller
    than all others. Ties beyond that depth come in any order."""
    n = len(text)
    small = _kinds(text)
    low = small.copy()
    low[0] = False
    low[1:] &= ~small[:-1]
    start = np.flatnonzero(low).astype(np.int64)
    if len(start) > 1:
        by = np.argsort(text[start], kind="stable")
        order = _induce(text, small, start[by], memory)
        order = order[low[order]]
        number = np.full(n, -1, np.int64)
        number[start] = np.arange(len(start))
        size = np.append(np.diff(start) + 1, 1)[number[order]]
        same = size[1:] == size[:-1]
        left = np.flatnonzero(same)
        offset = 0
        while len(left):
            equal = text[order[left] + offset] == text[order[left + 1] + offset]
            same[left[~equal]] = False
            left = left[equal]
            offset += 1
            left = left[size[left] > offset]
        name = np.concatenate(([0], np.cumsum(~same)))
        if name[-1] < len(start) - 1:
            names = np.empty(len(start), np.int64)
            names[number[order]] = name
            if name[-1] < SMALL_ALPHABET:
                inner = suffix_order(names, depth, memory)
            else:
                inner = _doubled(names, depth)
            order = start[inner]
    else:
        order = start
    return _induce(text, small, order, memory)


def _shared(data: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the suffixes at `a` and at `b` share, `depth` at most; zeros follow the data."""
    padded = np.concatenate((data, np.zeros(depth + 8, np.uint8)))
    words = np.ndarray((len(data) + depth, ), "<u8", padded, strides=(1, ))
    shared = np.full(len(a), depth, np.int64)
    left = np.arange(len(a))
    at = 0
    while len(left) and at < depth:
        off = words[a[left] + at] ^ words[b[left] + at]
        apart = off != 0
        if apart.any():
            bits = off[apart]
            lowest = bits & (~bits + np.uint64(1))
            shared[left[apart]] = at + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8
            left = left[~apart]
        at += 8
    return np.minimum(shared, depth)


def common_prefix(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix in order the bytes it shares with the one before, `depth` at most; zeros
    follow the end of the data.

    Where the suffixes before two places in a row are in a row, too, both share bytes up to the same
    place. So only the last places of such runs are looked at far ahead."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    last = np.ones(n, bool)
    last[:-1] = (before[:-1] < 0) | (before[1:] != before[:-1] + 1)
    equal = (before >= 0) & (data == data[before])
    ahead = np.zeros(n, np.int64)
    far = np.flatnonzero(last & equal)
    ahead[far] = _shared(data, far, before[far], depth)
    place = np.arange(n)
    stop = np.minimum.accumulate(np.where(last | ~equal, place, n)[::-1])[::-1]
    shared = np.minimum(stop - place + ahead[stop], depth)[order]
    shared[:1] = 0
    return shared

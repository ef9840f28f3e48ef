"""Suffix arrays with common-prefix values by external induced sorting.

The suffixes that start a rising stretch after a falling one (the seeds) are sorted first: their stretches get names, and
the string of names is sorted by the same procedure, down to a string whose names all differ. From the seeds all other
suffixes are induced: a scan over the sorted suffixes pushes each one's predecessor, once upwards for falling and once
downwards for rising suffixes. A push carries the suffix and its common prefix with the one pushed before it under the same
first symbol. The pushes are one priority queue by first symbol: a scanned block's pushes are kept together in order of
their buckets, in memory up to a bound and in a temporary file beyond it, and are read back when the scan reaches their
bucket. A bucket is a symbol, or a range of symbols where there are many, as names are; in such a bucket the scan goes on up
to the first symbol that is still to receive a push, so that its blocks stay long. Texts beyond the same bound are mapped
from a file. The files are scratch of one sort in one task, unlinked from the start: nobody else needs them, and a task that
runs again makes its own.

The prefix of two pushes that follow each other is one symbol more than the least prefix met by the scan between their
sources, and the prefixes of names give those of the seeds, so values are carried along. Prefixes count up to a cap.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import cached_property

import numpy as np

#: Buckets of the priority queue at most, and suffixes of a bucket where it holds many symbols, about.
QUEUES, BUCKET = 512, 1 << 14
#: Suffixes that are scanned at once, and those of a bucket with many symbols that are kept in order for it.
BLOCK, AHEAD = 1 << 16, 1 << 12
#: Bytes of queue entries in memory in one sort, and of a text that is not mapped from a file.
MEMORY = 2 << 20
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Store:
    """Blocks of queue entries, in memory up to `limit` bytes and in one temporary file beyond; counts what it did."""

    def __init__(self, limit: int = MEMORY) -> None:
        self.limit, self.used, self.file, self.end = limit, 0, None, 0
        self.recursions = self.on_disk = self.bytes_on_disk = 0

    def put(self, block: np.ndarray):
        if self.used + block.nbytes <= self.limit:
            self.used += block.nbytes
            return block
        if self.file is None:
            self.file = tempfile.TemporaryFile(buffering=0)
        at, self.end = self.end, self.end + block.nbytes
        self.file.seek(at)
        self.file.write(block.tobytes())
        self.on_disk += 1
        self.bytes_on_disk += block.nbytes
        return at, block.dtype

    def get(self, parts: list) -> np.ndarray:
        """The rows a to b of each part (held, a, b), one after the other."""
        out = []
        for held, a, b in parts:
            if not isinstance(held, np.ndarray):
                at, kind = held
                self.file.seek(at + 2 * a * kind.itemsize)
                out.append(np.frombuffer(self.file.read(2 * (b - a) * kind.itemsize), kind).reshape(-1, 2))
            else:
                out.append(held[a:b])
        return out[0] if len(out) == 1 else np.concatenate(out)

    def clear(self) -> None:
        """Forgets all blocks."""
        self.used = self.end = 0

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Text:
    """A string of small integers, read by symbols or by machine words of several symbols."""

    def __init__(self, symbols: np.ndarray, limit: int = MEMORY) -> None:
        n, kind = len(symbols), np.dtype(np.uint8 if not len(symbols) or symbols.max() < 256 else ">u2" if symbols.max() < 65536 else ">u4")
        size = n * kind.itemsize + 8
        if size > limit:
            with tempfile.TemporaryFile() as file:
                whole = np.memmap(file, np.uint8, "w+", shape=(size,))
        else:
            whole = np.zeros(size, np.uint8)
        whole[: n * kind.itemsize].view(kind)[:] = symbols
        self.n, self.each, self.bits = n, 8 // kind.itemsize, 8 * kind.itemsize
        self.symbols = np.frombuffer(whole, kind, n)
        if kind.itemsize > 1:  # for words the first symbol is in the highest bits; alone, symbols are read in the machine's own order
            self.symbols = self.symbols.astype(kind.newbyteorder("="))
        self.words = np.ndarray((n + 1,), ">u8", whole, 0, (kind.itemsize,))

    def word(self, at: np.ndarray) -> np.ndarray:
        """The next symbols from each place, the first in the highest bits; zero beyond the end."""
        return self.words[at].astype(np.uint64)

    def rising(self) -> np.ndarray:
        """Whether each suffix is smaller than the one after it."""
        s = self.symbols
        change = np.flatnonzero(s[1:] != s[:-1])
        ends = np.append(change, self.n - 1)
        return np.repeat(np.append(s[change + 1] > s[change], False), np.diff(ends, prepend=-1))

    @cached_property
    def starts(self) -> np.ndarray:
        """Where runs of one symbol start."""
        return np.append(0, np.flatnonzero(self.symbols[1:] != self.symbols[:-1]) + 1)

    def run_start(self, at: np.ndarray) -> np.ndarray:
        return self.starts[np.searchsorted(self.starts, at, "right") - 1]

    def common(self, a: np.ndarray, b: np.ndarray, cap: int, known: np.ndarray | int = 0) -> np.ndarray:
        """The common prefix of suffixes a[k] and b[k], up to the cap; the first `known` symbols are known to be equal."""
        out = np.zeros(len(a), np.int64) + known
        most = np.minimum(self.n - np.maximum(a, b), cap)
        open_ = np.flatnonzero(out < most)
        while len(open_):
            differ = self.word(a[open_] + out[open_]) ^ self.word(b[open_] + out[open_])
            gain = np.full(len(open_), self.each)
            for k in range(self.each - 1, -1, -1):
                gain[differ >> np.uint64(64 - self.bits * (k + 1)) != 0] = k
            out[open_] += gain
            open_ = open_[(gain == self.each) & (out[open_] < most[open_])]
        return np.minimum(out, most)


def stretch_names(text: Text, seeds: np.ndarray) -> np.ndarray:
    """The rank of each seed's stretch, up to and with the next seed; equal stretches share it.

    Of two stretches one of which begins with the other the longer is smaller, as it falls where the other's last symbol
    starts to rise; but the last stretch, which the text's end cuts, is smaller than those that it begins.
    """
    end = np.append(seeds[1:] + 1, text.n)
    length = end - seeds
    length[-1] = text.n + 1
    name = np.zeros(len(seeds), np.int64)
    at, open_ = seeds.copy(), np.arange(len(seeds))
    while len(open_):
        word = text.word(np.minimum(at[open_], text.n))
        inside = np.clip(end[open_] - at[open_], 0, text.each)
        cut = inside < text.each
        word[cut] |= np.where(open_[cut] < len(seeds) - 1, _ALL >> (inside[cut] * text.bits).astype(np.uint64), np.uint64(0))
        order = np.lexsort((word, name[open_]))
        mine, old = word[order], name[open_][order]
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (mine[1:] != mine[:-1])))
        name[open_[order]] = old + _starts(new) - _starts(np.concatenate(([True], old[1:] != old[:-1])))
        at[open_] += text.each
        mine = name[open_]
        more = (np.bincount(mine) > 1) & (np.bincount(mine, at[open_] < end[open_]) > 0)
        open_ = open_[more[mine]]
    order = np.lexsort((-length, name))
    new = np.concatenate(([False], (name[order][1:] != name[order][:-1]) | (length[order][1:] != length[order][:-1])))
    name[order] = np.cumsum(new)
    return name


def _starts(new: np.ndarray) -> np.ndarray:
    """For each place the last one up to it that is marked."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _least(p: np.ndarray, low: np.ndarray, high: np.ndarray, groups: int) -> np.ndarray:
    """min(p[low[k]: high[k] + 1]) for each k; groups: how often p is covered by these ranges, at most."""
    if groups * len(p) < 1 << 14:
        ends = np.empty(2 * len(low), np.int64)
        ends[::2], ends[1::2] = low, high + 1
        return np.minimum.reduceat(np.append(p, p[-1]), ends)[::2]
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    out, size, table = np.empty(len(low), p.dtype), 1, p
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - size + 1])
        table, size = np.minimum(table[:-size], table[size:]) if len(table) > size else table, 2 * size
    return out


def _by(key: np.ndarray) -> np.ndarray:
    """The stable order of integers below 2 ** 47 in size; short ones are sorted with their places in the lowest bits."""
    if len(key) > 1 << 16:
        return np.argsort(key, kind="stable")
    return np.sort(key << 16 | np.arange(len(key))) & 0xFFFF


def _inserted(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Columns of both in order of the third row, those of `new` behind equal ones."""
    at = np.searchsorted(rows[2], new[2], "right") + np.arange(new.shape[1])
    out = np.empty((len(rows), rows.shape[1] + new.shape[1]), rows.dtype)
    old = np.ones(out.shape[1], bool)
    old[at] = False
    out[:, at] = new
    out[:, old] = rows
    return out


class _Scan:
    """One scan over all suffixes: upwards if sign is 1, downwards if it is -1. `wanted` says which suffixes it pushes."""

    def __init__(self, text: Text, wanted: np.ndarray, store: Store, cap: int, sign: int) -> None:
        self.text, self.wanted, self.store, self.cap, self.sign = text, wanted, store, cap, sign
        symbols = int(text.symbols.max()) + 1
        self.kind = np.int32 if max(text.n, cap, symbols) < 1 << 29 else np.int64
        buckets = symbols if symbols <= QUEUES else min(QUEUES, 1 + text.n // BUCKET)
        self.shift = (-(-symbols // buckets) - 1).bit_length()
        self.each = 1 << self.shift  # symbols of a bucket
        self.queues: list[list] = [[] for _ in range(-(-symbols // self.each))]
        # of each symbol the block with its last source (-1: none yet) and the least prefix after that in the block
        self.seen, self.rest = np.full(symbols, -1, np.int64), np.zeros(symbols, np.int64)
        # blocks whose least prefix is below those of all later ones, with these prefixes
        self.number, self.marks, self.minima = 1, [], []

    def push(self, suffixes: np.ndarray, prefixes: np.ndarray, edges: list[int], buckets: list[int]) -> None:
        """Suffixes sorted by first symbol: those from edges[k] to edges[k + 1] go to buckets[k]."""
        block = np.empty((len(suffixes), 2), self.kind)
        block[:, 0], block[:, 1] = suffixes, prefixes
        held = self.store.put(block)
        for c, a, b in zip(buckets, edges, edges[1:]):
            self.queues[c].append((held, a, b))

    def blocks(self, c: int) -> Iterator[np.ndarray]:
        """A bucket's pushes in the order they came, some at a time; it may grow on the way."""
        queue, i = self.queues[c], 0
        while i < len(queue):
            parts, n = [], 0
            while i < len(queue) and n < BLOCK:
                parts.append(queue[i])
                n += queue[i][2] - queue[i][1]
                i += 1
            yield self.store.get(parts)

    def backwards(self, c: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A bucket's suffixes, the last first, each with its prefix with the one after it; the first with zero."""
        queue = self.queues[c]
        i, carry = len(queue), 0
        while i:
            parts, n = [], 0
            while i and n < BLOCK:
                i -= 1
                parts.append(queue[i])
                n += queue[i][2] - queue[i][1]
            block = self.store.get(parts[::-1])[::-1]
            yield block[:, 0], np.append(carry, block[:-1, 1])
            carry = block[-1, 1]

    def run(self, c: int, fixed: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Scans a bucket: under each symbol its pushes, then those suffixes of `fixed`, which come in the scan's order.

        Gives the suffixes in that order, their prefixes with the one before, and which of them are fixed.
        """
        if self.each > 1:
            none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield from self._mixed(c, *(np.concatenate(x) for x in zip(none, *fixed)))
            return
        last = None
        for block in self.blocks(c):
            self.feed(block[:, 0], block[:, 1], self._pushed(block[:, 0]))
            last = block[-1:, 0]
            yield block[:, 0], block[:, 1], np.zeros(len(block), bool)
        for suffixes, prefixes in fixed:
            if last is not None and len(suffixes):
                prefixes = np.append(self.text.common(last, suffixes[:1], self.cap), prefixes[1:])
                last = None
            self.feed(suffixes, prefixes, self._pushed(suffixes))
            yield suffixes, prefixes, np.ones(len(suffixes), bool)

    def _entries(self, suffixes: np.ndarray, prefixes: np.ndarray, fixed: int, c: int) -> np.ndarray:
        """Rows of a bucket's suffixes, prefixes, keys, symbols that they are pushed to (-1: none), and the greatest keys that
        may be scanned with them, in the order of their keys; those of `fixed` (1) come after a symbol's pushes (0)."""
        top = np.iinfo(self.kind).max
        key = 2 * self.sign * self.text.symbols[suffixes].astype(np.int64) + fixed
        if not fixed:
            order = _by(key)
            suffixes, prefixes, key = suffixes[order], prefixes[order], key[order]
        out = np.empty((5, len(key)), self.kind)
        symbol = self._pushed(suffixes)
        own = 2 * self.sign * symbol
        out[0], out[1], out[2], out[3] = suffixes, prefixes, key, symbol
        # a push to another symbol of the bucket comes before that symbol's pushes are scanned, one to its own symbol after
        out[4] = np.where(symbol >> self.shift == c, own - (own != key), top)
        return out

    def _pushed(self, suffixes: np.ndarray) -> np.ndarray:
        """The symbol that each suffix pushes its predecessor to, -1 where it pushes none."""
        before = suffixes - 1
        return np.where(self.wanted[before] & (before >= 0), self.text.symbols[before].astype(np.int64), -1)

    def _mixed(self, c: int, suffixes: np.ndarray, prefixes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        rest = self._entries(suffixes, prefixes, 1, c)
        # pushes are put in order among the rows that are scanned next; those beyond the bound wait until these are used up
        rows, later, bound, look = rest[:, :0], [], -(1 << 62), AHEAD
        last, last_key = np.zeros(1, self.kind), 1 << 62
        while True:
            if self.queues[c]:
                new = self.store.get(self.queues[c])
                self.queues[c] = []
                new = self._entries(new[:, 0], new[:, 1], 0, c)
                near = int(np.searchsorted(new[2], bound, "right"))
                if near:
                    rows = _inserted(rows, new[:, :near])
                if near < new.shape[1]:
                    later.append(new[:, near:])
            if not rows.shape[1]:
                if later:
                    new = np.concatenate(later, axis=1)
                    rest, later = _inserted(rest, new[:, _by(new[2].astype(np.int64))]), []
                n = rest.shape[1]
                if not n:
                    return
                n = n if n <= AHEAD else int(np.searchsorted(rest[2], rest[2, AHEAD], "right"))
                rows, rest = rest[:, :n], rest[:, n:]
                bound = int(rows[2, -1])
            key = rows[2]
            n = len(key) if len(key) <= look else int(np.searchsorted(key, key[look], "right"))
            blocked = key[1:n] > np.minimum.accumulate(rows[4, : n - 1])
            stop = int(blocked.argmax()) + 1 if blocked.any() else n
            look = min(AHEAD, 4 * stop + 16)
            now, pre, keys, symbol = rows[0, :stop], rows[1, :stop], key[:stop], rows[3, :stop]
            fixed = keys & 1 > 0
            meet = np.flatnonzero(fixed[1:] & (keys[1:] - keys[:-1] == 1)) + 1
            if fixed[0] and int(keys[0]) - last_key == 1:
                meet = np.concatenate(([0], meet))
            if len(meet):
                pre = pre.copy()
                pre[meet] = self.text.common(np.where(meet > 0, now[meet - 1], last), now[meet], self.cap)
            again = 2 * self.sign * symbol == keys
            more = again.any()
            self.feed(now, pre, np.where(again, -1, symbol) if more else symbol)
            last, last_key = now[-1:], int(keys[-1])
            rows = rows[:, stop:]
            yield now, pre, fixed
            if more:  # then the block ends with all pushes of that symbol
                mine = keys == last_key
                now, pre = self._runs(now[mine], pre[mine])
                symbol = self._pushed(now)
                self.feed(now, pre, np.where(2 * self.sign * symbol == last_key, -1, symbol))
                last = now[-1:]
                yield now, pre, np.zeros(len(now), bool)

    def _runs(self, suffixes: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What all of a symbol's pushes push to that symbol, and these again, until their runs of it begin; with prefixes."""
        runs = suffixes - self.text.run_start(suffixes)
        row = np.repeat(np.arange(len(suffixes)), runs)
        nth = 1 + np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
        order = np.argsort(nth, kind="stable")
        row, nth = row[order], nth[order]
        out = suffixes[row].astype(np.int64) - nth
        first = np.concatenate(([True], nth[1:] != nth[:-1]))
        shared, rest = np.empty(len(out), np.int64), np.flatnonzero(~first)
        if len(rest):
            shared[rest] = nth[rest] + _least(prefixes, row[rest - 1] + 1, row[rest], int(nth[-1]))
        at = np.flatnonzero(first)
        shared[at] = self.text.common(np.append(suffixes[-1:], out[:-1])[at], out[at], self.cap, np.minimum(nth[at] - 1, self.cap))
        return out, np.minimum(shared, self.cap)

    def feed(self, suffixes: np.ndarray, prefixes: np.ndarray, symbol: np.ndarray) -> None:
        """Scans suffixes, each with its prefix with the one scanned before it and the symbol that it pushes to (-1: none)."""
        for i in range(0, len(suffixes), BLOCK):
            self._block(suffixes[i : i + BLOCK], prefixes[i : i + BLOCK], symbol[i : i + BLOCK])

    def _block(self, suffixes: np.ndarray, prefixes: np.ndarray, symbol: np.ndarray) -> None:
        at = np.flatnonzero(symbol >= 0)
        if len(at):
            symbol = symbol[at].astype(np.int64)
            order = _by(symbol)
            at, symbol = at[order], symbol[order]
            heads = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
            low = np.empty_like(at)
            low[1:] = at[:-1] + 1
            low[heads] = 0
            shared = _least(prefixes, low, at, len(heads)).astype(np.int64) + 1
            mine = symbol[heads]
            old = self.seen[mine]
            since = np.array([*self.minima, self.cap])[np.searchsorted(self.marks, old, "right")]
            shared[heads] = np.where(old < 0, 0, np.minimum(shared[heads], np.minimum(self.rest[mine], since) + 1))
            ends = np.concatenate((heads[1:], [len(at)]))
            self.seen[mine] = self.number
            self.rest[mine] = np.concatenate((np.minimum.accumulate(prefixes[::-1])[::-1], [self.cap]))[at[ends - 1] + 1]
            bucket = mine >> self.shift
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            self.push(suffixes[at] - 1, np.minimum(shared, self.cap), [*heads[first].tolist(), len(at)], bucket[first].tolist())
        least = int(prefixes.min())
        while self.minima and self.minima[-1] >= least:
            self.minima.pop()
            self.marks.pop()
        self.minima.append(least)
        self.marks.append(self.number)
        self.number += 1


def _induced(text: Text, up: np.ndarray, seeds: np.ndarray, seed_prefixes: np.ndarray, cap: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes, the greatest first, with their prefixes with the one before, from the seeds in rising order with theirs."""
    falling, climbing = _Scan(text, ~up, store, cap, 1), _Scan(text, up, store, cap, -1)
    end = int(text.symbols[text.n - 1])
    falling.push(np.array([text.n - 1]), np.array([0]), [0, 1], [end // falling.each])
    falling.seen[end] = falling.rest[end] = 0  # its source was the empty suffix, which shares nothing
    heads = np.searchsorted(text.symbols[seeds], np.arange(len(falling.queues) + 1) * falling.each)
    for c in range(len(falling.queues)):
        a, b = heads[c], heads[c + 1]
        kept = []
        for suffixes, prefixes, fixed in falling.run(c, iter([(seeds[a:b], seed_prefixes[a:b])] if b > a else [])):
            if falling.each > 1 and not fixed.all():  # where symbols share a bucket it is kept in the order found
                block = np.stack((suffixes[~fixed], prefixes[~fixed]), axis=1).astype(falling.kind)
                kept.append((store.put(block), 0, len(block)))
        if falling.each > 1:
            falling.queues[c] = kept
    for c in range(len(falling.queues) - 1, -1, -1):
        for suffixes, prefixes, _ in climbing.run(c, falling.backwards(c)):
            yield suffixes, prefixes
    store.clear()


def _sorted_seeds(text: Text, seeds: np.ndarray, cap: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """The seeds in order, and the prefix of each with the one before."""
    names = stretch_names(text, seeds)
    if int(names.max()) + 1 == len(names):
        order, equal = np.argsort(names), np.zeros(len(names), np.int64)
    else:
        store.recursions += 1
        order, equal = _ascending(Text(names, store.limit), cap // 2 + 1, store)  # a stretch has two symbols of its own at least
    ordered = seeds[order]
    late = np.maximum(order[:-1], order[1:])  # of two seeds that follow each other that further on in the text
    known = np.append(seeds, text.n)[np.minimum(late + equal[1:], len(seeds))] - seeds[late]
    return ordered, np.append(0, text.common(ordered[:-1], ordered[1:], cap, np.minimum(known, cap)))


def descending(text: Text, cap: int, store: Store) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes, the greatest first, some at a time, each with its prefix with the one before it, up to the cap.

    Suffixes that agree on more than cap symbols may stand in either order.
    """
    if text.n < 2 or cap < 2:
        order = np.argsort(text.symbols, kind="stable")[::-1]
        yield order, np.append(0, np.diff(text.symbols[order].astype(np.int64)) == 0) * cap
        return
    up = text.rising()
    seeds = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    ordered, prefixes = _sorted_seeds(text, seeds, cap, store) if len(seeds) else (seeds, seeds)
    yield from _induced(text, up, ordered, prefixes, cap, store)


def _ascending(text: Text, cap: int, store: Store) -> tuple[np.ndarray, np.ndarray]:
    order, prefix = (np.concatenate(x)[::-1].astype(np.int64) for x in zip(*descending(text, cap, store)))
    return order, np.append(0, prefix[:-1])


def suffixes(text: np.ndarray, cap: int, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of a string of small integers in order, and the prefix of each with the one before, up to the cap."""
    store = Store(memory)
    try:
        return _ascending(Text(np.asarray(text), memory), cap, store) if len(text) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    finally:
        store.close()

"""Substring dedup by super-k-mers: of equal windows of words only the first of the corpus stays.

A window is WINDOW consecutive words. Its minimiser is the least hash of the runs of MERS words inside it; consecutive
windows that share one travel as one packed string to the bucket of that minimiser, so equal windows meet whatever stands
around them. There windows are sorted by hash, those that agree are compared byte for byte, and all but the one with the
smallest (doc_id, start) are reported. A first pass finds the minimisers that stand in one place only (grove.llm.minimisers);
their windows cannot be repeated and do not travel. Before the shuffle each chunk of text does the same on its own: windows that repeat
inside it are reported at once and not sent, so a passage that very many documents share is sent once a chunk.

Defined results: null text has no words; texts of fewer words than a window lose nothing; null ids come before all others;
rows that repeat an id and a text count as one document and get equal results; an empty table gives no rows; columns other
than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from grove.llm import minimisers as mn
from grove.llm import spans as sp
from grove.llm.common import buckets_for, text_bytes
from grove.llm.minimisers import least

WINDOW, MERS = 20, 8
#: Bytes of text that a chunk and a bucket (of segments) hold, about.
CHUNK, BUCKET = 4 << 20, 4 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


_BYTES = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    each = np.full(n + 1, base, np.uint64)
    each[0] = 1
    return np.cumprod(each)


def hashed(text: bytes, begins: np.ndarray, ends: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """A 64-bit hash of each word of a text, from sums of its bytes times powers of a base; a block of words at a time."""
    out = np.empty(len(begins), np.uint64)
    for i in range(0, len(begins), block):
        b, e = begins[i : i + block], ends[i : i + block]
        first, n = int(b[0]), int(e[-1] - b[0])
        size = 1 << max(20, n.bit_length())
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(text, np.uint8, n, first)] * _powers(_BASE, size)[:n], out=sums[1:])
        out[i : i + block] = mixed((sums[e - first] - sums[b - first]) * _powers(pow(_BASE, -1, 1 << 64), size)[b - first])
    return out


def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte (not included) of each word of a text that has one space after each word."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends, ends


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolled(h: np.ndarray, width: int, step: np.uint64 = _STEP) -> np.ndarray:
    """A hash of each run of `width` entries, from the hashes of runs of powers of two."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, h, 1
    while True:
        if width & size:
            part = power[done : done + n]
            out = part.copy() if out is None else mixed(out * step + part)
            done += size
        if done == width:
            return mixed(out)
        power = mixed(power[:-size] * step + power[size:]) if len(power) > size else power[:0]
        size *= 2


def later(value: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of entries whose value also stands at a smaller (doc_id, start), and the index of that first one."""
    order = np.argsort(value, kind="stable")
    v = value[order]
    same = np.zeros(len(v), bool)
    if len(v):
        equal = v[1:] == v[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    some = order[same]
    if not len(some):
        return some, some
    some = some[np.lexsort((start[some], doc_id[some], value[some]))]
    first = np.concatenate(([True], value[some[1:]] != value[some[:-1]]))
    head = some[np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))]
    after = (doc_id[some] != doc_id[head]) | (start[some] != start[head])
    return some[after], head[after]


def exactly(text: bytes, at: np.ndarray, begin: np.ndarray, end: np.ndarray, doc_id: np.ndarray, start: np.ndarray, late: np.ndarray, head: np.ndarray) -> np.ndarray:
    """late, once windows and their heads (indices; window i is text[begin[i]:end[i]], its first word at[i]) have been compared byte for byte."""
    order = np.argsort(late)
    late, head = late[order], head[order]
    if not len(late):
        return late
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at[late]) != 1) | (np.diff(at[head]) != 1))))
    last = np.append(first[1:], len(late)) - 1
    for a, b, x, y in zip(begin[late[first]].tolist(), end[late[last]].tolist(), begin[head[first]].tolist(), end[head[last]].tolist()):
        if text[a:b] != text[x:y]:
            return _by_bytes(text, begin, end, doc_id, start)
    return late


def _by_bytes(text: bytes, begin: np.ndarray, end: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The same without hashes: taken where two different windows have one hash."""
    first: dict[bytes, tuple[int, int]] = {}
    keys = [text[a:b] for a, b in zip(begin.tolist(), end.tolist())]
    at = list(zip(doc_id.tolist(), start.tolist()))
    for k, place in zip(keys, at):
        first[k] = min(first.get(k, place), place)
    return np.flatnonzero([first[k] != place for k, place in zip(keys, at)])


def _windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with so many words, one after the other: each window's first word, its text, and its start there."""
    n = np.maximum(sizes - width + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(sizes) - sizes, n) + start, owner, start


class _Chunk:
    """The windows of some texts, one text after the other: first word, text, start there and minimiser."""

    def __init__(self, texts: list[bytes], width: int, mers: int) -> None:
        split = [t.split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.at, self.owner, self.start = _windows(sizes, width)
        self.text = b" ".join([w for s in split for w in s]) + b" " if len(self.at) else b""
        self.begins, self.ends = places(self.text)
        self.hashes = hashed(self.text, self.begins, self.ends)
        self.mers = rolled(self.hashes, mers, np.uint64(0xD6E8FEB86659FD93))
        self.minimiser = least(self.mers, width - mers + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)


def _selected(texts: list[bytes], width: int, mers: int) -> np.ndarray:
    c = _Chunk(texts, width, mers)
    return c.mers[mn.chosen(c.mers, c.at, c.minimiser, width - mers)]


def _sent(batches: Iterator[pd.DataFrame], bitmap: mn.Bitmap, n_buckets: int, width: int, mers: int, chunk: int) -> Iterator[pd.DataFrame]:
    flags = mn.unpacked(bitmap)
    for ids, ths, first_word, texts in sp.chunks(batches, chunk, sp.word_pieces(width)):
        c = _Chunk(texts, width, mers)
        kept = mn.hits(flags, bitmap.bits, c.minimiser)
        some = np.flatnonzero(kept)
        if not len(some):
            continue
        owner, start, text = c.owner, first_word[c.owner] + c.start, c.text
        late, head = later(rolled(c.hashes, width)[c.at[some]], ids[owner[some]], start[some])
        at = c.at[some]
        late = exactly(text, at, c.begins[at], c.ends[at + width - 1], ids[owner[some]], start[some], late, head)
        repeated = np.zeros(len(kept), bool)
        repeated[some[late]] = True
        a, b = sp.runs(repeated, owner)
        spans = sp.make_spans(ids[owner[a]], ths[owner[a]], start[a], start[b] + width)
        a, b = sp.runs(kept & ~repeated, owner, c.minimiser)
        lo, hi = c.begins[c.at[a]], c.ends[c.at[b] + width - 1] + 1
        slices = [text[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
        meta = sp.make_meta(ids[owner[a]], ths[owner[a]], start[a], b - a + 1, hi - lo)
        yield sp.pack((c.minimiser[a] % np.uint64(n_buckets)).astype(np.int64), meta, slices, spans, n_buckets)


def _met(frame: pd.DataFrame, width: int) -> pd.DataFrame:
    meta, text, spans = sp.unpack(frame)
    if not len(meta):
        return sp.as_frame(spans)
    at, owner, start = _windows(meta["windows"].astype(np.int64) + width - 1, width)
    start = start + meta["start"][owner]
    doc_id, th = meta["doc_id"][owner], meta["th"][owner]
    begins, ends = places(text)
    late, head = later(rolled(hashed(text, begins, ends), width)[at], doc_id, start)
    late = exactly(text, at, begins[at], ends[at + width - 1], doc_id, start, late, head)
    repeated = np.zeros(len(at), bool)
    repeated[late] = True
    a, b = sp.runs(repeated, owner)
    return sp.as_frame(np.concatenate((spans, sp.make_spans(doc_id[a], th[a], start[a], start[b] + width))))


def repeated_spans(docs: DataFrame, width: int = WINDOW, mers: int = MERS, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """Spans of words (s to e, e not included) that repeated windows cover, by document key."""
    own, size = sp.keyed(docs), text_bytes(docs)
    # a minimiser every (width - mers + 2) / 2 words, of five bytes at least
    bitmap = mn.repeated(own, lambda t: _selected(t, width, mers), size, size // (2 * (width - mers + 2)), chunk, sp.word_pieces(width))
    n = buckets_for(size, bucket)
    sent = own.mapInPandas(lambda b: _sent(b, bitmap, n, width, mers, chunk), sp.PACKED)
    return sent.groupBy("bucket").applyInPandas(lambda f: _met(f, width), sp.SPAN)


def _kept(text: str, s: np.ndarray, e: np.ndarray) -> tuple[int, int, bytes]:
    """The number of words, how many go, and those that stay; a long text is split into words piece by piece."""
    data, gone = text.encode(), sp.merged(s, e)
    starts, ends = [a for a, _ in gone], [b for _, b in gone]
    out, n = [], 0
    for first, piece in sp.word_pieces(1)(data, CHUNK) if len(data) > 2 * CHUNK else [(0, data)]:
        words = piece.split()
        n = first + len(words)
        mine = gone[bisect_right(ends, first) : bisect_left(starts, n)]
        out += [b" ".join(w) for w in sp.outside(words, [(max(a - first, 0), min(b - first, len(words))) for a, b in mine]) if w]
    return n, sum(ends) - sum(starts), b" ".join(out)


def _without(text: str, s: np.ndarray, e: np.ndarray) -> tuple:
    n, removed, kept = _kept(text, s, e)
    return n, removed, sp.sha256(kept)


def _kept_text(text: str, s: np.ndarray, e: np.ndarray) -> tuple:
    return (_kept(text, s, e)[2].decode(),)


def digests(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    return sp.applied(docs, repeated_spans(docs, width), _without, ["n_words", "n_removed", "kept_sha256"], "n_words bigint, n_removed bigint, kept_sha256 string")


def dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id and the text of the words that stay, joined by one space."""
    return sp.applied(docs, repeated_spans(docs, width), _kept_text, ["text"], "text string")

"""Suffix-array dedup: bytes that a string of WINDOW bytes covers which starts anywhere else go, all occurrences alike.

The corpus is cut into shards such that equal strings are in one shard: consecutive windows of WINDOW bytes that share a
minimiser (the least hash of the runs of MER bytes inside) form a segment, and a minimiser's segments share a shard. A
first pass counts minimisers; those that occur once cannot belong to a repeated window, and a bitmap of the others, of a
fixed greatest size, says which segments travel (a false hit costs a segment, never a result). Equal segments are merged in
each chunk before the shuffle and again in the shard. What is left of a shard is sorted, some minimisers'
groups at a time, by grove.llm.induced, whose queues go to disk beyond a bound of memory, and neighbours in the suffix array with a common prefix of WINDOW bytes are repeats.

Defined results: null text counts as empty; texts shorter than a window lose nothing; rows that repeat an id and a text are
two documents with the same strings, so they lose all that a window covers; a null doc_id is passed on; an empty table
gives no rows; where a cut would split a character of UTF-8, the text that dedup() gives has a replacement character (the
digests are of the bytes); columns other than doc_id and text are ignored by digests() and kept by dedup().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm import induced
from grove.llm import minimisers as mn
from grove.llm import spans as sp
from grove.llm.common import buckets_for, text_bytes
from grove.llm.minimisers import least
from grove.llm.superkmers import mixed, rolled

WINDOW, MER = 200, 64
#: Bytes of text in a chunk, of segments in a shard, and of a shard's minimiser groups that are sorted together, about.
CHUNK, SHARD, SORTED = 1 << 20, 4 << 20, 1 << 20
#: Bytes whose hashes are made at once.
BLOCK = 1 << 15
#: Windows of a segment beyond which its own repeats are found before it travels (only periodic texts have such).
LONG = 2048
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ALL, _TWICE = 1, 2  # flags: all windows are known to be repeated; the minimiser stands in the segment more than once


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """So many powers of an odd number, and those of its inverse."""
    odd = np.full((2, size), 0x9FB21C651E98DF25, np.uint64)
    odd[1] = pow(0x9FB21C651E98DF25, -1, 1 << 64)
    odd[:, 0] = 1
    return tuple(np.multiply.accumulate(odd, axis=1))


def _hashed(data: np.ndarray, mer: int, size: int) -> np.ndarray:
    """A hash, never zero, of each run of `mer` bytes, from one running sum; size: bytes of data at most."""
    powers, inverse = _powers(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[: len(data)], out=total[1:])
    h = total[mer:] - total[:-mer]
    return mixed(h * inverse[: len(h)]) | np.uint64(1)


def _minimised(texts: list[bytes], width: int, mer: int) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts, none shorter than a window, one after the other: first byte, number of windows and
    minimiser of each run of them that shares a minimiser; where the minimisers of windows stand, and their hashes.

    This is done BLOCK bytes at a time, so that the passes over hashes stay in a processor's cache.
    """
    data, reach = np.frombuffer(b"".join(texts), np.uint8), width - mer
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    windows, last = len(data) - width + 1, np.uint64(0)
    first, value, place, hashes = [], [], [], []
    for at in range(0, windows + reach, BLOCK):
        low, high = max(0, at - reach), min(at + BLOCK, windows + reach)
        stop = min(high, windows)
        h = _hashed(data[low : stop + width - 1], mer, BLOCK + reach + width)
        minimum = least(h, reach + 1).copy()  # of one entry each it is a view
        near = ends[np.searchsorted(ends, low) : np.searchsorted(ends, stop + width)]
        for e in (near - low).tolist():  # windows that reach into the next text
            minimum[max(0, e - width + 1) : e] = 0
        own = minimum[at - low :]
        if len(own):
            new = own != np.append(last, own[:-1])
            new[near[(near >= at) & (near < stop)] - at] = True
            first.append(at + np.flatnonzero(new))
            value.append(own[new])
            last = own[-1]
        # those whose hash is the greatest of the minima of the windows around them
        around = np.zeros(reach + high - at, np.uint64)
        around[reach + low - at : reach + stop - at] = minimum
        h = h[at - low : high - low]
        stands = np.flatnonzero(~least(~around, reach + 1) == h)
        place.append(at + stands)
        hashes.append(h[stands])
    first, value, place, hashes = (np.concatenate(x) for x in (first, value, place, hashes))
    real = value > 0
    return first[real], np.diff(first, append=windows)[real], value[real], place, hashes


def _selected(texts: list[bytes], width: int, mer: int) -> np.ndarray:
    long = [t for t in texts if len(t) >= width]
    return _minimised(long, width, mer)[-1] if long else np.zeros(0, np.uint64)


def _again(text: bytes, width: int) -> np.ndarray:
    """Which windows of one text repeat inside it, first ones included, and which of them are first."""
    h = rolled(_BYTES[np.frombuffer(text, np.uint8)], width)
    order = np.argsort(h, kind="stable")
    new = np.concatenate(([True], h[order][1:] != h[order][:-1]))
    head = np.empty(len(h), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))]
    # windows are compared with their heads run by run
    shift = np.concatenate(([True], np.diff(head) != 1))
    begin = np.flatnonzero(shift)
    for a, b in zip(begin.tolist(), np.append(begin[1:], len(h)).tolist()):
        if head[a] != a and text[a : b + width - 1] != text[head[a] : head[a] + b - a + width - 1]:
            known: dict[bytes, int] = {}
            head = np.array([known.setdefault(text[i : i + width], i) for i in range(len(h))])
            break
    is_head = head == np.arange(len(h))
    return np.bincount(head, minlength=len(h))[head] > 1, is_head


def _sent(batches: Iterator[pd.DataFrame], bitmap: mn.Bitmap, n_shards: int, width: int, mer: int, chunk: int) -> Iterator[pd.DataFrame]:
    flags = mn.unpacked(bitmap)
    for ids, ths, places, texts in sp.chunks(batches, chunk, sp.byte_pieces(width)):
        long = [i for i, t in enumerate(texts) if len(t) >= width]
        ids, ths, places, texts = ids[long], ths[long], places[long], [texts[i] for i in long]
        if not texts:
            continue
        lo, windows, value, place, h = _minimised(texts, width, mer)
        kept = mn.hits(flags, bitmap.bits, value)
        if not kept.any():
            continue
        lo, windows, value = lo[kept], windows[kept], value[kept]
        joined = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        doc = np.searchsorted(ends, lo, "right")
        begin = places[doc] + lo - np.append(0, ends)[doc]
        # where the minimiser stands: the segment's runs of `mer` bytes that have its hash
        a, b = np.searchsorted(place, lo), np.searchsorted(place, lo + windows + width - mer)
        n = b - a
        inside = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        stands = np.add.reduceat((h[inside] == np.repeat(value, n)).astype(np.int64), np.cumsum(n) - n)
        flag = np.where(stands > 1, _TWICE, 0)
        pieces, spans = [], []
        for i in np.flatnonzero(windows > LONG).tolist():  # periodic texts: one of each repeated window is enough
            text = joined[lo[i] : lo[i] + windows[i] + width - 1]
            again, head = _again(text, width)
            x, y = sp.runs(again)
            spans.append(sp.make_spans(np.repeat(ids[doc[i]], len(x)), np.repeat(ths[doc[i]], len(x)), begin[i] + x, begin[i] + y + width))
            x, y = sp.runs(head, again)
            pieces += [(lo[i] + p, q - p + 1, value[i], doc[i], begin[i] + p, _TWICE | _ALL * int(again[p])) for p, q in zip(x.tolist(), y.tolist())]
        short = windows <= LONG
        columns = [x[short] for x in (lo, windows, value, doc, begin, flag)]
        if pieces:
            columns = [np.concatenate((x, np.array(y, x.dtype))) for x, y in zip(columns, zip(*pieces))]
        lo, windows, value, doc, begin, flag = columns
        size = windows + width - 1
        slices = [joined[x : x + s] for x, s in zip(lo.tolist(), size.tolist())]
        known: dict[bytes, int] = {}
        head = np.array([known.setdefault(s, i) for i, s in enumerate(slices)], np.int64)
        many = np.bincount(head, minlength=len(head))[head] > 1
        x = np.flatnonzero(many)
        spans.append(sp.make_spans(ids[doc[x]], ths[doc[x]], begin[x], begin[x] + windows[x] + width - 1))
        flag = np.where(many, flag | _ALL, flag)
        go = np.flatnonzero(head == np.arange(len(head)))
        meta = sp.make_meta(ids[doc[go]], ths[doc[go]], begin[go], windows[go], size[go], flag[go], value[go])
        yield sp.pack(((value[go] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % n_shards, meta, [slices[i] for i in go.tolist()], np.concatenate(spans), n_shards)


def repeats(segments: list[bytes], width: int, store: induced.Store) -> list[np.ndarray]:
    """For each of different segments, which of its windows also start elsewhere in them; by the suffix array of all."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
    ends = np.cumsum(sizes) - 1
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).copy()
    symbols[symbols == 0] = 255  # a byte that UTF-8 never has stands for zero, out of the way of the ends
    symbols[ends] = 0
    left = np.repeat(ends, sizes) - np.arange(len(symbols))  # bytes up to the end of the segment
    valid = left >= width
    twice = np.zeros(len(symbols), bool)
    last = 0
    for suffixes, prefix in induced.descending(induced.Text(symbols, store.limit), width, store):
        same = np.flatnonzero(prefix >= width)
        twice[suffixes[same]] = True
        twice[np.append(last, suffixes[:-1])[same]] = True
        last = suffixes[-1]
    twice &= valid
    return [twice[e - s + 1 : e - width + 1] for s, e in zip(sizes.tolist(), ends.tolist())]


def _met(frame: pd.DataFrame, width: int, together: int, memory: int) -> pd.DataFrame:
    meta, body, spans = sp.unpack(frame)
    if not len(meta):
        return sp.as_frame(spans)
    hi = np.cumsum(meta["size"].astype(np.int64))
    slices = [body[a:b] for a, b in zip((hi - meta["size"]).tolist(), hi.tolist())]
    known: dict[bytes, int] = {}
    head = np.array([known.setdefault(s, i) for i, s in enumerate(slices)], np.int64)
    many = np.bincount(head, minlength=len(head))[head] > 1
    told = meta["flag"] & _ALL > 0
    whole = many | told
    out = [spans]
    x = np.flatnonzero(many & ~told)
    m = meta[x]
    out.append(sp.make_spans(m["doc_id"], m["th"], m["start"], m["start"] + m["windows"] + width - 1))
    # one of each segment goes on, if others share its minimiser or it holds it twice itself
    heads = np.flatnonzero(head == np.arange(len(head)))
    _, group, n = np.unique(meta["minimiser"][heads], return_inverse=True, return_counts=True)
    go = heads[(n[group] > 1) | (meta["flag"][heads] & _TWICE > 0)]
    go = go[np.argsort(meta["minimiser"][go], kind="stable")]
    store = induced.Store(memory)
    try:
        for mine in _lots(go, meta["minimiser"][go], meta["size"][go].astype(np.int64), together):
            for i, twice in zip(mine.tolist(), repeats([slices[i] for i in mine.tolist()], width, store)):
                if not whole[i] and twice.any():
                    a, b = sp.runs(twice)
                    m = meta[i]
                    out.append(sp.make_spans(np.repeat(m["doc_id"], len(a)), np.repeat(m["th"], len(a)), m["start"] + a, m["start"] + b + width))
    finally:
        store.close()
    return sp.as_frame(np.concatenate(out))


def _lots(rows: np.ndarray, group: np.ndarray, size: np.ndarray, together: int) -> list[np.ndarray]:
    """Rows sorted by group, as lots of whole groups of about so many bytes."""
    if not len(rows):
        return []
    new = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    total = np.add.reduceat(size, new)
    return np.split(rows, new[np.flatnonzero(np.diff((np.cumsum(total) - total) // together)) + 1])


def repeated_spans(docs: DataFrame, width: int = WINDOW, mer: int = MER, chunk: int = CHUNK, shard: int = SHARD, together: int = SORTED, memory: int = induced.MEMORY) -> DataFrame:
    """Spans of bytes (s to e, e not included) that strings of `width` bytes cover which start elsewhere too, by key."""
    own, size = sp.keyed(docs), text_bytes(docs)
    # a minimiser every (width - mer + 2) / 2 bytes
    bitmap = mn.repeated(own, lambda t: _selected(t, width, mer), size, 2 * size // (width - mer + 2), chunk, sp.byte_pieces(width))
    n = buckets_for(size, shard)
    sent = own.mapInPandas(lambda b: _sent(b, bitmap, n, width, mer, chunk), sp.PACKED)
    return sent.groupBy("bucket").applyInPandas(lambda f: _met(f, width, together, memory), sp.SPAN)


def _without(text: str, s: np.ndarray, e: np.ndarray) -> tuple:
    data, gone = text.encode(), sp.merged(s, e)
    return len(data), sum(b - a for a, b in gone), len(gone), sp.sha256(b"".join(sp.outside(data, gone)))


def _kept_text(text: str, s: np.ndarray, e: np.ndarray) -> tuple:
    return (b"".join(sp.outside(text.encode(), sp.merged(s, e))).decode("utf-8", "replace") if len(s) else text,)


def digests(docs: DataFrame, width: int = WINDOW, **sizes: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document."""
    names, schema = ["n_bytes", "n_removed", "n_spans", "kept_sha256"], "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return sp.applied(docs, repeated_spans(docs, width, **sizes), _without, names, schema)


def dedup(docs: DataFrame, width: int = WINDOW, **sizes: int) -> DataFrame:
    """The documents with the text that stays, and n_chars of it if they have that column; a text that loses all is empty."""
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    done = sp.applied(docs, repeated_spans(docs, width, **sizes), _kept_text, ["__kept"], "__kept string", others).withColumnRenamed("__kept", "text")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])

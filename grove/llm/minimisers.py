"""Which minimisers stand in more than one place of the corpus: only these can belong to a repeated window.

Chunks count the hashes of their minimisers and send them, packed by range, to be added up. The answer is a bitmap of a
fixed greatest size, by the first bits of the hash; a false hit sends a segment more on its way and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame

from grove.llm import spans as sp
from grove.llm.common import buckets_for

#: Bits of a minimiser's hash that it is counted by, and the first of them, by which ranges are made.
HASH, HEAD = 48, 17
#: The bitmap has 2 ** BITS[0] bits at least, HEAD + 3 so that ranges are whole bytes, and 2 ** BITS[1] (128 MB) at most.
BITS = (HEAD + 3, 30)


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` entries."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def chosen(h: np.ndarray, at: np.ndarray, minimiser: np.ndarray, reach: int) -> np.ndarray:
    """Which entries of h are the minimiser of a window: windows start at `at` and hold reach + 1 entries.

    Those whose hash is the greatest of the minima of the windows around them.
    """
    around = np.zeros(len(h) + 2 * reach, np.uint64)
    around[at + reach] = minimiser
    return ~least(~around, reach + 1)[: len(h)] == h


def _counted(batches: Iterator[pd.DataFrame], select: Callable[[list[bytes]], np.ndarray], ranges: int, chunk: int, cut: sp.Cut) -> Iterator[pd.DataFrame]:
    for _, _, _, texts in sp.chunks(batches, chunk, cut):
        place, n = np.unique((select(texts) >> np.uint64(64 - HASH)).astype(np.int64), return_counts=True)
        part = (place >> (HASH - HEAD)) * ranges >> HEAD
        for s in np.unique(part):
            mine = part == s
            body = np.diff(place[mine], prepend=0).tobytes() + np.minimum(n[mine], 2).astype(np.uint8).tobytes()
            yield pd.DataFrame([(int(s), zstandard.compress(body, 1))], columns=["bucket", "body"])


def _segment(frame: pd.DataFrame, ranges: int, bits: int) -> pd.DataFrame:
    """A range's bytes of the bitmap: a range begins where a hash's first HEAD bits say so, which is the start of a byte."""
    s = int(frame["bucket"].iloc[0])
    low, high = (-(-(x << HEAD) // ranges) << (bits - HEAD) for x in (s, s + 1))
    places, counts = [], []
    for body in map(zstandard.decompress, frame["body"]):
        n = len(body) // 9
        places.append(np.cumsum(np.frombuffer(body, "<i8", n)))
        counts.append(np.frombuffer(body, np.uint8, n, 8 * n))
    place, at = np.unique(np.concatenate(places), return_inverse=True)
    flags = np.zeros(high - low, bool)
    flags[(place[np.bincount(at, np.concatenate(counts)) > 1] >> (HASH - bits)) - low] = True
    return pd.DataFrame({"at": [low // 8], "body": [zstandard.compress(np.packbits(flags).tobytes(), 1)]})


@dataclass(frozen=True)
class Bitmap:
    """Marks by hash: compressed segments, in a broadcast, and the number of address bits."""

    segments: Broadcast
    bits: int


def repeated(own: DataFrame, select: Callable[[list[bytes]], np.ndarray], size: int, expected: int, chunk: int, cut: sp.Cut) -> Bitmap:
    """own: doc_id, th and text; select: the hashes of a chunk's minimisers, one for each place; size: bytes of all texts;
    expected: how many minimisers, about; cut: how long texts are cut (a minimiser at a cut may count twice: a false hit).

    Each range of hashes makes its own bytes of the bitmap, and the driver passes them on compressed: never the hits, and
    never more than the bitmap's greatest size.
    """
    bits = min(BITS[1], max(BITS[0], (8 * expected).bit_length()))
    ranges = min(1 << HEAD, buckets_for(size, 64 << 20))
    counted = own.mapInPandas(lambda b: _counted(b, select, ranges, chunk, cut), "bucket bigint, body binary")
    made = counted.groupBy("bucket").applyInPandas(lambda f: _segment(f, ranges, bits), "at bigint, body binary")
    segments = [(r["at"], bytes(r["body"])) for r in made.toLocalIterator()]
    return Bitmap(own.sparkSession.sparkContext.broadcast(segments), bits)  # 2 ** BITS[1] bits at most


def unpacked(bitmap: Bitmap) -> np.ndarray:
    """The bitmap's bytes."""
    flags = np.zeros(1 << (bitmap.bits - 3), np.uint8)
    for at, body in bitmap.segments.value:
        part = np.frombuffer(zstandard.decompress(body), np.uint8)
        flags[at : at + len(part)] = part
    return flags


def hits(flags: np.ndarray, bits: int, minimiser: np.ndarray) -> np.ndarray:
    """Whether each minimiser is marked in the packed bits."""
    place = minimiser >> np.uint64(64 - bits)
    return (flags[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7)).astype(np.uint8))) & 1 > 0

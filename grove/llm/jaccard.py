"""Exact Jaccard similarity of texts' sets of word shingles: what confirms the candidates of grove.llm.simhash.

Texts with equal sets are one set from here on. Sets that may be similar share a MinHash band: BANDS bands of ROWS minima
each, so that two sets at similarity 0.8 share no band in about 3 of a million cases, and more similar ones more rarely.
Only texts of clusters of candidates travel again: a cluster meets in one task, or in pairs of parts where it is large, and
there each two sets are compared exactly unless they are known to be of one class.

Defined results: words are lower-cased as in SimHash; texts of fewer words than a shingle are one shingle; null texts and
texts without words have the empty set and one class; classes are transitive; columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import give_back, small_batches
from grove.llm.spans import word_pieces
from grove.storage import cut

WIDTH, SEED = 5, 42
#: Similarity from which texts are near copies, in hundredths: compared without rounding.
LEAST = 80
BANDS, ROWS = 32, 5
#: Bytes of a text that are split into words at once, about.
PIECE = 1 << 20
#: Sets and bytes of text of a part of a cluster, about.
PART, PART_BYTES = 2048, 4 << 20
_RNG = np.random.default_rng(SEED)
_MASK = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_ODD = _RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def hashed_shingles(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles in order, some at a time, so that a long text is never a list of all its words.

    A text of fewer words than a shingle is one shingle; one without words has none.
    """
    data = text.encode()
    for first, piece in word_pieces(width)(data, PIECE) if len(data) > 2 * PIECE else [(0, data)]:
        words = piece.lower().split()
        n = len(words) - width + 1
        joined = b" ".join(words)
        if n > 0:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            runs = [joined[s:e] for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist())]
            yield np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)
        elif words and not first:
            yield np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    found = list(hashed_shingles(text, width))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def bands(own: np.ndarray) -> list[int]:
    """A signed key for each band of a set; the empty set has none."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 1024):
        np.minimum(least, ((own[i : i + 1024] ^ _MASK) * _ODD).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def similar(texts: list[str], least: int = LEAST) -> np.ndarray:
    """For each text the index of its class among them: a smaller one of its class, or itself."""
    n = len(texts)
    label = np.arange(n)
    found = [shingles(t) for t in texts]
    size = np.fromiter(map(len, found), np.int64, n)
    _, at = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.repeat(label, size)
    posted = owner[np.argsort(at, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(at))))
    begin = np.concatenate(([0], np.cumsum(size)))
    for i in range(n):
        if (label == label[0]).all():
            break
        if (label[i + 1 :] == label[i]).all():
            continue
        mine = at[begin[i] : begin[i + 1]]
        # how many of its shingles each text has, counted by runs of shingles so that memory stays bounded
        shared = np.zeros(n, np.int64)
        for k in range(0, len(mine), 256):
            shared += np.bincount(np.concatenate([posted[first[x] : first[x + 1]] for x in mine[k : k + 256].tolist()]), minlength=n)
        near = np.flatnonzero(100 * shared >= least * (size + size[i] - shared))
        classes = np.unique(label[near])
        if len(classes) > 1:
            label[np.isin(label, classes)] = classes[0]
    return label


def dealt(texts: DataFrame, part: int = PART, part_bytes: int = PART_BYTES) -> DataFrame:
    """texts (root, sid, text) -> (root, i, j, sid, text): groups (root, i, j) in which parts i and j of a cluster meet."""
    sizes = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    sizes = sizes.select("root", F.ceil(F.greatest(F.col("n") / part, F.col("b") / part_bytes)).cast("int").alias("k")).where("k > 1")
    # written, so that few rows are broadcast by Spark's own size check and no text moves for them
    rows = texts.join(cut(sizes, "cluster-sizes"), "root", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("k = 1 OR part <> other")
    return rows.select("root", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "sid", "text")


def links(texts: DataFrame, part: int = PART, part_bytes: int = PART_BYTES) -> DataFrame:
    """texts (root, sid, text), sid distinct -> edges (a, b) that span the classes of each cluster."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sids, texts = None, [], []

        def solved() -> pd.DataFrame:
            sid, label = np.array(sids, np.int64), similar(texts)
            mine = np.flatnonzero(label != np.arange(len(label)))
            return pd.DataFrame({"a": sid[mine], "b": sid[label[mine]]})

        for batch in batches:
            for *head, sid, text in batch[["root", "i", "j", "sid", "text"]].itertuples(index=False, name=None):
                if head != key:
                    if len(sids) > 1:
                        yield solved()
                        give_back()
                    key, sids, texts = head, [], []
                sids.append(sid)
                texts.append(text)
        if len(sids) > 1:
            yield solved()
        del sids, texts
        give_back()

    groups = ["root", "i", "j"]
    met = dealt(small_batches(texts), part, part_bytes).repartition(*groups).sortWithinPartitions(*groups)
    return met.mapInPandas(rows, "a bigint, b bigint")

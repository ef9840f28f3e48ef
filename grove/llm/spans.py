"""What the two substring operators share: packed segments on their way to buckets, and spans on their way back to texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import give_back, small_batches

#: Stands for a null doc_id inside packed segments: such rows come before all others.
NO_ID = -(1 << 63)
SPAN = "doc_id bigint, th bigint, s int, e int"
PACKED = "bucket bigint, meta binary, body binary, spans binary"
_META = np.dtype([("doc_id", "<i8"), ("th", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("size", "<i4"), ("flag", "<i4"), ("minimiser", "<u8")])
_SPANS = np.dtype([("doc_id", "<i8"), ("th", "<i8"), ("s", "<i4"), ("e", "<i4")])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, th and text of each document; rows with one id and one text share their key (doc_id, th)."""
    text = F.coalesce("text", F.lit(""))
    return small_batches(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


Cut = Callable[[bytes, int], Iterator[tuple[int, bytes]]]


def byte_pieces(width: int) -> Cut:
    """Cuts a text such that each window of `width` bytes is in one piece; pieces come with the place of their first byte."""

    def cut(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
        for at in range(0, max(1, len(text) - width + 1), size):
            yield at, text[at : at + size + width - 1]

    return cut


_SPACE = re.compile(rb"[\x09-\x0d ]")


def word_pieces(width: int) -> Cut:
    """Cuts a text such that each window of `width` words is in one piece; pieces come with the number of their first word."""

    def cut(text: bytes, size: int) -> Iterator[tuple[int, bytes]]:
        at, word, end = 0, 0, size
        while True:
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
            piece = np.frombuffer(text, np.uint8, end - at, at)
            blank = (piece == 32) | (piece >= 9) & (piece <= 13)
            starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
            more = len(starts) - width + 1
            if end == len(text) or more > 0:
                yield word, text[at:end]
                if end == len(text):
                    return
                at, word = at + int(starts[more]) if width > 1 else end, word + more
                end = at + size
            else:
                end += size

    return cut


def chunks(batches: Iterator[pd.DataFrame], size: int, cut: Cut) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, text hashes, places and encoded texts of about `size` bytes at a time; longer texts in pieces, so that no text is a chunk."""
    held, n = [], 0
    for batch in batches:
        for doc_id, th, text in zip(batch["doc_id"].tolist(), batch["th"].tolist(), batch["text"]):
            text = text.encode()
            for at, piece in cut(text, size) if len(text) > 2 * size else [(0, text)]:
                held.append((doc_id, th, at, piece))
                n += len(piece)
                if n >= size:
                    yield _columns(held)
                    held, n = [], 0
                    give_back()
    if held:
        yield _columns(held)


def _columns(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    ids, ths, at, texts = zip(*held)
    return np.array(ids, np.int64), np.array(ths, np.int64), np.array(at, np.int64), list(texts)


def runs(keep: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of true values in keep over which all arrays in same stay equal."""
    at = np.flatnonzero(keep)
    if not len(at):
        return at, at
    new = np.diff(at) > 1
    for x in same:
        new |= x[at[1:]] != x[at[:-1]]
    first = np.concatenate(([True], new))
    return at[first], at[np.concatenate((new, [True]))]


def pack(buckets: np.ndarray, meta: np.ndarray, slices: list[bytes], spans: np.ndarray, n_buckets: int) -> pd.DataFrame:
    """A row a bucket: its segments' heads and their texts in one packed string each; spans go with any bucket."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(buckets[order]) != 0, [True]))) if len(order) else np.zeros(1, int)
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        mine = order[a:b]
        out.append((int(buckets[mine[0]]), zstandard.compress(meta[mine].tobytes(), 1), zstandard.compress(b"".join([slices[i] for i in mine.tolist()]), 1), None))
    if len(spans):
        home = (spans["doc_id"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_buckets
        for h in np.unique(home):
            out.append((int(h), None, None, zstandard.compress(spans[home == h].tobytes(), 1)))
    return pd.DataFrame(out, columns=["bucket", "meta", "body", "spans"])


def unpack(frame: pd.DataFrame) -> tuple[np.ndarray, bytes, np.ndarray]:
    """The segments' heads and texts, and the spans, that have met in a bucket."""
    full = frame["meta"].notna()
    meta = [np.frombuffer(zstandard.decompress(m), _META) for m in frame["meta"][full]]
    body = b"".join([zstandard.decompress(b) for b in frame["body"][full]])
    spans = [np.frombuffer(zstandard.decompress(s), _SPANS) for s in frame["spans"].dropna()]
    return np.concatenate(meta) if meta else np.zeros(0, _META), body, np.concatenate(spans) if spans else np.zeros(0, _SPANS)


def make_spans(doc_id: np.ndarray, th: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    out = np.empty(len(s), _SPANS)
    out["doc_id"], out["th"], out["s"], out["e"] = doc_id, th, s, e
    return out


def make_meta(doc_id: np.ndarray, th: np.ndarray, start: np.ndarray, windows: np.ndarray, size: np.ndarray, flag: np.ndarray | int = 0, minimiser: np.ndarray | int = 0) -> np.ndarray:
    out = np.empty(len(start), _META)
    out["minimiser"] = minimiser
    out["doc_id"], out["th"], out["start"], out["windows"], out["size"], out["flag"] = doc_id, th, start, windows, size, flag
    return out


def as_frame(spans: np.ndarray) -> pd.DataFrame:
    """Spans as rows, once the work of a bucket is done."""
    give_back()
    return pd.DataFrame({c: spans[c] for c in ("doc_id", "th", "s", "e")})


def merged(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that spans [s, e) cover together, in order; spans that touch make one run."""
    if not len(s):
        return []
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(s[1:] > e[:-1]) + 1
    return list(zip(s[np.append(0, new)].tolist(), e[np.append(new - 1, len(e) - 1)].tolist()))


def outside(data: bytes | list, runs: list[tuple[int, int]]) -> list:
    """The slices of data between the runs."""
    ends = [0, *(e for _, e in runs)]
    return [data[a:b] for a, b in zip(ends, [*(s for s, _ in runs), len(data)])]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def applied(docs: DataFrame, spans: DataFrame, result: Callable[[str, np.ndarray, np.ndarray], tuple], names: list[str], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """result(text, s, e) of each document, beside doc_id and the columns in keep.

    Spans and documents travel to one partition by key and are read in order, the spans of a key before its documents, so
    a task holds the spans of one document and a batch of rows.
    """
    text = F.coalesce("text", F.lit(""))
    extra = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("struct<x:int>")
    own = small_batches(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"), extra.alias("extra"), F.lit(True).alias("is_doc"))
    both = own.unionByName(spans.withColumn("is_doc", F.lit(False)), allowMissingColumns=True)
    shape = own.schema["extra"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s, e = None, [], []
        for batch in batches:
            out = []
            is_doc = batch["is_doc"].to_numpy(bool)
            ids, ths = batch["doc_id"].to_numpy(np.int64), batch["th"].to_numpy(np.int64)
            new = np.concatenate(([True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1]) | (is_doc[1:] != is_doc[:-1]) | is_doc[1:]))
            edges = np.append(np.flatnonzero(new), len(batch)).tolist()
            starts, ends = batch["s"].to_numpy(), batch["e"].to_numpy()
            texts, extras = batch["text"].to_numpy(), batch["extra"].to_numpy()
            for a, b in zip(edges, edges[1:]):
                mine = (ids[a], ths[a])
                if mine != key:
                    key, s, e = mine, [], []
                if is_doc[a]:
                    x, y = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (s, e))
                    out.append((None if ids[a] == NO_ID else int(ids[a]), extras[a], *result(texts[a], x, y)))
                else:
                    s.append(starts[a:b])
                    e.append(ends[a:b])
            frame = pd.DataFrame(out, columns=["doc_id", "extra", *names])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame
            give_back()

    met = both.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", "is_doc")
    done = met.mapInPandas(rows, f"doc_id bigint, extra {shape}, {schema}")
    return done.select("doc_id", *names) if not keep else done.select(*[F.col(f"extra.`{c}`").alias(c) for c in keep], *names)

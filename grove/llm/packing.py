"""Best-fit decreasing packing of token sequences.

Documents are cut into pieces of at most `capacity` tokens. Best-fit decreasing takes pieces by falling length and puts
each into the tightest sequence that it fits. Lengths are integers up to the capacity, so the exact run over all documents
needs only the number of pieces of each length: a segment tree over remaining capacities finds the tightest open capacity
in logarithmic time, and all sequences of one remaining capacity are filled by one entry of the plan. The plan depends on
the capacity, not on the number of documents. The pieces then look up their place by their rank within their length, a
rank that is dealt out bucket by bucket, so that no task holds all pieces of a common length, nor all rows of one id.

Defined results: null and empty texts are the end token alone, one piece of length 1; repeated rows are packed each for
itself, and ties in length are broken by id, piece and start; null ids come first; an empty table gives no rows; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grove.llm.bpe import byte_letters
from grove.llm.common import small_batches
from grove.storage import cut

CAPACITY = 2048
#: Words whose ids a worker keeps, and the longest of them in characters.
KEPT, KEPT_CHARS = 600_000, 64
#: Plans of up to so many entries are broadcast (48 bytes each); longer ones are joined by a shuffle.
BROADCAST_ENTRIES = 200_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass(frozen=True)
class Fill:
    """Pieces of `length` with ranks from `rank` on, `items` of them: `each` to a sequence from `sequence` on, at `offset`."""

    length: int
    rank: int
    items: int
    sequence: int
    each: int
    offset: int


class Capacities:
    """A segment tree over remaining capacities: which of them open sequences have."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.base)

    def mark(self, remaining: int, there: bool) -> None:
        at = remaining + self.base
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity of at least `least`."""
        at = least + self.base
        if self.any[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.base
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Fill]:
    """What best-fit decreasing does with counts[length] pieces of each length, as ranges of ranks and sequences."""
    tree, free, fills, made = Capacities(capacity), defaultdict(list), [], 0

    def give(remaining: int, sequence: int, n: int) -> None:
        if n and remaining:
            if not free[remaining]:
                tree.mark(remaining, True)
            free[remaining].append((sequence, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first = capacity, made
                there = -(-left // (capacity // length))
                made += there
            else:
                first, there = free[remaining].pop()
                if not free[remaining]:
                    tree.mark(remaining, False)
            each = remaining // length
            full = min(there, left // each)
            if full:
                fills.append(Fill(length, rank, full * each, first, each, capacity - remaining))
                give(remaining - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = min(left, each) if full < there else 0
            if rest:
                fills.append(Fill(length, rank, rest, first + full, rest, capacity - remaining))
                give(remaining - rest * length, first + full, 1)
                rank, left = rank + rest, left - rest
            give(remaining, first + full + bool(rest), there - full - bool(rest))
    return fills


class Words(dict):
    """The ids of words as little-endian bytes, found out once each; a word is what stands between spaces or newlines.

    A word of letters alone is one piece to the vocabulary's splitting pattern, so the model's merges get it at once, in
    lower case; full stops and commas at a word's end are a piece of their own. All else goes the library's whole way.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        letters = {b: c for c, b in byte_letters().items()}
        self.letters = [letters[b] for b in range(256)]

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(".,")
        if stem != word and stem and normalize("NFC", stem[-1]).lower().isalpha():  # a letter, and one after composition
            ids = self[stem] + self[word[len(stem) :]]
        elif (lower := word.lower()).isalpha() and word.isalpha() and "\u03a3" not in word and is_normalized("NFC", word):
            seen = lower if lower.isascii() else "".join(self.letters[b] for b in lower.encode())
            ids = np.array([t.id for t in self.merges(seen)], dtype="<u4").tobytes()
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def word_ids(path: str) -> Words:
    return Words(path)


def _encoded(path: str, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text, little-endian; the vocabulary drops white space, so words are encoded apart."""
    known = word_ids(path).__getitem__
    for t in texts:
        yield b"".join(map(known, t.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row a piece: doc_id, piece, start, length and crc32 of its ids."""
    last = np.array([end], dtype="<u4").tobytes()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"], _encoded(path, list(batch["text"]))):
                ids = ids + last
                for start in range(0, len(ids) // 4, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, start // capacity, start, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(rows, PIECES)


def place(parts: DataFrame, capacity: int = CAPACITY, rows_each: int = 20_000) -> DataFrame:
    """parts (doc_id, piece, start, length and more) with sequence_id and offset. parts is read twice: cut it before."""
    spark = parts.sparkSession
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    fills = plan(counts, capacity)
    names = ("length", "rank_from", "rank_to", "first_sequence", "each", "first_offset")
    table = pd.DataFrame([(f.length, f.rank, f.rank + f.items, f.sequence, f.each, f.offset) for f in fills], columns=names, dtype="int64")
    book = spark.createDataFrame(table, ", ".join(f"{n} bigint" for n in names))
    book = F.broadcast(book) if len(fills) <= BROADCAST_ENTRIES else book
    n = max(8, sum(counts.values()) // rows_each)
    dealt = parts.withColumn("__bucket", F.pmod(F.xxhash64(*parts.columns), F.lit(n)).cast("int"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start")
    ranked = dealt.withColumn("__row", F.row_number().over(within) - 1).join(starts, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__row")).drop("__bucket", "__before", "__row")
    met = ranked.join(book.withColumnRenamed("length", "__length"), (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("rank_from")) & (F.col("__rank") < F.col("rank_to")))
    nth = F.col("__rank") - F.col("rank_from")
    return met.select(
        *parts.columns,
        F.expr("first_sequence + (__rank - rank_from) div each").alias("sequence_id"),
        (F.col("first_offset") + nth % F.col("each") * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(cut(pieces(docs, path, capacity), "pieces"), capacity)

"""Language-model scores by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a context tree over the last DEPTH bytes, whose nodes hold counts of
zeros and ones. A node's Krichevsky-Trofimov estimate is mixed with what its children give, by the weights that the
training counts imply, over all depths: P(node) = (KT(node) + product of P(children)) / 2. The trained tree is then frozen.
A text is its tokens, as for the base score: words with A-Z in lower case, one space between two, then the end. Its score
is the log10 probability of these bytes and of an end mark, each byte after the DEPTH bytes before it. Where
training never saw a deeper context, the deepest one seen gives the estimate.

Documents are dealt into buckets. A bucket sends its distinct grams (context and byte) and words, packed, to the shards of
the model; a shard holds all contexts that end in the same two bytes, merges counts, builds its subtrees and sends back a
log probability for each gram asked. Only the nodes above the shards, 257 contexts of 255 nodes whatever the input, meet
on the driver. Word counts for the base score go the same way.

Defined results: null text counts as empty: its tokens are the end alone; rows that repeat get equal scores and each
counts in training; a null doc_id is passed on, counts as not held out, and is dealt like any other; without training rows
n_known is 0 and every binary decision has probability one half; empty tables give no rows; columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm.common import buckets_for, small_batches, text_bytes
from grove.storage import cut

DEPTH = 5
#: Contexts that end in the same so many bytes are in one shard.
TOP = 2
#: Stands before a text's first byte and after its last; never a byte of UTF-8.
EDGE = 0xFF
FOLDS, HELD_OUT = 7, 2
#: Text bytes that a bucket holds, about, and that are worked on at once.
BUCKET, CHUNK = 16 << 20, 2 << 20
GRAMS, WORDS = 0, 1
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_sum double, score double"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _squeeze(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def _expand(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, "<u8"), dtype=np.uint64)


def grams(texts: list[bytes], chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all bytes and end marks, and the text that each belongs to, about `chunk` at a time.

    A key holds the last byte before in its highest place, then the ones before that, and the byte itself lowest.
    """
    edge = bytes([EDGE])

    def keys(parts: list[bytes], owners: list[int]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        key = data[DEPTH:].copy()
        for d in range(1, DEPTH + 1):
            key |= data[DEPTH - d : len(data) - d] << np.uint64(8 * (DEPTH + 1 - d))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.array(owners), sizes)
        at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        real = at[DEPTH:] >= DEPTH
        return key[real], owner[DEPTH:][real]

    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        whole = edge * DEPTH + t + edge
        for start in range(0, max(1, len(whole) - DEPTH), chunk):
            part = whole[start : start + chunk + DEPTH]
            parts.append(part)
            owners.append(i)
            size += len(part)
            if size >= chunk:
                yield keys(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield keys(parts, owners)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else np.zeros(0, np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    ends = keys >> np.uint64(8 * (DEPTH + 1 - TOP))
    return ((ends * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards


def word_shard(words: list[bytes], shards: int) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).astype(np.int64) % shards


# --- the model of a shard -------------------------------------------------------------------------------------------

_STEPS = 1 << 16
_LOG_HALVES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_STEPS) + 0.5))))  # of Gamma(n + 1/2) / Gamma(1/2)
_LOG_WHOLE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(_STEPS) + 1.0))))  # of n!


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for large arguments."""
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""

    def halves(n: np.ndarray) -> np.ndarray:
        return np.where(n <= _STEPS, _LOG_HALVES[np.minimum(n, _STEPS)], _log_gamma(np.maximum(n, _STEPS) + 0.5) - 0.5 * math.log(math.pi))

    n = n0 + n1
    whole = np.where(n <= _STEPS, _LOG_WHOLE[np.minimum(n, _STEPS)], _log_gamma(np.maximum(n, _STEPS) + 1.0))
    return halves(n0) + halves(n1) - whole


class Level:
    """The nodes of one depth and one number of bits already known, in order of their keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bits: int) -> None:
        node = keys >> np.uint64(8 - bits)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1]))) if len(node) else np.zeros(0, np.int64)
        one = counts * ((keys >> np.uint64(7 - bits)) & np.uint64(1)).astype(np.int64)
        self.node = node[first]
        self.n1 = np.add.reduceat(one, first) if len(first) else np.zeros(0, np.int64)
        self.n0 = (np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)) - self.n1
        self.log_kt = log_kt(self.n0, self.n1)
        self.log_p = self.log_kt
        self.own = np.ones(len(self.node))

    def mix(self, below: Level, bits: int) -> None:
        """Takes in the children: nodes one byte of context deeper, with the same bits known."""
        known = below.node & np.uint64((1 << bits) - 1)
        parent = (below.node >> np.uint64(bits + 8)) << np.uint64(bits) | known
        children = np.bincount(np.searchsorted(self.node, parent), below.log_p, len(self.node))
        self.weigh(children)

    def weigh(self, children: np.ndarray) -> None:
        both = np.logaddexp(self.log_kt, children)
        self.own = np.exp(self.log_kt - both)  # the weight of this node's own estimate
        self.log_p = both - math.log(2)

    def ones(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1)

    def find(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.node):
            return np.zeros(len(node), np.int64), np.zeros(len(node), bool)
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return at, self.node[at] == node


def levels(keys: np.ndarray, counts: np.ndarray, least: int, most: int) -> dict[int, list[Level]]:
    """Of each depth from least to most the nodes by bits known, mixed from the deepest up; keys go down to most."""
    out: dict[int, list[Level]] = {}
    for depth in range(most, least - 1, -1):
        out[depth] = [Level(keys, counts, bits) for bits in range(8)]
        if depth < most:
            for bits in range(8):
                out[depth][bits].mix(out[depth + 1][bits], bits)
        if depth > least:
            shorter = (keys >> np.uint64(16)) << np.uint64(8) | keys & np.uint64(0xFF)
            keys, counts = _merged([(shorter, counts)])
    return out


def descend(found: dict[int, list[Level]], keys: np.ndarray, bits: int, depths: range, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For grams with contexts of `most` bytes: the probability of a one after `bits` bits from the depths, deepest first."""
    p, seen = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
    for depth in depths:
        level = found[depth][bits]
        context = keys >> np.uint64(8 * (most - depth + 1))
        node = context << np.uint64(bits) | (keys & np.uint64(0xFF)) >> np.uint64(8 - bits)
        at, here = level.find(node)
        if not len(level.node):
            continue
        kt = level.ones()[at]
        own = level.own[at]
        p = np.where(here, np.where(seen, own * kt + (1 - own) * p, kt), p)
        seen = seen | here
    return p, seen


def top_rows(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """What a shard adds to the nodes of depth TOP - 1: counts, and the log probabilities of their children here."""
    found = levels(keys, counts, TOP, DEPTH)[TOP]
    frames = []
    for bits, level in enumerate(found):
        known = level.node & np.uint64((1 << bits) - 1)
        parent = (level.node >> np.uint64(bits + 8)) << np.uint64(bits) | known
        frames.append(pd.DataFrame({"bits": bits, "node": parent.astype(np.int64), "n0": level.n0, "n1": level.n1, "children": level.log_p}).groupby(["bits", "node"], as_index=False).sum())
    return pd.concat(frames, ignore_index=True)


def top_levels(rows: pd.DataFrame) -> dict[int, list[Level]]:
    """The nodes above the shards: depths TOP - 1 and less, from the sums of all shards' rows."""
    found: dict[int, list[Level]] = {TOP - 1: []}
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for bits in range(8):
        part = rows[rows["bits"] == bits].sort_values("node")
        level = Level(*empty, bits)
        level.node, level.n0, level.n1 = part["node"].to_numpy().astype(np.uint64), part["n0"].to_numpy(np.int64), part["n1"].to_numpy(np.int64)
        level.log_kt = log_kt(level.n0, level.n1)
        level.weigh(part["children"].to_numpy(float))
        found[TOP - 1].append(level)
    for depth in range(TOP - 2, -1, -1):
        found[depth] = []
        for bits, below in enumerate(found[depth + 1]):
            known = below.node & np.uint64((1 << bits) - 1)
            parent = (below.node >> np.uint64(bits + 8)) << np.uint64(bits) | known
            level = Level(*empty, bits)
            level.node, at = np.unique(parent, return_inverse=True)
            level.n0 = np.bincount(at, below.n0, len(level.node)).astype(np.int64)
            level.n1 = np.bincount(at, below.n1, len(level.node)).astype(np.int64)
            level.log_kt = log_kt(level.n0, level.n1)
            level.weigh(np.bincount(at, below.log_p, len(level.node)))
            found[depth].append(level)
    return found


def log10_p(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, top: dict[int, list[Level]]) -> np.ndarray:
    """log10 of the probability of each asked gram's byte after its context; keys and counts are the shard's training."""
    found = levels(keys, counts, TOP, DEPTH) | top
    total = np.zeros(len(asked))
    for bits in range(8):
        p, _ = descend(found, asked, bits, range(DEPTH, -1, -1), DEPTH)
        one = (asked >> np.uint64(7 - bits)) & np.uint64(1) == 1
        total += np.log10(np.where(one, p, 1 - p))
    return total


# --- the jobs -------------------------------------------------------------------------------------------------------


def _asked(batches: Iterator[pd.DataFrame], shards: int) -> Iterator[pd.DataFrame]:
    """What the buckets of a partition ask: packed distinct grams and words, with their counts in training rows."""

    def rows(bucket: int, parts: list, train: Counter, held: set) -> pd.DataFrame:
        keys, counts = _merged(parts)
        shard = shard_of(keys, shards)
        out = []
        for s in np.unique(shard):
            mine = shard == s
            out.append((int(s), bucket, GRAMS, pack_keys(keys[mine]), _squeeze(counts[mine].astype("<u4"))))
        words = sorted(train.keys() | held)
        shard = word_shard(words, shards)
        for s in np.unique(shard):
            mine = [words[i] for i in np.flatnonzero(shard == s)]
            counts = np.fromiter((train[w] for w in mine), np.int64, len(mine))
            out.append((int(s), bucket, WORDS, zstandard.compress(b" ".join(mine), 1), _squeeze(counts.astype("<u4"))))
        return pd.DataFrame(out, columns=["shard", "bucket", "kind", "keys", "counts"])

    bucket, parts, train, held = None, [], Counter(), set()
    for batch in batches:
        for b, group in batch.groupby("bucket", sort=False):
            if b != bucket:
                if bucket is not None:
                    yield rows(bucket, parts, train, held)
                bucket, parts, train, held = int(b), [], Counter(), set()
            for out, some in group.groupby("held_out"):
                split = [t.encode().lower().split() for t in some["text"]]
                for key, _ in grams([b" ".join(w) for w in split]):
                    keys, counts = np.unique(key, return_counts=True)
                    parts.append((keys, counts * (not out)))
                if len(parts) > 16:
                    parts = [_merged(parts)]
                for w in split:
                    (held if out else train).update(w)
    if bucket is not None:
        yield rows(bucket, parts, train, held)


def _shard_training(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = _merged([(unpack_keys(k), _expand(c, "<u4").astype(np.int64)) for k, c in zip(frame["keys"], frame["counts"])])
    return keys[counts > 0], counts[counts > 0]


def _word_counts(frame: pd.DataFrame) -> Counter:
    total: Counter = Counter()
    for k, c in zip(frame["keys"], frame["counts"]):
        for w, n in zip(zstandard.decompress(k).split(b" "), _expand(c, "<u4").tolist()):
            if n:
                total[w] += n
    return total


def _tops(frame: pd.DataFrame) -> pd.DataFrame:
    """Phase one of a shard: its part of the nodes above, and in a row of bits -1 its distinct and all training words."""
    words = _word_counts(frame[frame["kind"] == WORDS])
    out = top_rows(*_shard_training(frame[frame["kind"] == GRAMS]))
    mine = pd.DataFrame({"bits": [-1], "node": [0], "n0": [len(words)], "n1": [sum(words.values())], "children": [0.0]})
    return pd.concat([out, mine], ignore_index=True)


class Table:
    """A hash table from keys to values that is asked many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys, self.values = keys, values
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, all of which are in the table."""
        at = self._slot(keys)
        index = self.slots[at]
        wrong = np.flatnonzero(self.keys[index] != keys)
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & ((1 << self.bits) - 1)
            index[wrong] = self.slots[at]
            still = self.keys[index[wrong]] != keys[wrong]
            wrong, at = wrong[still], at[still]
        return self.values[index]


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per bucket first the answers, then its documents."""
    bucket, table, words, parts = None, None, {}, []
    for batch in batches:
        for (b, is_doc), group in batch.groupby(["bucket", "is_doc"], sort=False):
            if b != bucket:
                bucket, table, words, parts = b, None, {}, []
            if not is_doc:
                for kind, keys, values in zip(group["kind"], group["keys"], group["values"]):
                    if kind == GRAMS:
                        parts.append((unpack_keys(keys), _expand(values, "<f4")))
                    else:
                        words.update(zip(zstandard.decompress(keys).split(b" "), _expand(values, "<u4").tolist()))
                continue
            if table is None:
                table = Table(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))
                parts = []
            split = [t.encode().lower().split() for t in group["text"]]
            score = np.zeros(len(split))
            for keys, owner in grams([b" ".join(w) for w in split]):
                score += np.bincount(owner, table.get(keys), len(split))
            n_tokens, n_known, base = [], [], []
            for mine in split:
                c = np.fromiter(map(words.__getitem__, mine), np.float64, len(mine))
                n_tokens.append(len(mine))
                n_known.append(int((c > 0).sum()))
                base.append(float(np.log10(c + 1).sum()))
            yield pd.DataFrame({"doc_id": group["doc_id"].astype("Int64").to_numpy(), "held_out": group["held_out"].to_numpy(bool), "n_tokens": n_tokens, "n_known": n_known, "base_sum": base, "score": score})


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    n = buckets_for(text_bytes(docs), BUCKET)
    own = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    own = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(n)).cast("int"))
    asked = own.select("bucket", "held_out", "text").repartition(n, "bucket").sortWithinPartitions("bucket")
    asked = cut(asked.mapInPandas(lambda b: _asked(b, n), "shard int, bucket int, kind int, keys binary, counts binary"), "asked")

    tops = asked.groupBy("shard").applyInPandas(_tops, "bits int, node bigint, n0 bigint, n1 bigint, children double")
    sums = tops.groupBy("bits", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "children")]).toPandas()  # 256 contexts of 255 nodes at most
    mine = sums[sums["bits"] < 0]
    train_docs = own.where(~F.col("held_out")).select("doc_id").count()
    distinct, all_words = (int(mine["n0"].sum()), int(mine["n1"].sum())) if len(mine) else (0, 0)
    tokens, types = all_words + train_docs, distinct + (train_docs > 0)
    top = top_levels(sums[sums["bits"] >= 0])

    def answered(frame: pd.DataFrame) -> pd.DataFrame:
        ask = frame[frame["kind"] == GRAMS]
        keys, counts = _shard_training(ask)
        each = [unpack_keys(k) for k in ask["keys"]]
        every = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
        p = log10_p(keys, counts, every, top).astype("<f4")
        out = [(b, GRAMS, packed, _squeeze(p[np.searchsorted(every, k)])) for b, packed, k in zip(ask["bucket"], ask["keys"], each)]
        ask = frame[frame["kind"] == WORDS]
        total = _word_counts(ask)
        for b, packed in zip(ask["bucket"], ask["keys"]):
            words = zstandard.decompress(packed).split(b" ")
            out.append((b, WORDS, packed, _squeeze(np.fromiter((total[w] for w in words), "<u4", len(words)))))
        return pd.DataFrame(out, columns=["bucket", "kind", "keys", "values"])

    answers = asked.groupBy("shard").applyInPandas(answered, "bucket int, kind int, keys binary, values binary").withColumn("is_doc", F.lit(False))
    both = own.withColumn("is_doc", F.lit(True)).unionByName(answers, allowMissingColumns=True)
    rows = both.repartition(n, "bucket").sortWithinPartitions("bucket", "is_doc").mapInPandas(_scored, SCORES)
    end = math.log10(train_docs + 1)
    per_token = math.log10(tokens + types + 1)
    n_tokens = F.col("n_tokens") + 1
    return rows.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + F.lit(int(train_docs > 0))).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_sum") + F.lit(end) - n_tokens * F.lit(per_token)).alias("base_score"),
        "score",
    )

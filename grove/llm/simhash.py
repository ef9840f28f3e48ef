"""SimHash fingerprints and their near-duplicate classes by bit-sliced comparison.

Fingerprints that differ in at most `radius` of 64 bits agree on at least one of radius + 1 blocks of bits. Distinct
fingerprints meet in the groups of each block's values. In a group the fingerprints are stored as bit planes, 64 to a
machine word; distances to 64 of them at once are counted by carry-save counters over the planes, and words all of whose
lanes have exceeded the radius are given up on the way. Groups above `limit` are cut finer by a block of the bits left
(again radius + 1 of them, so again no pair is lost); what is still above it is dealt out as pairs of parts. A task emits
a star for each class it sees, not all pairs; classes are then joined by connected components.

Defined results: null texts and texts without words have fingerprint zero, linked like any other; texts of fewer words
than a shingle are one shingle; equal texts have equal fingerprints and one class; a class's id is its smallest doc_id
that is not null, and null where all are; repeated rows give a row each; empty tables give no rows; columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grove.llm import jaccard
from grove.llm.common import first_of_each, give_back, small_batches
from grove.llm.components import components
from grove.storage import cut

WIDTH, SEED, RADIUS = 4, 42, 4
#: Bits of the fingerprints of shingle sets, and how many may differ in similar sets. A bit differs with a chance of 0.15 at
#: similarity 0.8 (0.19 in the smallest sets), so more than LONG_RADIUS do once in a million pairs, in most cases far more rarely.
LONG_BITS, LONG_RADIUS = 128, 48
#: Fingerprints that are compared in one group at most.
LIMIT = 8192
#: Pairs of a fingerprint and a word of 64 lanes that are under comparison at once.
PAIRS = 1 << 17
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str, width: int = WIDTH) -> int:
    return _majority(jaccard.hashed_shingles(text, width))


def _majority(hashes: Iterable[np.ndarray]) -> int:
    """Each bit is 1 if set in over half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        for i in range(0, len(h), 1 << 16):
            part = np.ascontiguousarray(h[i : i + (1 << 16)], dtype="<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp})

    return small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(rows, "doc_id bigint, fp bigint")


def blocks(low: int, high: int, n: int) -> list[tuple[int, int]]:
    """n runs of bits, nearly even, as (first bit, bits) from low to high."""
    cuts = [low + (high - low) * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _value(fp: Column, start: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << bits) - 1))


def _keys(fp: Column, runs: list[tuple[int, int]]) -> Column:
    """For each run of bits a key: the run's number above the value that fp has there."""
    return F.array(*[F.lit(i << 32).cast("long").bitwiseOR(_value(fp, s, b)) for i, (s, b) in enumerate(runs)])


def dealt(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """prints (fp, distinct) -> (g1, g2, i, j, part, fp): groups (g1, g2, i, j) in which part i is compared with part j."""
    first = blocks(0, 64, radius + 1)
    rows = prints.select("fp", F.explode(_keys(F.col("fp"), first)).alias("g1"))
    # at most (radius + 1) * 2 ** 13 values: small enough to broadcast whatever the input
    large = rows.groupBy("g1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("g1", F.lit(1).alias("__large"))
    rows = rows.join(F.broadcast(large), "g1", "left")
    zero = F.lit(0)
    light = rows.where("__large IS NULL").select("g1", F.lit(-1).cast("long").alias("g2"), zero.alias("i"), zero.alias("j"), zero.alias("part"), "fp")
    # the bits outside the block, turned so that they stand together, in radius + 1 blocks again
    fp = F.col("fp")
    finer = None
    for b, (start, bits) in enumerate(first):
        rest = F.shiftrightunsigned(fp, start + bits).bitwiseOR(F.shiftleft(fp, 64 - start - bits)) if 0 < start + bits < 64 else fp
        branch = _keys(rest, blocks(0, 64 - bits, radius + 1))
        finer = F.when(F.shiftright("g1", 32) == b, branch) if finer is None else finer.when(F.shiftright("g1", 32) == b, branch)
    heavy = rows.where("__large = 1").select("g1", F.explode(finer).alias("g2"), "fp")
    sizes = heavy.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    heavy = heavy.join(sizes, ["g1", "g2"], "left").withColumn("k", F.coalesce(F.ceil(F.col("n") / limit), F.lit(1)).cast("int"))
    heavy = heavy.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    heavy = heavy.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    heavy = heavy.select("g1", "g2", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "fp")
    return light.unionByName(heavy)


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[k] and b[k] in label, in which each row points at a smaller row of its class or itself."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def close_pairs(fp: np.ndarray, planes: np.ndarray, valid: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of a fingerprint fp[query] (a row of machine words) and a word: those with a lane within the radius, and the lanes as bits."""
    q = fp[query]
    # digits of the distances to all lanes, the lowest first, enough for radius + 1; over: lanes whose distances need more
    digits = [np.zeros(len(q), np.uint64) for _ in range(max(2, int(radius).bit_length()))]
    over = ~valid[word]
    one = np.uint64(1)

    def beyond() -> np.ndarray:
        greater, equal = over.copy(), ~over
        for k in range(len(digits) - 1, -1, -1):
            if radius >> k & 1:
                equal &= digits[k]
            else:
                greater |= equal & digits[k]
                equal &= ~digits[k]
        return greater

    for plane in range(0, len(planes), 4):
        mine = q[:, plane // 64]
        x = [planes[plane + k][word] ^ (np.uint64(0) - ((mine >> np.uint64((plane + k) % 64)) & one)) for k in range(4)]
        u = digits[0] ^ x[0]
        c1 = (digits[0] & x[0]) | (u & x[1])
        digits[0] = u ^ x[1]
        u = digits[0] ^ x[2]
        c2 = (digits[0] & x[2]) | (u & x[3])
        digits[0] = u ^ x[3]
        u = digits[1] ^ c1
        carry = (digits[1] & c1) | (u & c2)
        digits[1] = u ^ c2
        for k in range(2, len(digits)):
            digits[k], carry = digits[k] ^ carry, digits[k] & carry
        over |= carry
        if plane % 8 == 4:
            alive = beyond() != ALL
            if 2 * np.count_nonzero(alive) < len(alive):
                query, word, q, over = (v[alive] for v in (query, word, q, over))
                digits = [v[alive] for v in digits]
    near = ~beyond()
    hit = near != 0
    return query[hit], word[hit], near[hit]


def linked(fp: np.ndarray, group: np.ndarray, part: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by group (a number) and part: the index of each row's class within its group.

    fp: signed longs, one a row or several (longer fingerprints). Rows whose whole group is one class by then ask no more.
    """
    n = len(fp)
    label = np.arange(n)
    if not n:
        return label
    fp = np.ascontiguousarray(fp).view(np.uint64).reshape(n, -1)
    new_side = np.concatenate(([True], (group[1:] != group[:-1]) | (part[1:] != part[:-1])))
    start = np.flatnonzero(new_side)
    side = np.cumsum(new_side) - 1
    at = np.arange(n) - start[side]
    size = np.diff(np.concatenate((start, [n])))
    words = -(-size // 64)
    first_word = np.concatenate(([0], np.cumsum(words)))
    word_of, lane = first_word[side] + at // 64, (at % 64).astype(np.uint64)
    begins = np.flatnonzero(np.concatenate(([True], word_of[1:] != word_of[:-1])))
    planes = np.empty((64 * fp.shape[1], first_word[-1]), np.uint64)
    for b in range(len(planes)):
        planes[b] = np.bitwise_or.reduceat(((fp[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)) << lane, begins)
    valid = np.bitwise_or.reduceat(np.uint64(1) << lane, begins)
    # against which words a row is compared: a lone side against itself, else the first side against the second
    mate = np.arange(len(start))
    lone = i[start] == j[start]
    follows = np.concatenate((group[start[1:]] == group[start[:-1]], [False])) & ~lone
    mate[follows] = np.flatnonzero(follows) + 1
    asks = lone | follows
    rows = np.flatnonzero(asks[side])
    per = words[mate[side[rows]]]
    whole = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    group_of = np.cumsum(np.concatenate(([True], group[1:] != group[:-1]))) - 1
    done = 0
    ends = np.cumsum(per)
    while done < len(rows):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        mine, count = rows[done:upto], per[done:upto]
        if done:
            least, most = np.minimum.reduceat(label, whole), np.maximum.reduceat(label, whole)
            open_ = (least != most)[group_of[mine]]
            mine, count = mine[open_], count[open_]
        query = np.repeat(mine, count)
        word = np.repeat(first_word[mate[side[mine]]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        query, word, near = close_pairs(fp, planes, valid, query, word, radius)
        bits = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, lanes = np.nonzero(bits)
        _roots(label, query[which], begins[word[which]] + lanes)
        done = upto
    return label


def compared(grouped: DataFrame, groups: list[str], prints: list[str], name: str, radius: int, rows_at_once: int = 1 << 18) -> DataFrame:
    """Edges (a, b) between rows' names that span the classes of each group; groups: its columns, i and j (parts) the last two."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(frame: pd.DataFrame) -> pd.DataFrame:
            head = frame[groups].to_numpy()
            group = np.concatenate(([0], np.cumsum((head[1:] != head[:-1]).any(axis=1)))) if len(frame) else np.zeros(0, int)
            label = linked(frame[prints].to_numpy(), group, frame["part"].to_numpy(), frame["i"].to_numpy(), frame["j"].to_numpy(), radius)
            mine, names = np.flatnonzero(label != np.arange(len(label))), frame[name].to_numpy()
            return pd.DataFrame({"a": names[mine], "b": names[label[mine]]})

        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= rows_at_once:
                frame = pd.concat(held, ignore_index=True)
                head = frame[groups].to_numpy()
                cut_at = np.flatnonzero((head[1:] != head[:-1]).any(axis=1))
                if len(cut_at):
                    yield solved(frame.iloc[: cut_at[-1] + 1])
                    held = [frame.iloc[cut_at[-1] + 1 :]]
                else:
                    held = [frame]
        if held:
            yield solved(pd.concat(held, ignore_index=True))

    sorted_ = grouped.repartition(*groups).sortWithinPartitions(*groups, "part")
    return sorted_.mapInPandas(rows, "a bigint, b bigint")


def links(prints: DataFrame, radius: int = RADIUS, limit: int = LIMIT, rows_at_once: int = 1 << 18) -> DataFrame:
    """prints (fp, distinct) -> edges (a, b) that span each class of fingerprints within the radius of one another."""
    return compared(dealt(prints, radius, limit), ["g1", "g2", "i", "j"], ["fp"], "fp", radius, rows_at_once)


def classes(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint and component_id of each document."""
    own = cut(fingerprints(docs, width), "fingerprints")
    prints = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    found = components(links(prints.select("fp"), radius, limit))
    rooted = cut(prints.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    # written, so that the join below is one whose large partitions Spark can split
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "components")
    named = rooted.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def long_print(hashes: np.ndarray) -> list[int]:
    """The LONG_BITS fingerprint of a set of hashes, as signed longs: each bit is 1 if set in over half of the hashes."""
    out = []
    for k in range(LONG_BITS // 64):
        h = hashes if k == 0 else (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
        out.append(_majority([h ^ (h >> np.uint64(32))]))
    return np.array(out, np.uint64).view(np.int64).tolist()


def _long_prints(docs: DataFrame) -> DataFrame:
    """doc_id, th, sid, bands and f0, f1, ... of each document: hashes of its text and of its shingle set, keys, fingerprint."""
    names = [f"f{k}" for k in range(LONG_BITS // 64)]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [jaccard.shingles(t) for t in batch["text"]]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
            frame = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "th": batch["th"], "sid": sid, "bands": [jaccard.bands(s) for s in found]})
            yield frame.assign(**dict(zip(names, np.array([long_print(s) for s in found], np.int64).T)))
            del found, frame
            give_back()

    text = F.coalesce("text", F.lit(""))
    schema = "doc_id bigint, th bigint, sid bigint, bands array<bigint>, " + ", ".join(f"{n} bigint" for n in names)
    return small_batches(docs).select("doc_id", F.xxhash64(text).alias("th"), text.alias("text")).mapInPandas(rows, schema)


def candidates(own: DataFrame, limit: int = LIMIT) -> DataFrame:
    """own (sid, bands, f0, f1, ...) -> edges between sets that share a band and whose fingerprints are within LONG_RADIUS.

    A group of more than `limit` sets is dealt out as pairs of parts, as in dealt().
    """
    names = [c for c in own.columns if c[0] == "f"]
    sets = own.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("bands", *names)])  # equal in all rows of a set
    met = sets.select("sid", F.explode("bands").alias("g"))
    sizes = met.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g", F.ceil(F.col("n") / limit).cast("int").alias("k"))
    # fingerprints join what has met others, not all bands of all sets
    rows = met.join(sizes, "g").withColumn("part", F.pmod(F.xxhash64("sid"), F.col("k")).cast("int")).join(sets.select("sid", *names), "sid")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    grouped = rows.select("g", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sid", *names)
    return compared(grouped, ["g", "i", "j"], names, "sid", LONG_RADIUS)


def similar_roots(docs: DataFrame, limit: int = LIMIT, part: int = jaccard.PART, part_bytes: int = jaccard.PART_BYTES) -> DataFrame:
    """doc_id, th and root of each document with an id: root names its class of similar texts, th is the hash of its text.

    Texts are similar whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and classes are transitive.
    At that similarity fingerprints of 64 bits differ in about ten, more than blocks of bits can find, so sets meet by MinHash
    bands instead of blocks; the groups are compared as those of fingerprints are, by bit-sliced distances, here of LONG_BITS
    bits; and what is within LONG_RADIUS is compared exactly by jaccard before it counts.
    """
    docs = docs.where("doc_id IS NOT NULL")
    own = cut(_long_prints(docs), "shingle-sets")
    met = cut(components(candidates(own, limit)), "clusters").withColumnRenamed("node", "sid")
    # a document whose text stands for its set; not joined by th alone, as many rows may have one text
    one = own.groupBy("sid").agg(F.min(F.struct("doc_id", "th")).alias("one")).join(met, "sid").select("root", "sid", "one.doc_id", "one.th")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text")).join(cut(one, "candidates"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    texts = cut(texts.select("root", "sid", "text"), "candidate-texts")
    found = components(jaccard.links(texts, part, part_bytes)).withColumnRenamed("node", "sid")
    return own.join(found, "sid", "left").select("doc_id", "th", F.coalesce("root", "sid").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class of similar texts, that with the smallest doc_id, then text hash, with all its columns.

    Rows without an id all stay; of rows with one id and one text one stays.
    """
    return first_of_each(docs, similar_roots(docs))

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from grove.llm import jaccard, simhash
from tests.conftest import SF
from tests.llm.test_simhash import roots


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_kept(rows):
    """Smallest ids of the classes, by comparing all sets with one another."""
    least = {}
    for i, t in rows:
        s = brute_set(t)
        least[s] = min(least.get(s, i), i)
    sets = {i: s for s, i in least.items()}
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    return sorted(set(roots(sets, near).values()))


def edited_rows():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    common = [word() for _ in range(60)]
    texts = ["", None, " \n", "one two", "One  two", "one two three"]
    for base in range(25):
        w = [word() for _ in range(rng.choice([12, 40, 150, 400]))] + common * (base % 3 == 0)
        texts.append(" ".join(w))
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randrange(1, 2 + len(w) // 30)):
                x[rng.randrange(len(x))] = word()
            texts.append(" ".join(x).upper())
    hub = [word() for _ in range(200)]
    for _ in range(60):
        x = list(hub)
        for _ in range(rng.randrange(1, 7)):
            x[rng.randrange(200)] = word()
        texts.append(" ".join(x))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("limit,part", [(8192, 2048), (5, 7)])
def test_classes_are_those_of_exact_similarity(spark, limit, part):
    rows = edited_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    least = {}
    for r in simhash.similar_roots(docs, limit, part).collect():
        least[r["root"]] = min(least.get(r["root"], r["doc_id"]), r["doc_id"])
    assert sorted(least.values()) == brute_kept(rows)
    assert simhash.similar_roots(docs.limit(0), limit, part).count() == 0


def test_near_dedup_stage_drops_copies_beyond_four_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    # 177 is at 0.83 to 1, and nine bits from it
    assert kept == brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()]) and 1 in kept and 177 not in kept


def test_similar_sets_are_within_the_radius():
    """Real and small sets: no pair of similarity 0.8 or more differs in more bits than the stage looks for."""
    texts = [t for _, t in edited_rows()] + [" ".join(f"w{k}" for k in range(n)) for n in range(1, 60)]
    texts += [t for t in pq.read_table(f"{SF.replace('0.001', '0.01')}/documents.parquet", columns=["text"])["text"].to_pylist()]
    sets = {tuple(s.tolist()): s for s in map(jaccard.shingles, filter(None, texts))}
    sets = sorted(sets.values(), key=len)
    prints = np.array([simhash.long_print(s) for s in sets]).view(np.uint64)
    seen = 0
    for i, s in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if 4 * len(sets[j]) > 5 * len(s):
                break
            shared = len(np.intersect1d(s, sets[j], assume_unique=True))
            if 5 * shared >= 4 * (len(s) + len(sets[j]) - shared):
                seen += 1
                assert int(np.bitwise_count(prints[i] ^ prints[j]).sum()) <= simhash.LONG_RADIUS
    assert seen > 200


@pytest.mark.parametrize("words,radius", [(1, 0), (1, 4), (1, 9), (2, 48), (3, 63), (3, 64)])
def test_bit_sliced_distances(words, radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 1 << 64, (150, words), np.uint64)
    for i in range(75):  # near ones, around the radius
        x = fp[i].copy()
        for b in rng.choice(64 * words, max(0, radius + int(rng.integers(-2, 3))), replace=False):
            x[b // 64] ^= np.uint64(1 << int(b % 64))
        fp[75 + i] = x
    group = np.repeat([0, 1, 2], 50)
    label = simhash.linked(fp.view(np.int64), group, np.zeros(150, int), np.zeros(150, int), np.zeros(150, int), radius)
    want = roots(range(150), lambda a, b: group[a] == group[b] and int(np.bitwise_count(fp[a] ^ fp[b]).sum()) <= radius)
    classes = lambda of: sorted(sorted(k for k in range(150) if of(k) == r) for r in {of(k) for k in range(150)})
    assert classes(lambda k: int(label[k])) == classes(want.get)


def test_each_class_keeps_one_row_though_ids_repeat(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "cd")
    # a and b have only id 1; the class of c has a smaller id than 5, which d has as its smallest
    rows = [(1, a), (1, b), (1, a), (2, a), (3, c), (5, c), (5, d), (6, d), (None, a)]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted([(1, a), (1, b), (3, c), (5, d), (None, a)], key=repr)

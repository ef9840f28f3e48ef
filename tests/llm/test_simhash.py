import numpy as np
import pytest
import xxhash

from grove.llm import simhash
from grove.llm.components import components
from tests.conftest import SF


def brute_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(keys, near):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keys = sorted(keys)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {k: find(k) for k in keys}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_classes(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    root = roots({p for _, p in prints}, lambda a, b: bin(a ^ b).count("1") <= 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    return sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=repr)


def test_components(spark):
    e = [(1, 2), (2, 3), (5, 4), (7, 8), (8, 9), (9, 10), (10, 11), (3, 3), (20, 21), (21, 20), (20, 21)] + [(100, 100 + i) for i in range(1, 60)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, **{k: 7 for k in range(7, 12)}, 20: 20, 21: 20, **{k: 100 for k in range(100, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [8192, 40])
def test_links_lose_nothing(spark, limit):
    rng = np.random.default_rng(1)
    prints = set(rng.integers(0, 1 << 63, 120).tolist())
    for b in list(prints)[:60]:
        for _ in range(8):
            for k in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                b ^= 1 << k
            prints.add(b)
    hot = list(prints)[0]
    for _ in range(300):
        x = hot
        for k in rng.choice(40, 3, replace=False).tolist():
            x ^= 1 << k
        prints.add(x)
    want = roots(prints, lambda a, b: bin(a ^ b).count("1") <= 4)
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(df, limit=limit)).collect()}
    classes = lambda of: sorted(sorted(p for p in prints if of(p) == r) for r in {of(p) for p in prints})
    assert classes(lambda p: found.get(signed(p), signed(p))) == classes(want.get)


def test_classes(spark):
    long = " ".join(f"w{i % 97} v{i}" for i in range(400))
    rows = [(5, long), (3, long.upper()), (9, long + " tail"), (1, "other words here today"), (2, None), (7, ""), (8, " \n"), (4, "one two"), (4, "one two"), (None, "one two"), (None, "lonely text of nobody at all")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    assert sorted((tuple(r) for r in simhash.classes(docs).collect()), key=repr) == brute_classes(rows)
    assert simhash.classes(docs.limit(0)).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([3, 1, 2, 4, None, None], key=repr)


def test_op7_query(spark):
    from grove.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op7_simhash_bit_sliced"](spark, SF).collect()), key=repr) == brute_classes(rows)

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from grove.llm import induced, suffix_dedup, superkmers
from tests.conftest import SF

sha = lambda b: hashlib.sha256(b).hexdigest()
LOW = -(1 << 63)


def brute_words(rows, width):
    rows = [(LOW if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in rows:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i, k):
                gone.update(range(k, k + width))
        out.append((None if i == LOW else i, len(w), len(gone), sha(b" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=repr)


def brute_bytes(rows, width):
    rows = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(b[k : k + width] for _, b in rows for k in range(len(b) - width + 1))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if n[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(100, "ab" * 3000), (101, "a" * 5000), (102, None), (None, "xyz" * 50), (103, "é" * 200 + "\0" * 30), (104, "\0" * 40), (3, rows[3][1]), (3, rows[3][1])]
    return rows + [(200 + i, rows[7][1] + "q" * i) for i in range(30)] + [(300, "x " * 400), (301, "x y " * 200), (302, " ".join(rng.choice("pqr") for _ in range(300)))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, th int, s string")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_induced_sorting(monkeypatch):
    rng = random.Random(3)
    for queues, bucket, memory, block, ahead in ((512, 1 << 14, 1 << 28, 1 << 16, 1 << 13), (2, 9, 0, 3, 4), (1, 9, 1 << 28, 3, 1), (512, 9, 0, 1 << 16, 5), (5, 4, 400, 7, 2), (3, 1 << 14, 40, 1, 1 << 13)):
        for name, value in (("QUEUES", queues), ("BUCKET", bucket), ("BLOCK", block), ("AHEAD", ahead)):
            monkeypatch.setattr(induced, name, value)
        for _ in range(150):
            text = [rng.randrange(rng.choice([1, 2, 3, 5, 20])) for _ in range(rng.randint(1, 60))]
            if rng.random() < 0.4:
                text = (text[: rng.randint(1, 5)] * 40)[: len(text)]
            order, prefix = induced.suffixes(np.array(text), 1000, memory)
            want = sorted(range(len(text)), key=lambda i: text[i:])
            assert order.tolist() == want
            for k in range(1, len(want)):
                a, b = text[want[k - 1] :], text[want[k] :]
                assert prefix[k] == next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_minimisers_are_found_block_by_block(monkeypatch):
    """Runs of windows with one minimiser, and where these stand, whatever the block; no pass is over a whole chunk's hashes."""
    rng = random.Random(8)
    for _ in range(400):
        monkeypatch.setattr(suffix_dedup, "BLOCK", rng.choice([1, 2, 7, 50, 1 << 15]))
        width = rng.randint(1, 20)
        mer = rng.randint(1, width)
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(width, rng.choice([width, 90])))) for _ in range(rng.randint(1, 5))]
        runs, stands, offset = [], {}, 0
        for t in texts:
            h = [int(suffix_dedup._hashed(np.frombuffer(t[k : k + mer], np.uint8), mer, mer)[0]) for k in range(len(t) - mer + 1)]
            for k in range(len(t) - width + 1):
                around = range(k, k + width - mer + 1)
                least = min(h[j] for j in around)
                stands |= {offset + j: least for j in around if h[j] == least}
                if k and runs[-1][2] == least:
                    runs[-1][1] += 1
                else:
                    runs.append([offset + k, 1, least])
            offset += len(t)
        first, windows, minimiser, place, hashes = suffix_dedup._minimised(texts, width, mer)
        assert [list(r) for r in zip(first.tolist(), windows.tolist(), minimiser.tolist())] == runs
        assert dict(zip(place.tolist(), hashes.tolist())) == stands and place.tolist() == sorted(stands)
    monkeypatch.undo()
    text = rng.randbytes(1 << 20)
    tracemalloc.start()
    found = suffix_dedup._selected([text], 200, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > len(text) / 100 and peak < 8 * len(text)


def test_sort_looks_at_each_suffix_once_a_scan(monkeypatch):
    """Suffixes of a bucket of many symbols that wait for the scan are not looked at again in each of its steps."""
    looks, most, begin = [], [], induced._Scan.__init__

    class Counted:
        def __init__(self, wanted):
            self.wanted = wanted

        def __getitem__(self, at):
            looks.append(len(at))
            return self.wanted[at]

    def counting(scan, text, wanted, *more):
        most.append(text.n)
        begin(scan, text, Counted(wanted), *more)

    monkeypatch.setattr(induced._Scan, "__init__", counting)
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(60_000))
    order, _ = induced.suffixes(np.frombuffer(text, np.uint8), 1000)
    assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k : k + 200])
    assert len(most) >= 4 and sum(looks) <= sum(most)


@pytest.mark.parametrize("sizes", [{}, {"mer": 5, "chunk": 300, "shard": 400, "together": 100, "memory": 0}])
def test_suffix_dedup(spark, sizes):
    rows = odd_rows()
    assert got(suffix_dedup.digests(frame(spark, rows), 20, **({"mer": 8} | sizes))) == brute_bytes(rows, 20)


def test_long_texts_are_cut():
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("ab  \n") for _ in range(rng.randint(0, 200))).encode()
        size, width = rng.randint(1, 40), rng.randint(1, 6)
        got = [(at + k, p[k : k + width]) for at, p in suffix_dedup.sp.byte_pieces(width)(text, size) for k in range(len(p) - width + 1)]
        assert got == [(k, text[k : k + width]) for k in range(len(text) - width + 1)]
        words = text.split()
        got = [(at + k, p.split()[k : k + width]) for at, p in suffix_dedup.sp.word_pieces(width)(text, size) for k in range(len(p.split()) - width + 1)]
        assert got == [(k, words[k : k + width]) for k in range(len(words) - width + 1)]


def test_words_that_stay_in_a_long_text(monkeypatch):
    monkeypatch.setattr(superkmers, "CHUNK", 20)
    rng = random.Random(2)
    for _ in range(200):
        text = " \n".join("w" * rng.randint(1, 9) + str(k) for k in range(rng.randint(0, 60)))
        n = len(text.split())
        s = np.array([rng.randrange(max(n, 1)) for _ in range(rng.randint(0, 4))] if n else [], np.int64)
        e = np.minimum(s + np.array([rng.randint(1, 20) for _ in s], np.int64), n)
        gone = {k for a, b in zip(s.tolist(), e.tolist()) for k in range(a, b)}
        assert superkmers._kept(text, s, e) == (n, len(gone), " ".join(w for k, w in enumerate(text.split()) if k not in gone).encode())


def test_real_texts_recurse_and_spill():
    """At default sizes names are sorted by recursion, and the queues of a sort go to disk."""
    texts = [t for t in pq.read_table(f"{SF.replace('0.001', '0.01')}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    texts = list(dict.fromkeys(t.encode() for t in texts if len(t) >= 200))[:250]
    store = induced.Store()
    found = suffix_dedup.repeats(texts, 200, store)
    n = Counter(b[k : k + 200] for b in texts for k in range(len(b) - 199))
    assert all(twice.tolist() == [n[b[k : k + 200]] > 1 for k in range(len(b) - 199)] for b, twice in zip(texts, found))
    assert any(twice.any() for twice in found) and store.recursions > 1 and store.on_disk > 10 and store.bytes_on_disk > 1 << 20
    store.close()


def test_suffix_dedup_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "abc" * 30, "x", 90), (2, "abc" * 30, "y", 90), (3, "zz", "z", 2)], "doc_id long, text string, source string, n_chars long")
    out = suffix_dedup.dedup(docs, 20, mer=8)
    assert out.schema == docs.schema
    assert sorted(map(tuple, out.collect())) == [(1, "", "x", 0), (2, "", "y", 0), (3, "zz", "z", 2)]
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0 == suffix_dedup.digests(docs.limit(0)).count()


def test_op4_query(spark):
    from grove.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op4_suffix_array_dedup"](spark, SF)) == brute_bytes(rows, 200)


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 20), (300, 400)])
def test_super_kmers(spark, sizes):
    rows = odd_rows()
    docs = frame(spark, rows)
    spans = superkmers.repeated_spans(docs, 6, 2, *sizes)
    out = superkmers.sp.applied(docs, spans, superkmers._without, ["n_words", "n_removed", "kept_sha256"], "n_words bigint, n_removed bigint, kept_sha256 string")
    assert got(out) == brute_words(rows, 6)
    assert superkmers.digests(docs.limit(0)).count() == 0 == superkmers.dedup(docs.limit(0)).count()


def test_super_kmers_where_hashes_collide(spark, monkeypatch):
    rows = odd_rows()[:40]
    split = [(i, t.encode().split()) for i, t in rows]
    text = b" ".join(w for _, s in split for w in s) + b" "
    begins, ends = superkmers.places(text)
    at, owner, start = superkmers._windows(np.array([len(s) for _, s in split]), 4)
    ids = np.array([i for i, _ in rows])[owner]
    same = np.zeros(len(at), np.uint64)
    late, head = superkmers.later(same, ids, start)
    late = superkmers.exactly(text, at, begins[at], ends[at + 3], ids, start, late, head)
    first = {}
    for i, s in split:
        for k in range(len(s) - 3):
            first.setdefault(tuple(s[k : k + 4]), (i, k))
    want = [first[tuple(text.split()[a : a + 4])] != p for a, p in zip(at.tolist(), zip(ids.tolist(), start.tolist()))]
    assert sorted(late.tolist()) == np.flatnonzero(want).tolist()


def test_op8_query(spark):
    from grove.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(QUERIES["op8_super_kmers"](spark, SF)) == brute_words(rows, 20)

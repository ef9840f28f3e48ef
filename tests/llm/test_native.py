import hashlib
import random
import struct

import pytest
import xxhash

from grove.llm import omh, quality, warc
from grove.llm.oracle import ORACLE_SQL
from grove.llm.queries import QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(same_rows, name):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def brute_quality(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality_measures(spark):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a\x0bb\x0cc\rd", "é ñ # | <b>", "a b c d e f g h " * 3, "x " * 40] + [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) + "\n" * (i % 3) for i in range(40)]
    texts += ["same line\nsame line\n \n \nother", "w " * 7, "w " * 8, "w " * 9]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)] + [(None, "x y", 1, "z")], "doc_id long, text string, n_words int, fail_bits string")
    got = {r["doc_id"]: r for r in quality.ledger(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_quality(t), t
    assert quality.ledger(docs.limit(0)).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns


def test_policies_and_ablations(spark):
    rated = spark.createDataFrame([(0,), (0,), (1,), (2,), (3,), (64,), (66,)], "fail_bits long")
    base = {r["rule"]: tuple(r)[1:] for r in quality.ablations(rated, "base-1").collect()}
    assert base == {"few_words": (2, 1, 4, 3), "repeated_windows": (3, 2, 5, 3)}
    assert rated.where(quality.verdict("full-1")).count() == 2 and rated.where(quality.verdict("base-1")).count() == 3


def _x(data, seed=42):
    h = xxhash.xxh64_intdigest(data, seed)
    return h


def _chain(parts, seed=42):
    h = seed
    for p in parts:
        h = xxhash.xxh64_intdigest(p if isinstance(p, bytes) else struct.pack("<q", p), h)
    return h


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute_signature(text, slots=omh.SLOTS, depth=omh.DEPTH, k=omh.K):
    w = [x.encode() for x in words(text)]
    grams = [w[i : i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [w] * bool(w)
    if not grams:
        return [0] * slots
    seen, items = {}, []
    for i, g in enumerate(grams):
        h = _signed(_chain(g)) >> 23
        n = seen[h] = seen.get(h, -1) + 1
        if n:
            h = _signed(_chain_typed(h, n)) >> 23
        items.append((h << 23) | (i & ((1 << 23) - 1)))
    items.sort()
    out = []
    for b in range(slots):
        mark = -(1 << 63) + b * ((1 << 64) // slots)
        at = sum(x < mark for x in items)
        chosen = sorted((items[(at + j) % len(items)] for j in range(depth)), key=lambda x: (x & ((1 << 23) - 1), (x & ((1 << 64) - 1)) >> 24))
        parts = [((x & ((1 << 64) - 1)) >> 24) & ((1 << 40) - 1) for x in chosen]
        out.append((_chain(parts) & 0xFFFFFFFF) - (1 << 31))
    return out


def _chain_typed(h, n):
    return xxhash.xxh64_intdigest(struct.pack("<i", n), xxhash.xxh64_intdigest(struct.pack("<q", h), 42))


def test_signature_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["", "one", "a b c d", "a b c d e f", " ".join(f"w{i}" for i in range(300))] + [" ".join(rng.choice("ab") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["sig"] for r in omh.signature(df, "text", "sig").collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_signature(t), t


def test_signature_feels_order(spark):
    a = [f"w{i}" for i in range(120)]
    moved, changed = a[60:] + a[:60], a[:90] + [f"v{i}" for i in range(30)]
    df = omh.signature(spark.createDataFrame([(0, " ".join(a)), (1, " ".join(moved)), (2, " ".join(changed)), (3, " ".join(a))], "i int, text string"), "text", "s")
    s = {r["i"]: r["s"] for r in df.collect()}
    like = lambda x, y: sum(p == q for p, q in zip(s[x], s[y])) / 64
    assert like(0, 3) == 1 and 0.2 < like(0, 1) < 0.9 and 0.2 < like(0, 2) < 0.8


@pytest.mark.parametrize("rows_each", [500, 3])
def test_next_document_and_edited_text(spark, monkeypatch, rows_each):
    monkeypatch.setattr(omh.with_next, "__defaults__", (rows_each, None))
    docs = [(i * 3 % 40, f"text é {i} " * (i % 4)) for i in range(40)] + [(60, None), (None, "no id here"), (5, "tie b"), (5, "tie a"), (90, "x" * 301)]
    df = spark.createDataFrame([(*d, "n", 3) for d in docs], "doc_id long, text string, sig string, n_chars int")
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        h = len(text) // 2
        want.append((doc_id, len(text), hashlib.sha256((text[: len(text) - h] + after[:h]).encode()).hexdigest()))
    got = omh.edited(df).collect()
    assert sorted((tuple(r)[:3] for r in got), key=repr) == sorted(want, key=repr)
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 512
    assert omh.edited(df.limit(0)).count() == 0
    one = omh.edited(df.where("doc_id = 90")).first()
    assert one["near_next"] == 1.0


def test_op2_query(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in QUERIES["op2_order_minhash"](spark, SF).collect()}
    as_text = lambda s: "".join(f"{x & 0xFFFFFFFF:08x}" for x in s)
    for i, (doc_id, text) in enumerate(docs[:60]):
        after, h = docs[(i + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - h] + after[:h]
        r, own, new = got[doc_id], brute_signature(text), brute_signature(edited)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (as_text(own), as_text(new))
        assert r["near_edited"] == sum(a == b for a, b in zip(own, new)) / 64
    assert len(got) == len(docs)


def test_warc_round_trip(spark):
    pages = [(1, "u", "abc\r\n\r\nWARC/1.1\r\n"), (2, None, None), (3, "x\ny", "abc\r\n\r\nWARC/1.1\r\n"), (None, "n", "abc\r\n\r\nWARC/1.1\r\n"), (4, "", "é"), (4, "", "z"), (5, "", "z"), (5, "", "é"), (2, "", ""), (7, "", "")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, refers_to int")
    path = warc.write(df)
    back = warc.read(spark, path, payloads=True).collect()
    assert all(r["digest_holds"] for r in back) and len(back) == len(pages)
    assert sorted(r["html"] for r in back if r["record_type"] == "response") == sorted(["abc\r\n\r\nWARC/1.1\r\n"] * 2 + ["", ""] + ["é", "z"])
    got = sorted((tuple(r)[:2] + tuple(r)[3:5] for r in warc.round_trip(df).collect()), key=repr)
    want = [(1, 17, "response", None), (2, 0, "response", None), (2, 0, "response", None), (3, 17, "revisit", 1), (None, 17, "response", None), (4, 2, "response", None), (4, 1, "response", None), (5, 1, "revisit", 4), (5, 2, "revisit", 4), (7, 0, "revisit", 2)]
    assert got == sorted(want, key=repr)
    assert warc.round_trip(df, least=2).where("record_type = 'revisit'").count() == 2
    assert warc.round_trip(df.limit(0)).count() == 0

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from grove.llm import bpe, packing
from tests.conftest import SF

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n a\t b ", "<|endoftext|>x<|endoftext|>", "É. é, ΑΣ. Σας İx İ. ª. ﬁ. 5., 五, x'll it's", "a" * 3000, "…–—", "\x00\x1f ﷽", "漢字 かな 한글", "Hello, WORLD... 12,345!"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(WORD)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_bpe_is_the_library(tokenizer, text):
    v = bpe.vocabulary(BYTE)
    ids = np.frombuffer(v.encode(text), "<u4").tolist()
    assert ids == tokenizer.encode(text, add_special_tokens=False).ids
    assert v.decode(v.encode(text)) == tokenizer.decode(ids, skip_special_tokens=False) == text


@given(st.text(alphabet=" aAbéÉİσΣ.,'s5\ń-", max_size=40))
@settings(max_examples=300, deadline=None)
def test_word_ids_are_the_librarys(words, text):
    assert np.frombuffer(next(packing._encoded(WORD, [text])), "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def test_every_character_before_a_stop(words):
    """Also those that composition takes apart: a mark that it leaves at the end is no letter any more."""
    known = packing.Words(WORD)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c) not in " \n"]
    for form in ("{}.", "a{}.,"):
        for i in range(0, len(chars), 20_000):
            texts = [form.format(c) for c in chars[i : i + 20_000]]
            bad = [t for t, e in zip(texts, words.encode_batch(texts, add_special_tokens=False)) if known[t] != np.array(e.ids, "<u4").tobytes()]
            assert not bad


def test_odd_texts(tokenizer, words):
    v = bpe.vocabulary(BYTE)
    for text in ODD:
        assert np.frombuffer(v.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(next(packing._encoded(WORD, [text])), "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def naive(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in range(len(bins)) if bins[b] >= length]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= length
            else:
                bins.append(capacity - length)
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(150):
        capacity = rng.choice([10, 37, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 20) for _ in range(rng.randint(1, 10))}
        places, cover = defaultdict(list), Counter()
        for f in packing.plan(counts, capacity):
            cover[f.length] += f.items
            for j in range(f.items):
                places[f.sequence + j // f.each].append((f.offset + j % f.each * f.length, f.length))
        left = []
        for items in places.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            left.append(capacity - at)
        assert cover == Counter(counts) and sorted(left) == naive(counts, capacity)


def check_packing(rows, texts, tokenizer, capacity):
    """rows of op1 against the library: pieces, digests, and gapless sequences."""
    want = []
    for doc_id, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            want.append((doc_id, start // capacity, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: (r[0] is None, *map(lambda x: x or 0, r))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) == len(naive(Counter(r["length"] for r in rows), capacity))


def test_packing(spark, words):
    texts = [(i, "one two three " * (i % 40)) for i in range(120)] + [(None, "a b"), (3, "one two three " * 3), (3, "one two three " * 3), (500, None), (501, "x " * 5000)]
    docs = spark.createDataFrame([(*t, "z") for t in texts], "doc_id long, text string, length string")
    for capacity in (16, 2048):
        check_packing(packing.pack(docs, WORD, capacity).collect(), texts, words, capacity)
    assert packing.pack(docs.limit(0), WORD).collect() == []


def test_packing_by_small_buckets(spark, words):
    texts = [(i, "ab " * (i % 5)) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    from grove.storage import cut

    check_packing(packing.place(cut(packing.pieces(docs, WORD, 8), "p"), 8, rows_each=10).collect(), texts, words, 8)


def test_op1_query(spark, words):
    from grove.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(QUERIES["op1_best_fit_packing"](spark, SF).collect(), docs, words, 2048)


def test_op9_query(spark, tokenizer):
    import hashlib

    from grove.llm.queries import QUERIES

    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op9_bpe_prefix_dp"](spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_bpe_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (2, "a b", 7), (2, "a b", 7)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode_and_decode(docs, BYTE).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 0), (1, 0), (2, 2), (2, 2)]
    assert bpe.encode_and_decode(docs.limit(0), BYTE).collect() == []

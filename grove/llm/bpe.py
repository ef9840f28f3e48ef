"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece there is one token that its encoding ends with. An automaton over the vocabulary reports all
tokens that end at a position; a candidate is the last token if the merges leave it and the last token of the prefix before
it alone, side by side (a test on two tokens, kept in a table). Back-pointers from the whole piece give the exact ids in
time linear in the matches. Pieces are what the vocabulary's own splitting pattern cuts; each worker keeps a bounded table
of those it has solved. The work is a map over rows: no shuffle, and a lost executor's partitions are simply done again.

Defined results: null text counts as empty and has no tokens; the vocabulary's special tokens are recognised inside texts,
as the library does by default; repeated rows are encoded each for itself; empty tables give no rows; columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grove.llm.common import small_batches

#: The pattern that byte-level pre-tokenizers split by (fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Solved pieces that a worker keeps, and the longest of them in characters.
KEPT, KEPT_CHARS = 600_000, 64
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in vocab.items()}
        self.single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.pattern = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            b = raw(token)
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        top = max(self.bytes_of) + 1
        self.token_bytes = [self.bytes_of.get(i, b"") for i in range(top)]

    def merged(self, data: bytes) -> list[int]:
        """Encoding by the merges themselves; used on two tokens' bytes at most."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            best = min((self.merges.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:])), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merges.get((ids[i], ids[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges leave these two side by side? left -1: right stands alone."""
        known = self.pairs.get((left, right))
        if known is None:
            if left < 0:
                known = self.merged(self.bytes_of[right]) == [right]
            else:
                known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.pairs) >= 2_000_000:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def solve(self, data: bytes) -> list[int]:
        """Ids of one piece: the last token of each prefix, then the way back."""
        last = [-1] * (len(data) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = last[end - size]
                known = pairs.get((before, token))
                if known or known is None and compatible(before, token):
                    last[end] = token
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return ids[::-1]

    def ids_of(self, piece: str) -> bytes:
        ids = np.array(self.solve(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self.pieces) >= KEPT:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials and self.specials.search(text):
            parts = self.specials.split(text)
            return b"".join(np.array([self.special[x]], dtype="<u4").tobytes() if x in self.special else self._plain(x) for x in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        known = self.pieces.get
        return b"".join([known(p) or self.ids_of(p) for p in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text for each document; path: of the vocabulary file."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = v.encode(text)
                out.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(v.decode(ids).encode()).hexdigest()))
            frame = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            yield frame.astype({"doc_id": "Int64"})

    return small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(rows, SCHEMA)

"""Columns encrypted at rest by Spark's own AES functions. Operations work on opened values, inside the expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encrypted(df: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """df with columns as AES-GCM ciphertext of their text, nulls kept; the key has 16, 24 or 32 bytes."""
    return df.withColumns({c: sealed(F.col(c), key) for c in columns})


def sealed(value: Column, key: bytes) -> Column:
    """A value's text as ciphertext; equal values get different ciphertexts."""
    return F.aes_encrypt(value.cast("string").cast("binary"), F.lit(key))


def opened(column: str, kind: str, key: bytes) -> Column:
    """The plain value of a ciphertext column, for use in any expression: comparisons, arithmetic, aggregates."""
    return F.aes_decrypt(F.col(column), F.lit(key)).cast("string").cast(kind)


def decrypted(df: DataFrame, types: dict[str, str], key: bytes) -> DataFrame:
    """df with ciphertext columns as plain ones of the types given."""
    return df.withColumns({c: opened(c, t, key) for c, t in types.items()})

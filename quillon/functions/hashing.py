"""Hash functions as folds over characters, in 64-bit arithmetic that never overflows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def rolling_hash(text: Column) -> Column:
    """The absolute value of the 32-bit hash h * 31 + c."""
    wrapped = F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"),
        lambda h, c: F.pmod(h * 31 + F.ascii(c) + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31),
    )
    return F.abs(wrapped)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's characters."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261),
        lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(1 << 32)),
    )


def base36(number: Column) -> Column:
    return F.lower(F.conv(number.cast("string"), 10, 36))


def embed_text(text: str | None, size: int = 384) -> list[float]:
    """A unit vector from the characters of a text's words: the offline stand-in for an embedding model."""
    v = np.zeros(size)
    for i, word in enumerate((text or "").lower().split()):
        h = 0
        for c in word:
            h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
        h = abs(h)
        for j, c in enumerate(word[:10]):
            v[(h + j + 7 * i) % size] += ord(c) / 255 * 0.5 + np.sin(h * j) * 0.3
    norm = np.linalg.norm(v)
    return (v / norm if norm else v).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def hash_embedding(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(embed_text)

"""Tokens and BM25 as column expressions."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
_SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"


def raw_tokens(text: Column) -> Column:
    """Runs of letters and digits as they stand, also those too short for a token, and empty ones at the ends."""
    return F.split(text, _SPLIT)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of at least two bytes, lower-cased; null for null."""
    return F.transform(F.filter(raw_tokens(text), lambda t: F.octet_length(t) >= 2), F.lower)


def query_tokens(text: str) -> list[str]:
    """The tokens of a query, distinct, in order of appearance: the same runs as :func:`tokens`."""
    runs = regex.split(r"[^\p{Alphabetic}\p{N}]+", text)
    return list(dict.fromkeys(t.lower() for t in runs if len(t.encode()) >= 2))


def idf(n: Column, df: Column) -> Column:
    df = F.least(df, n)
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, length: Column, average: Column, weight: Column, k1: float = K1, b: float = B) -> Column:
    shape = tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / average)
    return F.when((tf > 0) & (average > 0) & (shape > 0), weight * tf * F.lit(k1 + 1) / shape).otherwise(0.0)

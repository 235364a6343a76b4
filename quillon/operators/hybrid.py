"""Keyword and vector retrieval fused by reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import B, K1
from ..plans.pipeline import INT_MAX
from .knn import find_nearest
from .text_search import search_text


def _ranked(df: DataFrame, name: str) -> DataFrame:
    """``_id`` and its rank from 0. At most a pool of candidates, so one partition holds them."""
    return df.select("_id", (F.row_number().over(W.orderBy(F.desc("score"), F.asc("_id"))) - 1).cast("int").alias(name))


def fuse(text: DataFrame, vector: DataFrame, top_k: int, k: float = 60.0, text_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """``_id, score, text_rank, vector_rank`` of two ranked lists: ``weight / (k + rank + 1)`` each."""
    share = lambda rank, w: F.coalesce(F.lit(float(w)) / (F.lit(float(k)) + F.col(rank) + 1), F.lit(0.0))
    both = _ranked(text, "text_rank").join(_ranked(vector, "vector_rank"), "_id", "full_outer")
    scored = both.select("_id", (share("text_rank", text_weight) + share("vector_rank", vector_weight)).alias("score"), "text_rank", "vector_rank")
    return scored.orderBy(F.desc("score"), F.asc("_id")).limit(min(max(top_k, 0), INT_MAX))


def hybrid_search(
    df: DataFrame, text_field: str, query: str, vector_field: str, vector: Sequence[float], top_k: int = 10, metric: str = "cosine", filter: object = None,  # noqa: A002
    candidates: int | None = None, k: float = 60.0, text_weight: float = 1.0, vector_weight: float = 1.0, k1: float = K1, b: float = B,
) -> DataFrame:
    """Fused hits of both retrievers, each of which gives ``candidates`` (default: four times
    ``top_k``, at least 20). A rank is null where a retriever did not find the document."""
    pool = candidates if candidates is not None else max(4 * top_k, 20)
    text = search_text(df, text_field, query, pool, filter, k1, b)
    near = find_nearest(df, vector_field, vector, pool, metric, filter)
    return fuse(text, near, top_k, k, text_weight, vector_weight)

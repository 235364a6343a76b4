"""Reads: find with options, counts, pages and id lists. Every frame carries ``_id``."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans.filters import matching
from ..plans.pipeline import INT_MAX, order_columns, parse_sort


def with_id(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``_id`` from its natural key: the column itself, or a struct of several."""
    return df.withColumn("_id", F.col(keys[0]) if len(keys) == 1 else F.struct(*keys))


def find(df: DataFrame, filter: object = None, sort: dict | None = None, skip: int = 0, limit: int | None = None, fields: Sequence[str] | None = None) -> DataFrame:  # noqa: A002
    """Filter, sort, skip, limit, project, in this order. Ties of a sort, and the order under a
    ``skip`` or ``limit`` without one, go by ``_id`` ascending. ``fields`` keeps top-level fields
    and ``_id``; names that do not exist are ignored."""
    out = matching(df, filter)
    if skip < 0 or (limit is not None and limit < 0):
        raise EngineError("InvalidOperation", "skip and limit are 0 or more")
    if sort or skip or limit is not None:
        order = parse_sort(sort) if sort else []
        if "_id" in df.columns and all(p != "_id" for p, _ in order):
            order = [*order, ("_id", True)]
        out = out.orderBy(*order_columns(out, order))
    if skip:
        out = out.offset(min(skip, INT_MAX))
    if limit is not None:
        out = out.limit(min(limit, INT_MAX))
    if fields is not None:
        out = out.select(*(F.col(f"`{c}`") for c in out.columns if c == "_id" or c in fields))
    return out


def find_one(df: DataFrame, filter: object = None) -> DataFrame:  # noqa: A002
    return find(df, filter, limit=1)


def by_ids(df: DataFrame, ids: Sequence[object]) -> DataFrame:
    """The documents with the given ids; a short list becomes a pushed-down ``IN``."""
    return df.filter(F.col("_id").isin(*ids)) if ids else df.filter(F.lit(False))


def count(df: DataFrame, filter: object = None) -> DataFrame:  # noqa: A002
    return matching(df, filter).agg(F.count(F.lit(1)).alias("n"))


def page(df: DataFrame, number: int = 1, per_page: int = 50) -> tuple[DataFrame, int, int]:
    """A page in ``_id`` order, the number of documents and of pages. Pages start at 1 and hold 1
    to 500 documents."""
    per_page = min(500, max(1, per_page))
    number = max(1, number)
    total = df.count()
    return find(df, skip=(number - 1) * per_page, limit=per_page), total, -(-total // per_page)


def collect_within(df: DataFrame, seconds: float) -> list[Row]:
    """The rows, or ``QueryTimeout`` when they take longer; the query's jobs are then cancelled."""
    context = df.sparkSession.sparkContext
    tag, late = f"quillon-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if late.is_set():
            raise EngineError("QueryTimeout", f"no result within {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)

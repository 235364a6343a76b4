"""The client's query layer: declared parameters, stored result lists, hydration and the outbox."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.filters import matching
from .find import find

#: Milliseconds of the first and the longest wait, and documents per drain.
FIRST_WAIT, LONGEST_WAIT, DRAIN = 1_000, 300_000, 25
_PARAMETERS = {"eq": "$eq", "ne": "$ne", "gte": "$gte", "lte": "$lte", "gt": "$gt", "lt": "$lt", "contains": "$contains", "one_of": "$in"}


def parameter(op: str, field: str | None = None) -> tuple[str, str | None]:
    """A declared request parameter: ``eq ne gte lte gt lt contains one_of`` of a field, or ``shape``."""
    if op != "shape" and op not in _PARAMETERS:
        raise ValueError(f"unknown parameter kind {op}")
    return op, field


def define_params(declared: Mapping[str, tuple[str, str | None]]) -> Callable[[Mapping[str, object]], dict | None]:
    """A function from request values to a filter. Undeclared and shape parameters, nulls and empty
    lists narrow nothing; None where nothing narrows."""

    def bind(values: Mapping[str, object]) -> dict | None:
        clauses = []
        for name, value in values.items():
            op, field = declared.get(name, ("shape", None))
            if op == "shape" or field is None or value is None or value == []:
                continue
            clauses.append({field: value if op == "eq" else {_PARAMETERS[op]: value}})
        return None if not clauses else clauses[0] if len(clauses) == 1 else {"$and": clauses}

    return bind


def members(docs: DataFrame, ids: DataFrame, filter: object = None) -> DataFrame:  # noqa: A002
    """Documents of a stored result, in stored order: ``ids`` has ``query_id`` and ``ids``, an array.
    Tombstones (``_op`` is ``delete``) are hidden; null or empty lists have no members."""
    visible = matching(docs, filter)
    if "_op" in docs.columns:
        visible = visible.filter(~F.col("_op").eqNullSafe("delete"))
    listed = ids.select("query_id", F.posexplode("ids").alias("pos", "_id"))
    return listed.join(visible, "_id").orderBy("query_id", "pos")


def deduplicate(payload: DataFrame, order: str) -> DataFrame:
    """The last copy of each ``_id``, at the place of the first: ``order`` numbers the payload."""
    by_id = W.partitionBy("_id")
    last = payload.withColumn("__last", F.row_number().over(by_id.orderBy(F.desc(order)))).withColumn("__first", F.min(order).over(by_id))
    return last.filter("__last = 1").drop("__last", order).withColumnRenamed("__first", order)


def hydrate(docs: DataFrame, payload: DataFrame, order: str, now: int) -> tuple[DataFrame, DataFrame]:
    """Server documents merged into local ones, and the counts ``inserted, updated, skipped``.

    New ids are inserted, synced ones replaced, pending and failed ones left alone. ``docs`` has
    ``_sync`` (null counts as synced) and ``_changed_at``.
    """
    fresh = deduplicate(payload, order).drop(order)
    state = docs.select("_id", F.coalesce("_sync", F.lit("synced")).alias("__sync"))
    judged = fresh.join(state, "_id", "left").withColumn(
        "__what", F.when(F.col("__sync").isNull(), "inserted").when(F.col("__sync") == "synced", "updated").otherwise("skipped")
    )
    taken = judged.filter("__what <> 'skipped'").drop("__sync", "__what").withColumn("_sync", F.lit("synced")).withColumn("_changed_at", F.lit(now).cast("long"))
    merged = docs.join(taken.select("_id"), "_id", "left_anti").unionByName(taken, allowMissingColumns=True)
    counts = judged.agg(*(F.count_if(F.col("__what") == w).alias(w) for w in ("inserted", "updated", "skipped")))
    return merged, counts


def canonical(current: dict, new: dict) -> dict:
    """The update that makes ``current`` equal ``new``: all its fields set, all others unset."""
    kept = ("_id", "_changed_at")
    out: dict = {"$set": {k: v for k, v in new.items() if k not in kept}}
    if gone := {k: True for k in current if k not in new and k not in kept}:
        out["$unset"] = gone
    return out


def outbox(docs: DataFrame, now: int, limit: int = DRAIN) -> DataFrame:
    """The next pending documents to send, oldest change first."""
    return find(docs, {"$and": [{"_sync": "pending"}, {"_retry_at": {"$lte": now}}]}, sort={"_changed_at": 1}, limit=limit)


def coalesced(ops: DataFrame, order: str) -> DataFrame:
    """``_id, op``: what a document's pending writes amount to. An insert later deleted is nothing,
    and what follows a cancelled insert starts anew; a delete is final."""
    listed = ops.groupBy("_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "op"))), lambda r: r.op).alias("ops"))
    step = lambda a, x: (
        F.when(a == "", x)
        .when(a == "insert", F.when(x == "delete", "").otherwise("insert"))
        .when(a == "update", F.when(x == "delete", "delete").otherwise("update"))
        .otherwise("delete")
    )
    return listed.select("_id", F.aggregate("ops", F.lit(""), step).alias("op")).filter("op <> ''")


def backoff_ms(attempt: Column, random: Column | None = None) -> Column:
    """The wait before an attempt: doubling from a second to five minutes, a quarter more or less."""
    base = F.least(F.lit(float(FIRST_WAIT)) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(float(LONGEST_WAIT)))
    return F.round(base * (1 + ((random if random is not None else F.rand()) - 0.5) / 2)).cast("long")

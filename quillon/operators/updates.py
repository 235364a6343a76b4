"""Updates as projections: ``$set``, ``$unset``, ``$inc``, ``$push``, ``$pull``, in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.values import is_integer, is_number, literal
from ..plans.filters import compile_filter

OPERATORS = ("$set", "$unset", "$inc", "$push", "$pull")


def parse_update(spec: object) -> list[tuple[str, str, object]]:
    """``(operator, field, value)`` in the order of application."""
    if not isinstance(spec, dict) or not spec:
        raise EngineError("InvalidOperation", "an update names at least one operator")
    for op, body in spec.items():
        if op not in OPERATORS:
            raise EngineError("InvalidOperation", f"unknown update operator {op}")
        if not isinstance(body, dict) and not (op == "$unset" and isinstance(body, (list, tuple))):
            raise EngineError("InvalidOperation", f"{op} takes an object of fields")
    out = []
    for op in OPERATORS:
        body = spec.get(op, {})
        for name in body:
            if "." in name:  # a dotted name would make a new top-level field: refused
                raise EngineError("InvalidOperation", f"{op}: {name} is not a top-level field")
            if name == "_id":
                raise EngineError("InvalidOperation", "_id cannot be changed")
            out.append((op, name, body[name] if isinstance(body, dict) else None))
    return out


def _typed(value: object, kind: T.DataType, name: str) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    made = literal(value, kind)
    if made is None:
        raise EngineError("TypeError", f"{name}: {value!r} is not a {kind.simpleString()}")
    return made


def _new_kind(value: object) -> T.DataType:
    kinds = [(bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()), (bytes, T.BinaryType())]
    for python, kind in kinds:
        if isinstance(value, python):
            return kind
    if isinstance(value, (list, tuple)):
        return T.ArrayType(_new_kind(value[0]) if value else T.StringType())
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, _new_kind(v)) for k, v in value.items()])
    return T.StringType()


def _without(array: Column, value: Column) -> Column:
    return F.filter(array, lambda x: ~x.eqNullSafe(value))


def apply_update(df: DataFrame, matched: Column, spec: object, changed_at: int | None = None) -> DataFrame:
    """``df`` with the update applied to the rows where ``matched`` holds.

    A field that the schema lacks is added. ``$inc`` of null is an error where a row matches (as of
    any non-number), a missing field counts as 0; integers that overflow raise.
    """
    hit = F.coalesce(matched, F.lit(False))
    out = df.withColumn("__hit", hit)
    for op, name, value in parse_update(spec):
        known = name in out.columns
        kind = out.schema[name].dataType if known else None
        column = F.col(f"`{name}`")
        if op == "$unset":
            if not known:
                continue
            new, old = F.lit(None).cast(kind), column
        elif op == "$set":
            kind = kind or _new_kind(value)
            new, old = _typed(value, kind, name), column if known else F.lit(None).cast(kind)
        elif op == "$inc":
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise EngineError("TypeError", f"$inc: {name} takes a number")
            if not known:
                new, old = F.lit(value), F.lit(None).cast(_new_kind(value))
            elif not is_number(kind):
                raise EngineError("TypeError", f"$inc: {name} is a {kind.simpleString()}")
            else:
                total = column + (F.lit(value).cast("long") if is_integer(kind) and isinstance(value, int) else F.lit(float(value)))
                kept = is_integer(kind) and isinstance(value, int)
                total = total.cast("long") if kept else total
                new, old = F.when(column.isNull(), F.raise_error(F.lit(f"TypeError: $inc: {name} is null")).cast("long" if kept else "double")).otherwise(total), column
        elif op == "$push":
            kind = kind or T.ArrayType(_new_kind(value))
            if not isinstance(kind, T.ArrayType):
                raise EngineError("TypeError", f"$push: {name} is not an array")
            start = F.coalesce(column, F.array().cast(kind)) if known else F.array().cast(kind)
            new, old = F.array_append(start, _typed(value, kind.elementType, name)), column if known else F.lit(None).cast(kind)
        else:
            if not known or not isinstance(kind, T.ArrayType):
                continue
            gone = F.lit(None).cast(kind.elementType) if value is None else literal(value, kind.elementType)
            if gone is None:
                continue
            new, old = _without(column, gone), column
        out = out.withColumn(name, F.when(F.col("__hit"), new).otherwise(old))
    if changed_at is not None and "_changed_at" in out.columns:
        out = out.withColumn("_changed_at", F.when(F.col("__hit"), F.lit(changed_at).cast("long")).otherwise(F.col("_changed_at")))
    return out.drop("__hit")


def update_many(df: DataFrame, filter: object, spec: object, changed_at: int | None = None) -> DataFrame:  # noqa: A002
    found = compile_filter(filter, df.schema)
    return apply_update(df, F.lit(True) if found is None else found, spec, changed_at)


def update_one(df: DataFrame, filter: object, spec: object, changed_at: int | None = None) -> DataFrame:  # noqa: A002
    """The update on the matching document of smallest ``_id``."""
    found = compile_filter(filter, df.schema)
    first = (df if found is None else df.filter(found)).agg(F.min("_id").alias("__first"))
    marked = df.crossJoin(F.broadcast(first))  # one row
    return apply_update(marked, F.col("_id") == F.col("__first"), spec, changed_at).drop("__first")


def delete_many(df: DataFrame, filter: object = None) -> DataFrame:  # noqa: A002
    found = compile_filter({"$not": filter or {}}, df.schema)
    return df if found is None else df.filter(found)


def delete_one(df: DataFrame, filter: object = None) -> DataFrame:  # noqa: A002
    found = compile_filter(filter, df.schema)
    first = (df if found is None else df.filter(found)).agg(F.min("_id").alias("__first"))
    return df.crossJoin(F.broadcast(first)).filter(~F.coalesce(F.col("_id") == F.col("__first"), F.lit(False))).drop("__first")  # one row


def insert_many(df: DataFrame, new: DataFrame) -> DataFrame:
    """``df`` and the documents of ``new``; an id that exists, or twice in ``new``, is an error."""
    twice = new.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id")
    clash = new.select("_id").join(df.select("_id"), "_id", "left_semi").unionAll(twice).limit(1).collect()
    if clash:
        raise EngineError("DuplicateId", f"{clash[0][0]} exists")
    return df.unionByName(new, allowMissingColumns=True)


def upsert(df: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Documents of ``new`` replace those of ``df`` with the same id, whole. Of documents of ``new``
    with the same id the one of greatest ``order`` counts, without ``order`` the one of greatest hash."""
    by = F.col(order) if order else F.xxhash64(*(c for c in new.columns if c != "_id"), F.lit(0))
    one = new.groupBy("_id").agg(F.max_by(F.struct(*(f"`{c}`" for c in new.columns)), by).alias("__d")).select("__d.*")
    return df.join(new.select("_id"), "_id", "left_anti").unionByName(one, allowMissingColumns=True)

"""Literals against typed columns: equality is strict by type, order is exact across numbers."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
FLOATS = (T.DoubleType, T.FloatType)


def is_integer(kind: T.DataType) -> bool:
    return type(kind) in INTEGERS


def is_number(kind: T.DataType) -> bool:
    return is_integer(kind) or isinstance(kind, (*FLOATS, T.DecimalType))


def resolve(schema: T.StructType, path: str) -> tuple[T.DataType, Column, Column] | None:
    """Type, value and presence of a dotted path; None where the schema has no such field.

    Only structs are entered. A nested field is present where all its parents are not null.
    """
    kind: T.DataType = schema
    value, present = None, F.lit(True)
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        if value is not None:
            present = present & value.isNotNull()
        value = F.col(f"`{part}`") if value is None else value.getField(part)
        kind = kind[part].dataType
    return kind, value, present


def literal(value: object, kind: T.DataType) -> Column | None:
    """``value`` as a column of type ``kind`` if that loses nothing, else None."""
    if isinstance(value, bool):
        return F.lit(value) if isinstance(kind, T.BooleanType) else None
    if isinstance(value, (int, float)):
        if isinstance(value, float) and math.isnan(value):
            return None
        if is_integer(kind):
            whole = int(value) if math.isfinite(value) and value == int(value) else None
            bits = INTEGERS[type(kind)]
            return F.lit(whole).cast(kind) if whole is not None and -(1 << bits - 1) <= whole < 1 << bits - 1 else None
        if isinstance(kind, FLOATS):
            try:
                near = float(value)
            except OverflowError:
                return None
            return F.lit(near).cast(kind) if near == value else None
        if isinstance(kind, T.DecimalType):
            return F.lit(Decimal(str(value))).cast("decimal(38,10)") if math.isfinite(value) else None
        return None
    if isinstance(value, str):
        if isinstance(kind, T.StringType):
            return F.lit(value)
        return F.lit(value).cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else None
    if isinstance(value, (dt.datetime, dt.date)):
        return F.lit(value).cast(kind) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else None
    if isinstance(value, (bytes, bytearray)):
        return F.lit(bytes(value)) if isinstance(kind, T.BinaryType) else None
    if isinstance(value, (list, tuple)) and isinstance(kind, T.ArrayType):
        parts = [F.lit(None).cast(kind.elementType) if v is None else literal(v, kind.elementType) for v in value]
        return None if any(p is None for p in parts) else F.array(*parts).cast(kind)
    if isinstance(value, dict) and isinstance(kind, T.StructType) and list(value) == kind.fieldNames():
        parts = [F.lit(None).cast(f.dataType) if value[f.name] is None else literal(value[f.name], f.dataType) for f in kind]
        return None if any(p is None for p in parts) else F.struct(*(p.alias(f.name) for p, f in zip(parts, kind, strict=True)))
    return None


def compare(column: Column, kind: T.DataType, op: str, value: object) -> Column | None:
    """``column op value`` for op in ``gt gte lt lte``; None where the types have no order."""
    ops = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if isinstance(value, float) and math.isnan(value):
            return None
        if is_integer(kind):
            if isinstance(value, float) and math.isinf(value):
                return column.isNotNull() if (value > 0) == (op in ("lt", "lte")) else F.lit(False)
            # a fraction moves to the whole number on the side that keeps the comparison
            bound = math.floor(value) if op in ("gt", "lte") else math.ceil(value)
            if not -(1 << 63) <= bound < 1 << 63:
                return column.isNotNull() if (bound > 0) == (op in ("lt", "lte")) else F.lit(False)
            return ops[op](column, F.lit(bound).cast("long"))
        if isinstance(kind, FLOATS):
            try:
                near = float(value)
            except OverflowError:
                near = math.inf if value > 0 else -math.inf
            if near != value:  # no double equals the value: the neighbour decides, and strictness follows its side
                op = op[:2] + ("e" if (near > value) == (op[:2] == "gt") else "") if op[:2] in ("gt", "lt") else op
            found = ops[op](column, F.lit(near))
            return found & ~F.isnan(column) if op in ("gt", "gte") else found
        if isinstance(kind, T.DecimalType):
            return ops[op](column, F.lit(value))
        return None
    if isinstance(value, bool) != isinstance(kind, T.BooleanType) or isinstance(value, (list, tuple, dict, bytes)) or value is None:
        return None
    wanted = literal(value, kind)
    return None if wanted is None else ops[op](column, wanted)

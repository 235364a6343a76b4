"""Accumulators of ``$group``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.values import FLOATS, is_integer, is_number, resolve

OPERATORS = ("$sum", "$avg", "$min", "$max", "$count", "$push", "$addToSet", "$first", "$last")


def _bad(message: str) -> EngineError:
    return EngineError("InvalidOperation", message)


def parse_accumulator(name: str, spec: object) -> tuple[str, str, str | None]:
    """``(output, operator, field)``; no field where documents are counted."""
    if not isinstance(spec, dict) or len(spec) != 1:
        raise _bad(f"{name}: an accumulator is an object with one operator")
    ((op, of),) = spec.items()
    if op not in OPERATORS:
        raise _bad(f"{name}: unknown accumulator {op}")
    if op == "$count":
        return name, "$count", None
    if op == "$sum" and not isinstance(of, bool) and of == 1:
        return name, "$count", None
    if not isinstance(of, str):
        raise _bad(f"{name}: {op} takes a field")
    return name, op, of.removeprefix("$")


def accumulate(schema: T.StructType, spec: tuple[str, str, str | None], order: list[tuple[str, bool]]) -> Column:
    name, op, path = spec
    if op == "$count":
        return F.count(F.lit(1)).alias(name)
    found = resolve(schema, path)
    kind, value, present = found or (T.NullType(), F.lit(None), F.lit(False))
    return _MADE[op](schema, kind, value, present, order).alias(name)


def _sum(schema, kind, value, present, order) -> Column:  # noqa: ANN001
    if is_integer(kind):  # exact beyond 64 bits while summing; a total beyond them raises
        return F.coalesce(F.sum(value.cast("decimal(38,0)")), F.lit(0)).cast("long")
    return F.coalesce(F.sum(value), F.lit(0).cast(kind)) if is_number(kind) else F.max(F.lit(0).cast("long"))


def _avg(schema, kind, value, present, order) -> Column:  # noqa: ANN001
    return F.avg(value) if is_number(kind) else F.max(F.lit(None).cast("double"))


def _min(schema, kind, value, present, order) -> Column:  # noqa: ANN001
    if isinstance(kind, T.NullType):
        return F.max(F.lit(None).cast("string"))
    return F.when(F.count_if(present & value.isNull()) > 0, F.lit(None)).otherwise(F.min(value))


def _max(schema, kind, value, present, order) -> Column:  # noqa: ANN001
    if isinstance(kind, T.NullType):
        return F.max(F.lit(None).cast("string"))
    return F.max(F.when(~F.isnan(value), value)) if isinstance(kind, FLOATS) else F.max(value)


def _add_to_set(schema, kind, value, present, order) -> Column:  # noqa: ANN001
    null = F.lit(None).cast("string" if isinstance(kind, T.NullType) else kind)
    if isinstance(kind, T.NullType):
        value = null
    return F.concat(F.when(F.count_if(present & value.isNull()) > 0, F.array(null)).otherwise(F.array().cast(T.ArrayType(null_type(kind)))), F.sort_array(F.collect_set(value)))


def null_type(kind: T.DataType) -> T.DataType:
    return T.StringType() if isinstance(kind, T.NullType) else kind


def _ascending(schema: T.StructType, order: list[tuple[str, bool]]) -> list[Column] | None:
    """Keys whose ascending order is ``order``; None where a descending key has no negative."""
    keys = []
    for path, up in order:
        found = resolve(schema, path)
        if found is None:
            continue
        kind, value, _ = found
        if up:
            keys.append(value)
        elif is_number(kind):
            keys += [value.isNull(), -value.cast("decimal(38,0)") if is_integer(kind) else -value]
        else:
            return None
    return keys


def _ordered(schema: T.StructType, value: Column, order: list[tuple[str, bool]]) -> Column:
    """All values of a group as an array in document order."""
    keys = _ascending(schema, order)
    if keys is not None:
        rows = F.sort_array(F.collect_list(F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys)), value.alias("v"))))
        return F.transform(rows, lambda r: r.v)
    found = [(resolve(schema, p), up) for p, up in order]
    found = [(f[1], up) for f, up in found if f is not None]
    rows = F.collect_list(F.struct(*(k.alias(f"k{n}") for n, (k, _) in enumerate(found)), value.alias("v")))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for n in reversed(range(len(found))):
            x, y = a[f"k{n}"], b[f"k{n}"]
            low = F.lit(-1 if found[n][1] else 1)
            less = (x.isNull() & y.isNotNull()) | (x < y)
            more = (x.isNotNull() & y.isNull()) | (x > y)
            out = F.when(F.coalesce(less, F.lit(False)), low).when(F.coalesce(more, F.lit(False)), -low).otherwise(out)
        return out

    return F.transform(F.array_sort(rows, compare), lambda r: r.v)


def _push(schema, kind, value, present, order) -> Column:  # noqa: ANN001
    if isinstance(kind, T.NullType):
        return F.filter(F.collect_list(F.lit("")), lambda x: F.lit(False))
    return _ordered(schema, value, order)


def _edge(schema, kind, value, present, order, last: bool) -> Column:  # noqa: ANN001
    if isinstance(kind, T.NullType):
        return F.max(F.lit(None).cast("string"))
    keys = _ascending(schema, order)
    if keys is None:
        return F.element_at(_ordered(schema, value, order), -1 if last else 1)
    at = F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys))) if keys else F.lit(0)
    return F.max_by(value, at) if last else F.min_by(value, F.when(present, at))


def _first(schema, kind, value, present, order) -> Column:  # noqa: ANN001
    return _edge(schema, kind, value, present, order, False)


def _last(schema, kind, value, present, order) -> Column:  # noqa: ANN001
    return _edge(schema, kind, value, present, order, True)


_MADE = {"$sum": _sum, "$avg": _avg, "$min": _min, "$max": _max, "$addToSet": _add_to_set, "$push": _push, "$first": _first, "$last": _last}

"""The filter language: dictionaries to a syntax tree to a boolean column.

Predicates are two-valued. The tree is compiled in negation normal form: positive predicates stay
bare, so that they reach the parquet scan, and only what stands under a negation is guarded
against null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions import text as text_functions
from ..functions.values import compare, literal, resolve


@dataclass(frozen=True)
class All:
    """Matches every document."""


@dataclass(frozen=True)
class Junction:
    every: bool
    parts: tuple


@dataclass(frozen=True)
class Negation:
    part: object


@dataclass(frozen=True)
class Test:
    field: str
    op: str
    value: object


ORDER = {"$gt": "gt", "$gte": "gte", "$lt": "lt", "$lte": "lte"}


def _bad(message: str) -> EngineError:
    return EngineError("InvalidFilter", message)


def parse(spec: object) -> object:
    """The syntax tree of a filter; malformed filters raise ``InvalidFilter``."""
    if spec is None or spec == {}:
        return All()
    if not isinstance(spec, dict):
        raise _bad(f"a filter is an object, not {spec!r}")
    parts = []
    for key, value in spec.items():
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)):
                raise _bad(f"{key} takes a list")
            parts.append(Junction(key == "$and", tuple(map(parse, value))))
        elif key == "$not":
            parts.append(Negation(parse(value)))
        elif key.startswith("$"):
            raise _bad(f"unknown operator {key}")
        else:
            parts.append(_field(key, value))
    return parts[0] if len(parts) == 1 else Junction(True, tuple(parts))


def _field(name: str, value: object) -> object:
    if not isinstance(value, dict):
        return Test(name, "$eq", value)
    if not value:
        raise _bad(f"{name}: an empty condition")
    tests = []
    for op, v in value.items():
        if op in ("$in", "$nin"):
            if not isinstance(v, (list, tuple)):
                raise _bad(f"{op} takes a list")
        elif op == "$exists":
            if not isinstance(v, bool):
                raise _bad("$exists takes true or false")
        elif op in ("$contains", "$regex"):
            if not isinstance(v, str):
                raise _bad(f"{op} takes a string")
            if op == "$regex":
                check_regex(v)
        elif op not in ("$eq", "$ne", *ORDER):
            raise _bad(f"unknown operator {op}")
        tests.append(Test(name, op, tuple(v) if isinstance(v, list) and op in ("$in", "$nin") else v))
    return tests[0] if len(tests) == 1 else Junction(True, tuple(tests))


_NOT_LINEAR = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?(?:=|!|<=|<!)|\\[1-9]|\\k<)")


def check_regex(pattern: str) -> None:
    """Refuse what has no linear-time match, and what the JVM cannot compile."""
    if _NOT_LINEAR.search(pattern):
        raise _bad(f"look-around and back-references are not supported: {pattern}")
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        spark._jvm.java.util.regex.Pattern.compile("(?U)" + pattern)  # noqa: SLF001
    except Exception as e:
        raise _bad(f"{pattern}: not a regular expression") from e


def compile_filter(spec: object, schema: T.StructType) -> Column | None:
    """The boolean column of a filter, or None where every document matches."""
    tree = parse(spec)
    return None if isinstance(tree, All) else _compile(tree, schema, False)


def matching(df, spec: object):  # noqa: ANN001, ANN201
    """``df`` restricted to the documents that match."""
    found = compile_filter(spec, df.schema)
    return df if found is None else df.filter(found)


def _compile(node: object, schema: T.StructType, negated: bool) -> Column:
    if isinstance(node, All):
        return F.lit(not negated)
    if isinstance(node, Negation):
        return _compile(node.part, schema, not negated)
    if isinstance(node, Junction):
        parts = [_compile(p, schema, negated) for p in node.parts]
        every = node.every != negated
        if not parts:
            return F.lit(every)
        return reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), parts)
    return _test(node, schema, negated)


def _test(node: Test, schema: T.StructType, negated: bool) -> Column:
    op = node.op
    if op in ("$ne", "$nin"):
        return _test(Test(node.field, {"$ne": "$eq", "$nin": "$in"}[op], node.value), schema, not negated)
    found = resolve(schema, node.field)
    if op == "$exists":
        present = F.lit(False) if found is None else found[2]
        return ~present if node.value == negated else present
    if op == "$contains" and not text_functions.query_tokens(node.value):
        return F.lit(not negated)
    if found is None:
        return F.lit(negated)
    kind, value, present = found
    if op == "$eq" and not isinstance(kind, T.ArrayType) and node.value is not None:
        wanted = literal(node.value, kind)
        if wanted is None:
            return F.lit(negated)
        if isinstance(kind, (T.DoubleType, T.FloatType, T.StringType, T.BooleanType)) or not negated:
            return ~value.eqNullSafe(wanted) if negated else value == wanted
    made = _positive(node, kind, value, present)
    return ~F.coalesce(made, F.lit(False)) if negated else made


def _positive(node: Test, kind: T.DataType, value: Column, present: Column) -> Column:
    op = node.op
    if op == "$eq":
        return _equal(kind, value, present, node.value)
    if op == "$in":
        return _in(kind, value, present, node.value)
    if op in ORDER:
        return _each(kind, value, lambda k, v: compare(v, k, ORDER[op], node.value))
    if op == "$contains":
        if not isinstance(kind, T.StringType):
            return F.lit(False)
        asked = F.array(*map(F.lit, text_functions.query_tokens(node.value)))
        return value.isNotNull() & (F.size(F.array_except(asked, text_functions.tokens(value))) == 0)
    return _each(kind, value, lambda k, v: v.rlike("(?U)" + node.value) if isinstance(k, T.StringType) else None)


def _each(kind: T.DataType, value: Column, test) -> Column:  # noqa: ANN001
    """``test`` on the value or, in an array, on any element."""
    if isinstance(kind, T.ArrayType):
        if test(kind.elementType, F.lit(None).cast(kind.elementType)) is None:
            return F.lit(False)
        return F.exists(value, lambda e: F.coalesce(test(kind.elementType, e), F.lit(False)))
    made = test(kind, value)
    return F.lit(False) if made is None else made


def _equal(kind: T.DataType, value: Column, present: Column, wanted: object) -> Column:
    if wanted is None:
        null = present & value.isNull()
        return null | F.exists(value, lambda e: e.isNull()) if isinstance(kind, T.ArrayType) else null
    whole = literal(wanted, kind)
    if isinstance(kind, T.ArrayType):
        element = literal(wanted, kind.elementType)
        tests = ([value == whole] if whole is not None else []) + ([F.exists(value, lambda e: F.coalesce(e == element, F.lit(False)))] if element is not None else [])
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    return F.lit(False) if whole is None else value == whole


def _in(kind: T.DataType, value: Column, present: Column, wanted: tuple) -> Column:
    if isinstance(kind, (T.ArrayType, T.StructType)):
        tests = [_equal(kind, value, present, w) for w in wanted]
    else:
        known = [x for x in (literal(w, kind) for w in wanted if w is not None) if x is not None]
        tests = ([value.isin(*known)] if known else []) + ([present & value.isNull()] if None in wanted else [])
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

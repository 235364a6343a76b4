"""Documents without a schema: one VARIANT column, and keys that order and group its values.

A variant can be neither compared nor grouped. A path's value becomes a key struct whose order is
that of the language: missing, null, booleans, numbers, strings, the rest.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..plans import filters
from .text import query_tokens, tokens

RANKS = {"missing": 0, "null": 1, "bool": 2, "number": 3, "string": 4, "other": 5}


def parse_documents(df: DataFrame, json_col: str) -> DataFrame:
    """``df`` with its JSON text as the variant ``doc``; text that is not JSON raises."""
    return df.withColumn("doc", F.parse_json(json_col))


def get(path: str, doc: str = "doc") -> Column:
    """The value at a dotted path: null where missing, a variant null where it is null."""
    steps = "".join(f"['{p.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}']" for p in path.split("."))
    return F.try_variant_get(F.col(doc), "$" + steps, "variant")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def kind(value: Column) -> Column:
    """``missing null bool int float string array object``."""
    return _once(F.schema_of_variant(value), lambda schema: _kind(value, schema))


def _kind(value: Column, schema: Column) -> Column:
    return (
        F.when(value.isNull(), "missing").when(F.is_variant_null(value), "null").when(schema == "BOOLEAN", "bool").when(schema == "BIGINT", "int")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "float").when(schema == "STRING", "string").when(schema.startswith("ARRAY"), "array").otherwise("object")
    )


def key(value: Column) -> Column:
    """A struct that sorts and groups like the value; whole and fractional numbers are different
    groups but one order."""
    k = kind(value)
    rank = F.when(k == "missing", 0).when(k == "null", 1).when(k == "bool", 2).when(k.isin("int", "float"), 3).when(k == "string", 4).otherwise(5)
    number = F.when(k == "bool", F.try_variant_get(value, "$", "boolean").cast("double")).when(rank == 3, F.try_variant_get(value, "$", "double"))
    whole = F.when(k == "int", F.try_variant_get(value, "$", "bigint"))
    text = F.when(k == "string", F.try_variant_get(value, "$", "string")).when(rank == 5, F.to_json(value))
    return F.struct(rank.alias("rank"), number.alias("num"), whole.alias("big"), text.alias("str"))


def compile_filter(spec: object) -> Column | None:
    """The filter language over the variant ``doc`` (``_id`` is a column beside it)."""
    tree = filters.parse(spec)
    return None if isinstance(tree, filters.All) else _compile(tree)


def _compile(node: object) -> Column:
    if isinstance(node, filters.All):
        return F.lit(True)
    if isinstance(node, filters.Negation):
        return ~_compile(node.part)
    if isinstance(node, filters.Junction):
        parts = [_compile(p) for p in node.parts]
        return reduce((lambda a, b: a & b) if node.every else (lambda a, b: a | b), parts) if parts else F.lit(node.every)
    return F.coalesce(_test(node), F.lit(False))


def _test(node: filters.Test) -> Column:
    op, value = node.op, F.col("_id").cast("variant") if node.field == "_id" else get(node.field)
    if op in ("$ne", "$nin"):
        return ~F.coalesce(_test(filters.Test(node.field, {"$ne": "$eq", "$nin": "$in"}[op], node.value)), F.lit(False))
    if op == "$exists":
        return value.isNotNull() if node.value else value.isNull()
    if op == "$in":
        parts = [F.coalesce(_test(filters.Test(node.field, "$eq", w)), F.lit(False)) for w in node.value]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
    if op == "$contains":
        asked = query_tokens(node.value)
        if not asked:
            return F.lit(True)
        text = F.when(kind(value) == "string", F.try_variant_get(value, "$", "string"))
        return F.size(F.array_except(F.array(*map(F.lit, asked)), tokens(text))) == 0
    if op == "$eq" and isinstance(node.value, (list, tuple, dict)):
        want = json.dumps(node.value, separators=(",", ":"), ensure_ascii=False)
        same = lambda v: F.to_json(v) == F.to_json(F.parse_json(F.lit(want)))
        return same(value) | F.coalesce(F.exists(_elements(value), same), F.lit(False))
    one = lambda v, k: F.coalesce(_scalar(v, k, op, node.value), F.lit(False))
    inner = lambda v: F.exists(F.try_variant_get(v, "$", "array<variant>"), lambda e: _once(kind(e), lambda k: one(e, k)))
    return _once(value, lambda v: _once(kind(v), lambda k: F.when(k == "array", F.coalesce(inner(v), F.lit(False))).otherwise(one(v, k))))


def _elements(value: Column) -> Column:
    return F.when(kind(value) == "array", F.try_variant_get(value, "$", "array<variant>"))


def _scalar(value: Column, k: Column, op: str, wanted: object) -> Column:
    number = F.try_variant_get(value, "$", "double")
    whole = F.try_variant_get(value, "$", "bigint")
    text = F.try_variant_get(value, "$", "string")
    if op == "$regex":
        return (k == "string") & text.rlike("(?U)" + wanted)
    if op == "$eq":
        if wanted is None:
            return k == "null"
        if isinstance(wanted, bool):
            return (k == "bool") & (F.try_variant_get(value, "$", "boolean") == wanted)
        if isinstance(wanted, int):  # strict: a whole number is not a fraction
            return (k == "int") & (whole == wanted) if -(1 << 63) <= wanted < 1 << 63 else F.lit(False)
        if isinstance(wanted, float):
            return F.lit(False) if math.isnan(wanted) else (k == "float") & (number == wanted)
        return (k == "string") & (text == wanted) if isinstance(wanted, str) else F.lit(False)
    compared = {"$gt": lambda a, b: a > b, "$gte": lambda a, b: a >= b, "$lt": lambda a, b: a < b, "$lte": lambda a, b: a <= b}[op]
    if isinstance(wanted, bool):
        return (k == "bool") & compared(F.try_variant_get(value, "$", "boolean"), F.lit(wanted))
    if isinstance(wanted, (int, float)):
        from pyspark.sql import types as T

        from .values import compare

        as_int, as_float = compare(whole, T.LongType(), filters.ORDER[op], wanted), compare(number, T.DoubleType(), filters.ORDER[op], wanted)
        return F.lit(False) if as_int is None else F.when(k == "int", as_int).when(k == "float", as_float).otherwise(False)
    return (k == "string") & compared(text, F.lit(wanted)) if isinstance(wanted, str) else F.lit(False)


def _sort_keys(k: Column) -> list[Column]:
    return [k.getField(n) for n in ("rank", "num", "str")]


def find(df: DataFrame, filter: object = None, sort: dict | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:  # noqa: A002
    """Documents of a dynamic collection (``_id, doc``) with the options of a typed find."""
    found = compile_filter(filter)
    out = df if found is None else df.filter(found)
    if sort or skip or limit is not None:
        keys = [c.asc() if way == 1 else c.desc() for p, way in (sort or {}).items() for c in _sort_keys(key(get(p)))]
        out = out.orderBy(*keys, F.asc("_id"))
    out = out.offset(skip) if skip else out
    return out if limit is None else out.limit(limit)


def group_count(df: DataFrame, path: str) -> DataFrame:
    """``_id, n``: documents by the value at ``path``; missing and null are one group."""
    if not path:
        raise EngineError("InvalidOperation", "a path names a field")
    k = key(get(path))
    both = F.when(k.rank <= 1, F.struct(F.lit(1).alias("rank"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("bigint").alias("big"), F.lit(None).cast("string").alias("str"))).otherwise(k)
    return df.groupBy(both.alias("_id")).agg(F.count(F.lit(1)).alias("n"))

"""Aggregation pipelines: each stage turns a frame and its order into the next, lazily."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..functions.values import resolve
from .accumulators import accumulate, parse_accumulator
from .filters import matching, parse

INT_MAX = 2**31 - 1
_HIDDEN = "__order_"


def _bad(message: str) -> EngineError:
    return EngineError("InvalidOperation", message)


@dataclass
class State:
    """A frame, the order its rows stand in (dotted path, ascending) and whether rows are in it yet."""

    df: DataFrame
    order: list[tuple[str, bool]] = field(default_factory=lambda: [("_id", True)])
    pending: bool = False

    def keys(self) -> list[Column]:
        return order_columns(self.df, self.order)

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*self.keys()) if self.order else self.df


def order_columns(df: DataFrame, order: list[tuple[str, bool]]) -> list[Column]:
    """Sort columns: nulls lowest; unknown fields tie; paths that the schema lacks are left out."""
    out = []
    for path, up in order:
        found = resolve(df.schema, path)
        if found is not None:
            out.append(found[1].asc_nulls_first() if up else found[1].desc_nulls_last())
    return out


def parse_sort(spec: object) -> list[tuple[str, bool]]:
    if not isinstance(spec, dict) or not spec:
        raise _bad("$sort takes an object of fields")
    out = []
    for name, way in spec.items():
        if isinstance(way, bool) or way not in (1, -1):
            raise _bad(f"$sort: {name} must be 1 or -1")
        out.append((name, way == 1))
    return out


def parse_count(stage: str, spec: object) -> int:
    if isinstance(spec, bool) or not isinstance(spec, (int, float)) or spec < 0 or spec != int(spec):
        raise _bad(f"{stage} takes a whole number of 0 or more")
    return min(int(spec), INT_MAX)


def parse_project(spec: object) -> tuple[bool, list[str], bool]:
    """Whether listed fields are kept, the fields, and whether ``_id`` stays."""
    if not isinstance(spec, dict) or not spec:
        raise _bad("$project takes an object of fields")
    flags = {}
    for name, on in spec.items():
        if not isinstance(on, (bool, int, float)):
            raise _bad(f"$project: {name} must be true or false")
        flags[name] = bool(on)
    with_id = flags.pop("_id", None)
    if len(set(flags.values())) > 1:
        raise _bad("$project cannot mix kept and dropped fields")
    keeps = next(iter(flags.values())) if flags else bool(with_id)
    return keeps, list(flags), with_id is not False


def parse_pipeline(pipeline: object) -> list[tuple[str, object]]:
    """Checked stages; every error is raised before anything runs."""
    if not isinstance(pipeline, (list, tuple)):
        raise _bad("a pipeline is a list of stages")
    out: list[tuple[str, object]] = []
    for stage in pipeline:
        if not isinstance(stage, dict) or len(stage) != 1:
            raise _bad("a stage is an object with one key")
        ((name, spec),) = stage.items()
        if name == "$match":
            parse(spec)
            out.append((name, spec))
        elif name == "$group":
            out.append((name, _parse_group(spec)))
        elif name == "$sort":
            out.append((name, parse_sort(spec)))
        elif name in ("$skip", "$limit"):
            out.append((name, parse_count(name, spec)))
        elif name == "$project":
            out.append((name, parse_project(spec)))
        else:
            raise _bad(f"unknown stage {name}")
    return out


def _parse_group(spec: object) -> tuple[str | None, list]:
    if not isinstance(spec, dict) or "_id" not in spec:
        raise _bad("$group needs _id")
    key = spec["_id"]
    if key is not None and not isinstance(key, str):
        raise _bad("$group: _id is a field or null")
    return None if key is None else key.removeprefix("$"), [parse_accumulator(n, a) for n, a in spec.items() if n != "_id"]


def aggregate(df: DataFrame, pipeline: object) -> DataFrame:
    """The result of a pipeline over ``df``, which should carry ``_id``.

    Without a ``$sort`` documents stand in ``_id`` order where order matters (``$skip``,
    ``$limit``, ordered accumulators).
    """
    state = State(df)
    for name, spec in parse_pipeline(pipeline):
        state = _STAGES[name](state, spec)
    out = state.sorted() if state.pending else state.df
    return out.select(*(F.col(f"`{c}`") for c in out.columns if not c.startswith(_HIDDEN)))


def _match(state: State, spec: object) -> State:
    return State(matching(state.df, spec), state.order, state.pending)


def _sort(state: State, order: list[tuple[str, bool]]) -> State:
    return State(state.df, order + ([] if any(p == "_id" for p, _ in order) else [("_id", True)]), True)


def _skip(state: State, n: int) -> State:
    return State(state.sorted().offset(n), state.order, True) if n else state


def _limit(state: State, n: int) -> State:
    return State(state.sorted().limit(n), state.order, True)


def _project(state: State, spec: tuple[bool, list[str], bool]) -> State:
    keeps, names, with_id = spec
    df, hidden = state.df, [c for c in state.df.columns if c.startswith(_HIDDEN)]
    open_ = [c for c in df.columns if c not in hidden]
    kept = [c for c in open_ if (c in names) == keeps and c != "_id" or c == "_id" and with_id]
    order = []
    for n, (path, up) in enumerate(state.order):
        if path.split(".")[0] in (*kept, *hidden):
            order.append((path, up))
        elif (found := resolve(df.schema, path)) is not None:  # the order outlives its dropped columns
            name = f"{_HIDDEN}{n}_{len(hidden)}"
            df = df.withColumn(name, found[1])
            hidden.append(name)
            order.append((name, up))
    return State(df.select(*(F.col(f"`{c}`") for c in (*kept, *hidden))), order, state.pending)


def _group(state: State, spec: tuple[str | None, list]) -> State:
    key, accumulators = spec
    df = state.df
    found = None if key is None else resolve(df.schema, key)
    by = F.lit(None).cast("string") if found is None else found[1]
    made = [accumulate(df.schema, a, state.order) for a in accumulators]
    out = df.groupBy(by.alias("_id")).agg(*made) if made else df.groupBy(by.alias("_id")).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return State(out, [("_id", True)] if _orderable(out.schema["_id"].dataType) else [], False)


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


_STAGES = {"$match": _match, "$group": _group, "$sort": _sort, "$skip": _skip, "$limit": _limit, "$project": _project}

"""Nearest neighbours: exact for one query, exact for many, approximate by random projections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import EngineError
from ..functions.vector import METRICS, score
from ..plans.filters import matching
from ..plans.pipeline import INT_MAX

#: Vectors from this length on are scored in numpy, if no more rows than this are asked for.
LONG, KEPT = 128, 10_000
#: Query vectors that travel to the tasks at once.
QUERY_BLOCK = 4096
#: Numbers that a block of queries, or its best rows, hold at most (but one query's); rows and queries that are
#: compared at once; pairs that are scored at once.
BLOCK_VALUES, STEP, PAIRS = 1 << 20, 512, 1 << 17


def check_dimensions(query: Sequence[float], dimensions: int | None) -> None:
    if dimensions is not None and len(query) != dimensions:
        raise EngineError("VectorDimensionMismatch", f"the index has {dimensions} dimensions, the query {len(query)}")


def find_nearest(df: DataFrame, field: str, query: Sequence[float], top_k: int = 10, metric: str = "cosine", filter: object = None, dimensions: int | None = None) -> DataFrame:  # noqa: A002
    """``df``'s nearest documents with ``score``, best first, ties by ``_id``. The filter applies
    before ranking; null vectors and vectors of another length are skipped."""
    check_dimensions(query, dimensions)
    fits = matching(df, filter).filter(F.size(field) == len(query))  # on the vector, so the score is computed once
    if len(query) >= LONG and 0 < top_k <= KEPT:
        return _nearest_rows(fits, field, query, top_k, metric)
    found = fits.withColumn("score", score(F.col(field), list(query), metric))
    return found.orderBy(F.desc("score"), F.asc("_id")).limit(min(max(top_k, 0), INT_MAX))


def _nearest_rows(fits: DataFrame, field: str, query: Sequence[float], top_k: int, metric: str) -> DataFrame:
    """:func:`find_nearest` where numpy scores whole batches; a task keeps its best ``top_k`` rows."""
    if metric not in METRICS:
        raise EngineError("InvalidOperation", f"unknown metric {metric!r}")
    asked, names = np.array(query, np.float64), fits.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(names.index(field))
            flat = lists.flatten()
            with np.errstate(invalid="ignore", over="ignore"):
                s = _score_rows(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1), asked, metric)
            bare = flat.is_null().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).any(1)
            if metric == "cosine":  # a vector with a null is as far as a zero one; else it has no score
                s, bare = np.where(bare, 0, s), None
            rows = pa.Table.from_batches([b]).append_column("score", pa.array(s, mask=bare))
            order = pa.array(np.where(np.isnan(s), np.inf, s), mask=bare)  # as Spark orders: not a number first, null last
            rows = rows.append_column("__order", order)
            rows = rows if best is None else pa.concat_tables([best, rows])
            at = pc.sort_indices(rows, [("__order", "descending"), ("_id", "ascending")])[:top_k]
            best = rows.take(at).combine_chunks()
        if best is not None:
            yield from best.drop_columns(["__order"]).to_batches()

    kind = T.StructType([*fits.schema, T.StructField("score", T.DoubleType())])
    return fits.mapInArrow(run, kind).orderBy(F.desc("score"), F.asc("_id")).limit(top_k)


def _score_rows(vectors: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    if metric == "dot":
        return vectors @ query
    if metric == "cosine":
        own = np.sqrt(np.einsum("nd,nd->n", vectors, vectors))
        size = own * math.sqrt(math.fsum(query * query))
        return np.divide(vectors @ query, size, out=np.zeros(len(vectors)), where=~(size <= 0))
    gap = vectors - query
    return 1 / (1 + np.sqrt(np.einsum("nd,nd->n", gap, gap)))


def _pair_scores(vectors: np.ndarray, queries: np.ndarray, rows: np.ndarray, asked: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the pairs ``vectors[rows[i]], queries[asked[i]]``, summed from the first component on: equal
    pairs score alike wherever they stand, which a matrix product does not promise."""
    total, own, other = np.zeros(len(rows)), np.zeros(len(vectors)), np.zeros(len(queries))
    for d in range(vectors.shape[1]):
        x, y = vectors[:, d], queries[:, d]
        total += (x[rows] - y[asked]) ** 2 if metric == "euclidean" else x[rows] * y[asked]
        own, other = own + x * x, other + y * y
    if metric == "dot":
        return total
    if metric == "euclidean":
        return 1 / (1 + np.sqrt(total))
    own, other = own[rows], other[asked]
    size = np.sqrt(own * other)
    size = np.where((size > 0) & np.isfinite(size), size, np.sqrt(own) * np.sqrt(other))
    return np.clip(np.divide(total, size, out=np.zeros_like(total), where=~((own <= 0) | (other <= 0))), -1, 1)


def _near_pairs(vectors: np.ndarray, queries: np.ndarray, least: np.ndarray, top_k: int, metric: str, left_out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of queries, rows of vectors) that can be among the ``top_k`` of their query: by a matrix
    product, with its rounding allowed for. ``least``: the score that each query's pairs must reach."""
    dot = queries @ vectors.T
    own, asked = np.sqrt((vectors * vectors).sum(1)), np.sqrt((queries * queries).sum(1))
    slack = 8 * (vectors.shape[1] + 8) * np.finfo(np.float64).eps
    if metric == "cosine":
        near = np.divide(dot, asked[:, None] * own, out=np.zeros_like(dot), where=~(own <= 0) & ~(asked <= 0)[:, None])
        slack = np.full(len(queries), slack)
    elif metric == "dot":
        near, slack = dot, slack * asked * own.max()
    else:  # the square of the distance
        near, slack = 2 * dot - own**2 - asked[:, None] ** 2, slack * (1 + (asked + own.max()) ** 2)
        far = (1 / np.where(least > 0, least, 1) - 1) ** 2
        least = np.where(np.isposinf(least), least, np.where(least > 0, -far, -np.inf))
    if left_out is not None:
        near[left_out] = -np.inf
    if len(vectors) > top_k and np.isneginf(least).any():
        least = np.fmax(least, np.partition(near, len(vectors) - top_k, 1)[:, len(vectors) - top_k] - slack)
    bound = least - slack
    return np.nonzero(~(near < np.where(np.isnan(bound), -np.inf, bound)[:, None]))


class _Best:
    """The best of the vectors seen so far for each query of a block. Vectors meet queries ``STEP`` by ``STEP``, so
    memory depends on neither's number; what is kept is ``top_k`` rows of the ids ``found`` for each query."""

    def __init__(self, queries: np.ndarray, top_k: int, metric: str):
        self.queries, self.top_k, self.metric = queries, top_k, metric
        self.found: pa.Array | None = None
        self.rows = np.full((len(queries), top_k), -1)  # -1: none yet
        self.scores = np.full(self.rows.shape, np.nan)
        self.order = np.full(self.rows.shape, -np.inf)  # as Spark orders scores: not a number first, null last

    def add(self, ids: pa.Array, vectors: np.ndarray, bare: np.ndarray, allowed: Callable[[slice, slice], np.ndarray] | None = None) -> None:
        """``bare``: vectors with a null component, which have no score. ``allowed``: of rows of queries and of
        vectors, the pairs that count."""
        first = 0 if self.found is None else len(self.found)
        found = ids if self.found is None else pa.concat_arrays([self.found, ids])
        place = np.empty(len(found), np.int64)
        place[_ordered(found)] = np.arange(len(found))
        for v in range(0, len(vectors), STEP):
            part, lost = vectors[v : v + STEP].astype(np.float64), bare[v : v + STEP]
            for q in range(0, len(self.queries), STEP):
                self._merge(slice(q, q + STEP), part, lost, first + v, place, allowed and allowed(slice(q, q + STEP), slice(v, v + STEP)))
        kept, at = np.unique(self.rows, return_inverse=True)
        none = int(kept[0] == -1)
        self.found, self.rows = found.take(pa.array(kept[none:])), at.reshape(self.rows.shape) - none

    def _merge(self, some: slice, vectors: np.ndarray, bare: np.ndarray, first: int, place: np.ndarray, allowed: np.ndarray | None) -> None:
        queries, rows, scores, order = self.queries[some], self.rows[some], self.scores[some], self.order[some]
        left_out = None if allowed is None else ~allowed
        if bare.any():
            left_out = np.broadcast_to(bare, (len(queries), len(vectors))) if left_out is None else left_out | bare
        with np.errstate(all="ignore"):
            q, v = _near_pairs(vectors, queries, order[:, -1], self.top_k, self.metric, left_out)
            if allowed is not None:
                q, v = (x[allowed[q, v]] for x in (q, v))
            s = np.concatenate([np.zeros(0), *(_pair_scores(vectors, queries, v[i : i + PAIRS], q[i : i + PAIRS], self.metric) for i in range(0, len(q), PAIRS))])
        s = np.where(bare[v], np.nan, s)
        by = np.where(bare[v], -np.inf, np.where(np.isnan(s), np.inf, s))
        fit = by >= order[q, -1]
        touched, q = np.unique(q[fit], return_inverse=True)
        of = np.concatenate((np.repeat(np.arange(len(touched)), self.top_k), q))
        row, s, by = (np.concatenate((held[touched].ravel(), more[fit])) for held, more in ((rows, v + first), (scores, s), (order, by)))
        at = np.lexsort((np.where(row < 0, len(place), place[row]), -by, of))
        at = at[np.searchsorted(of[at], np.arange(len(touched)))[:, None] + np.arange(self.top_k)]
        rows[touched], scores[touched], order[touched] = row[at], s[at], by[at]

    def batches(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        size = max(1, PAIRS // self.top_k // 8)
        for i in range(0, len(self.rows), size):
            q, k = np.nonzero(self.rows[i : i + size] >= 0)
            q = q + i
            s = self.scores[q, k]
            none = np.isnan(s) & np.isneginf(self.order[q, k])
            if len(q):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), self.found.take(pa.array(self.rows[q, k])), pa.array(s, mask=none)], ["query_id", "_id", "score"])


def _ordered(ids: pa.Array) -> np.ndarray:
    """The rows of ids in Spark's ascending order."""
    columns = ids.flatten() if pa.types.is_struct(ids.type) else [ids]
    keys = [str(i) for i in range(len(columns))]
    return pc.sort_indices(pa.table(columns, names=keys), [(k, "ascending") for k in keys], null_placement="at_start").to_numpy()


def batch_nearest(df: DataFrame, field: str, queries: DataFrame, query_field: str, top_k: int = 10, metric: str = "cosine") -> DataFrame:
    """``query_id, rank, _id, score`` of the ``top_k`` nearest for every row of ``queries``.

    Queries (``_id`` and ``query_field``) go to the tasks in blocks of bounded size; each task keeps
    its own best ``top_k`` per query, and only those meet.
    """
    rows = queries.select("_id", query_field).filter(F.col(query_field).isNotNull()).toLocalIterator()
    return _batch(df, field, rows, queries.schema["_id"].dataType, top_k, metric)


def _batch(df: DataFrame, field: str, queries: Iterable, query_kind: T.DataType, top_k: int, metric: str, hashes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """:func:`batch_nearest` of rows (id, vector). With ``hashes``, a row of numbers for each vector, those that
    share one with the query come first, whatever their score, and the others fill up."""
    if metric not in METRICS:
        raise EngineError("InvalidOperation", f"unknown metric {metric!r}")
    id_kind, q_kind = df.schema["_id"].dataType.simpleString(), query_kind.simpleString()
    nothing = df.sparkSession.createDataFrame([], f"query_id {q_kind}, rank int, _id {id_kind}, score double")
    if top_k <= 0:
        return nothing
    top_k = min(top_k, df.count()) if top_k > BLOCK_VALUES else top_k
    parts: list[DataFrame] = []
    blocks: dict[int, list] = {}  # by the vectors' length

    def part(rows: list) -> DataFrame:
        ids, asked = pa.array([r[0] for r in rows], to_arrow_type(query_kind)), np.array([r[1] for r in rows], np.float64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [_Best(asked, top_k, metric) for _ in range(1 if hashes is None else 2)]
            own = hashes and hashes(asked)
            for b in batches:
                fits = np.flatnonzero(np.diff(np.asarray(b.column("v").offsets)) == asked.shape[1])
                if not len(fits):
                    continue
                chosen = b.take(pa.array(fits))
                flat = chosen.column("v").flatten()
                vectors = flat.to_numpy(zero_copy_only=False).reshape(-1, asked.shape[1])
                bare = flat.is_null().to_numpy(zero_copy_only=False).reshape(vectors.shape).any(1)
                if metric == "cosine":  # a vector with a null is as far as a zero one
                    vectors, bare = np.where(bare[:, None], 0, vectors), np.zeros_like(bare)
                if hashes is None:
                    best[0].add(chosen.column("_id"), vectors, bare)
                    continue
                theirs = hashes(vectors.astype(np.float64))
                shared = lambda q, v: (own[q, None] == theirs[None, v]).any(2)  # noqa: B023, E731
                best[0].add(chosen.column("_id"), vectors, bare, shared)
                best[1].add(chosen.column("_id"), vectors, bare, lambda q, v: ~shared(q, v))  # noqa: B023
            for i, one in enumerate(best):
                for b in one.batches(ids) if one.found is not None else ():
                    yield b.append_column("other", pa.array(np.full(b.num_rows, i, np.int32)))

        held = df.select("_id", F.col(field).alias("v")).filter("v is not null")
        return held.mapInArrow(run, f"query_id {q_kind}, _id {id_kind}, score double, other int")

    for row in queries:
        width = len(row[1])
        block = blocks.setdefault(width, [])
        block.append(row)
        if len(block) >= min(QUERY_BLOCK, BLOCK_VALUES // max(width, 1), BLOCK_VALUES // top_k):
            parts.append(part(blocks.pop(width)))
    parts += [part(b) for width, b in blocks.items() if width]
    if not parts:
        return nothing
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    nearest = (F.desc("score"), F.asc("_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("other", *nearest))
    out = out.withColumn("rank", rank).filter(F.col("rank") <= top_k)
    if hashes is not None:
        out = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*nearest)))
    return out.select("query_id", "rank", "_id", "score")


class CellIndex:
    """Vectors by the nearest of a few centres, for cosine and euclidean; a search reads few cells.

    The centres come from k-means over a bounded sample (``sample`` rows of smallest id hash); every
    vector is placed. Cells hold about the square root of the rows, so a search that probes ``probes``
    cells reads that many times the root.
    """

    def __init__(self, centres: np.ndarray, metric: str):
        self.centres, self.metric = centres, metric

    @classmethod
    def fit(cls, df: DataFrame, field: str, metric: str = "cosine", sample: int = 50_000, most: int = 4096, rounds: int = 10) -> CellIndex:
        if metric == "dot":
            raise EngineError("InvalidOperation", "an approximate index has no dot metric")
        held = df.filter(F.col(field).isNotNull())
        n = held.count()
        rows = held.orderBy(F.xxhash64("_id"), "_id").limit(sample).select(field).collect()  # at most ``sample`` rows
        x = _scaled(np.array([r[0] for r in rows], np.float64), metric) if rows else np.zeros((1, 0))
        centres = x[: min(most, max(1, round(n**0.5)), len(x))].copy()
        for _ in range(rounds):
            near = np.concatenate([_nearest(x[i : i + 4096], centres)[:, 0] for i in range(0, len(x), 4096)])
            total, size = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
            np.add.at(total, near, x)
            centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        return cls(centres, metric)

    def cells(self, df: DataFrame, field: str) -> DataFrame:
        """``cell, _id, v``: every vector of the centres' length with its cell."""
        width, metric, centres = self.centres.shape[1], self.metric, self.centres

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    x = np.asarray(b.column("v").flatten(), np.float64).reshape(-1, width)
                    cell = np.concatenate([_nearest(_scaled(x[i : i + 4096], metric), centres)[:, 0] for i in range(0, len(x), 4096)])
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("_id"), b.column("v")], ["cell", "_id", "v"])

        kind = f"cell int, _id {df.schema['_id'].dataType.simpleString()}, v {df.schema[field].dataType.simpleString()}"
        return df.filter(F.size(field) == width).select("_id", F.col(field).alias("v")).mapInArrow(run, kind)

    def probed(self, query: Sequence[float], probes: int) -> list[int]:
        return _nearest(_scaled(np.array([query], np.float64), self.metric), self.centres)[0, :probes].tolist()


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return x
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centres' numbers from the nearest on, for each row."""
    return np.argsort((centres * centres).sum(1) - 2 * x @ centres.T, axis=1, kind="stable")


class ApproximateIndex:
    """Random-projection hashing on unit vectors; cosine and euclidean only."""

    def __init__(self, df: DataFrame, field: str, metric: str = "cosine", bucket_length: float = 0.75, tables: int = 8, seed: int = 42):
        if metric == "dot":
            raise EngineError("InvalidOperation", "an approximate index has no dot metric")
        self.df, self.field, self.metric = df, field, metric
        self.bucket_length, self.tables, self.seed = bucket_length, tables, seed

    def _hashes(self) -> Callable[[np.ndarray], np.ndarray]:
        metric, length, tables, seed = self.metric, self.bucket_length, self.tables, self.seed

        def hashes(x: np.ndarray) -> np.ndarray:
            ways = np.random.default_rng(seed).normal(size=(tables, x.shape[1]))
            return np.floor(_scaled(x, metric) @ (ways / np.linalg.norm(ways, axis=1)[:, None]).T / length)

        return hashes

    def batch_nearest(self, queries: DataFrame, query_field: str, top_k: int = 10) -> DataFrame:
        """Like :func:`batch_nearest` over the vectors that share a bucket with the query in any table, and where these
        are too few over the others too. One pass hashes and ranks every vector for all queries of a block."""
        rows = queries.select("_id", query_field).filter(F.col(query_field).isNotNull()).toLocalIterator()
        return _batch(self.df, self.field, rows, queries.schema["_id"].dataType, top_k, self.metric, self._hashes())

    def find_nearest(self, query: Sequence[float], top_k: int = 10, filter: object = None) -> DataFrame:  # noqa: A002
        """Like the exact search over more candidates than asked for; a filter makes it exact."""
        if filter:
            return find_nearest(self.df, self.field, query, top_k, self.metric, filter)
        wide = top_k + max(top_k // 5, 8)
        near = _batch(self.df, self.field, [(0, list(query))], T.IntegerType(), wide, self.metric, self._hashes()).select("_id")
        near = self.df.join(F.broadcast(near) if wide <= KEPT else near, "_id", "left_semi")
        return find_nearest(near.select(*self.df.columns), self.field, query, top_k, self.metric)

"""Packing documents into token sequences by linear grouping.

Only the number of pieces of each length (at most ``capacity`` numbers) reaches the driver; there
the whole packing is planned in runs of equal sequences:

1. large lengths are split into groups of equal cardinality and rounded up to their group's largest;
2. configurations of the few rounded sizes are optimised by linear programming with column
   generation, and each is used as often as the optimum says, rounded down;
3. actual lengths take the configurations' places: from both ends of their groups, and in the last
   place the longest that fits what the others leave;
4. what is left over, then the small lengths, go longest first into the sequence where they fit best.

A piece finds its place in the plan from its length and its number among pieces of that length.
"""

from __future__ import annotations

import warnings
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BATCH_ROWS, map_arrow, materialize
from .tokens import DEFAULT_TOKENIZER, TextEncoder, load_tokenizer, together

CAPACITY = 2048
GROUPS = 32


def _knapsack(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worthy multiset of sizes within capacity."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = [g for g in range(len(sizes)) if worth[g] > 1e-12]
    smallest = min((sizes[g] for g in order), default=capacity + 1)
    size_of, worth_of = np.array([sizes[g] for g in order], int), np.array([worth[g] for g in order])
    for c in range(smallest, capacity + 1):
        fits = size_of <= c
        gain = np.where(fits, worth_of + best[np.maximum(c - size_of, 0)], 0)
        g = int(np.argmax(gain))
        best[c], take[c] = (gain[g], order[g]) if gain[g] > best[c - 1] + 1e-12 else (best[c - 1], -1)
    used, c = np.zeros(len(sizes)), capacity
    while c >= smallest:
        if take[c] < 0:
            c -= 1
        else:
            used[take[c]] += 1
            c -= sizes[take[c]]
    return best[capacity], used


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 20_000) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each: a basic optimum of the covering program."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    amount = np.array(demand, float) / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(n))
        worth, column = _knapsack(sizes, dual, capacity)
        if worth <= 1 + 1e-9:
            break
        direction = np.linalg.solve(basis, column)
        up = direction > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = amount - ratio[out] * direction
        amount[out] = ratio[out]
        basis[:, out] = column
        amount = np.maximum(amount, 0)
    else:
        warnings.warn("column generation stopped before its optimum; more sequences than needed may be used", stacklevel=2)
    return [(basis[:, j].copy(), float(amount[j])) for j in range(n)]


class Plan:
    """Where the r-th piece of each length goes, in runs."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int | None = None):
        self.capacity = capacity
        self.sequences = 0
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, first rank, pieces, first sequence, in each, offset
        self.rank: dict[int, int] = defaultdict(int)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> runs (first sequence, sequences)
        left = {k: v for k, v in counts.items() if v}
        if left.get(capacity):
            n = left.pop(capacity)
            self._put(capacity, n, self._new(n), 1, 0)
        self._large(left, large or capacity // 4, groups)
        for length in sorted(left, reverse=True):
            self._best_fit(length, left[length])

    def _new(self, n: int) -> int:
        first, self.sequences = self.sequences, self.sequences + n
        return first

    def _put(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        self.rows.append((length, self.rank[length], pieces, sequence, each, offset))
        self.rank[length] += pieces

    def _large(self, left: dict[int, int], bound: int, groups: int) -> None:
        lengths = sorted((x for x in left if x > bound), reverse=True)
        if not lengths:
            return
        n = np.zeros(self.capacity + 1, np.int64)
        for x in lengths:
            n[x] = left.pop(x)
        share, ranges, held = -(-int(n.sum()) // groups), [], 0
        for x in lengths:  # groups of equal cardinality, as far as equal lengths stay together
            if not ranges or held + n[x] > share and held:
                ranges.append([x, x])
                held = 0
            ranges[-1][0] = x
            held += n[x]
        demand = [int(n[lo : hi + 1].sum()) for lo, hi in ranges]
        for column, often in sorted(configurations([hi for _, hi in ranges], demand, self.capacity), key=lambda u: -u[1]):
            slots = [ranges[g] for g, k in enumerate(column) for _ in range(round(k))]
            if slots:
                self._substitute(n, slots, int(often + 1e-6), bound)
        left.update({x: int(n[x]) for x in lengths if n[x]})

    def _substitute(self, n: np.ndarray, slots: list[list[int]], times: int, bound: int) -> None:
        """Up to ``times`` sequences of a configuration with actual lengths: from alternate ends of
        the groups, but in the last place the longest that fits."""
        while times > 0:
            chosen: list[int] = []
            for i, (lo, hi) in enumerate(slots):
                space = self.capacity - sum(chosen)
                if i == len(slots) - 1:
                    lo, hi = bound + 1, space
                free = np.flatnonzero(n[lo : min(hi, space) + 1] > 0) + lo
                free = [x for x in (free[:4] if i % 2 and i < len(slots) - 1 else free[: -5 : -1]).tolist() if n[x] > chosen.count(x)]
                if not free:
                    break
                chosen.append(free[0])
            if not chosen or len(chosen) < len(slots) - 1:
                return
            often = min(times, *(int(n[x]) // chosen.count(x) for x in chosen))
            first, offset = self._new(often), 0
            for x in chosen:
                self._put(x, often, first, 1, offset)
                n[x] -= often
                offset += x
            self._free(self.capacity - offset, first, often)
            times -= often

    def _free(self, space: int, first: int, n: int) -> None:
        if space and n:
            self.room[space].append((first, n))

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            space = next((s for s in range(length, self.capacity) if self.room.get(s)), 0)
            if space:
                first, have = self.room[space].pop()
            else:
                space = self.capacity
                have = -(-n // (space // length))
                first = self._new(have)
            each = space // length
            offset = self.capacity - space
            full = min(have, n // each)
            if full:
                self._put(length, full * each, first, each, offset)
                self._free(space - each * length, first, full)
                n -= full * each
            if full < have:
                if n:
                    self._put(length, n, first + full, n, offset)
                    self._free(space - n * length, first + full, 1)
                    full, n = full + 1, 0
                self._free(space, first + full, have - full)

    def table(self) -> np.ndarray:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 6)
        return rows


_KEY = 1 << 44


def place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the ``rank``-th piece of each ``length``."""
    at = np.searchsorted(table[:, 0] * _KEY + table[:, 1], length * _KEY + rank, side="right") - 1
    row = table[at]
    k = rank - row[:, 1]
    return row[:, 3] + k // row[:, 4], row[:, 5] + (k % row[:, 4]) * length


def pieces_of(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces: whole ones, but the first may be shorter."""
    first = tokens % capacity
    out = [(0, first)] if first else []
    out.extend((s, capacity) for s in range(first, tokens, capacity))
    return out


def _pieces(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and length of all pieces of documents of these sizes (see :func:`pieces_of`)."""
    short = sizes % capacity
    many = sizes // capacity + (short > 0)
    doc = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    gap = np.where(short > 0, capacity - short, 0)[doc]  # what the first piece lacks
    start = np.maximum(number * capacity - gap, 0)
    return doc, number, start, (number + 1) * capacity - gap - start


def _rank(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each value among its equals, after those counted in ``seen``, which is brought up to date."""
    order = np.argsort(values, kind="stable")
    many = np.bincount(values, minlength=len(seen))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values)) - np.repeat(np.cumsum(many) - many, many)
    rank += seen[values]
    seen += many
    return rank


def tokenize_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document with their ids' checksum, the task that made them (``task``) and
    their number among that task's pieces of their length (``k``); ``with_ids`` adds the ids as the
    bytes of little-endian numbers."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "k", *["ids"] * with_ids]
    kept = _id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = TextEncoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for b in together(batches):
            found, sizes = encoder(b.column("text"))
            ends = np.cumsum(sizes + 1)
            ids = np.empty(len(found) + len(sizes), "<u4")
            inner = np.ones(len(ids), bool)
            inner[ends - 1] = False
            ids[inner], ids[ends - 1] = found, end_id
            doc, number, start, length = _pieces(sizes + 1, capacity)
            raw, cut = memoryview(ids).cast("B"), np.concatenate(([0], np.cumsum(length)))  # pieces follow each other
            crc = np.fromiter((zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)), np.int64, len(length))
            cols = [b.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(doc), task, np.int32)), pa.array(_rank(length, seen))]
            if with_ids:
                flat = ids.astype(kept)
                cols.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(cut * flat.itemsize), pa.py_buffer(flat)]).cast(pa.binary()))
            for at in range(0, len(doc), BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(at, BATCH_ROWS) for c in cols], names)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, k long" + ", ids binary" * with_ids
    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, kind)


def _id_type(tokenizer: str) -> str:
    """The narrowest number that holds every id of the vocabulary."""
    return "<u2" if load_tokenizer(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = DEFAULT_TOKENIZER, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Null and empty texts are one piece with the end id alone; very long texts are cut into pieces of
    ``capacity``. Rows with a null id and repeated rows are packed each, equal lengths in any order;
    an empty table gives no rows; further columns, whatever their names, are not read.
    """
    made = materialize(tokenize_pieces(docs, capacity, tokenizer, 0, id_col, text_col, with_ids), "pieces")
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    starts = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = Plan(counts, capacity, groups).table()
    held = _id_type(tokenizer)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sequence, offset = place(table, b.column("length").to_numpy(), b.column("rank").to_numpy())
                cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
                if with_ids:
                    raw = b.column("ids").cast(pa.large_binary())
                    cut = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + b.num_rows + 1]
                    flat = np.frombuffer(raw.buffers()[2], np.uint8)[cut[0] : cut[-1]].view(held).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(((cut - cut[0]) // np.dtype(held).itemsize).astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"])

    ranked = made.join(starts, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("first") + F.col("k")).alias("rank")
    )
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return map_arrow(ranked, put, kind)

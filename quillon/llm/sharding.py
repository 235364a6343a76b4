"""Byte-balanced sharding by histogram sort.

Rows are ordered by ``(xxhash64(text), doc_id, number of the row)``. The boundaries between shards are found without
sorting: every round counts the exact bytes and rows that lie below a set of candidate boundaries
over all partitions, and the brackets around each target shrink to the candidates next to it.
When every splitter is within tolerance, the rows move once, into ranges that are finer than
shards, so that no task ever holds a whole shard.

Equal texts are neighbours in this order. A splitter falls between two groups of equal texts where
one such place is within the tolerance, and inside a group (by ``doc_id``, then by a number that each row
gets when the keys are written) only where none is, as for a group larger than a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, materialize

_HALF = 1 << 63
#: Keys have three parts of 64 bits; below the first lie this many keys, in all this many.
_LOW, _ALL = 1 << 128, 1 << 192


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def _probe_bytes(probes: list[int]) -> np.ndarray:
    return np.frombuffer(b"".join(p.to_bytes(24, "big") for p in probes), dtype="S24")


def _keys_of(batch: pa.RecordBatch) -> np.ndarray:
    """The rows' signed parts as 24-byte strings in the same order."""
    parts = np.empty((batch.num_rows, 3), dtype=">u8")
    for i, name in enumerate("hku"):
        parts[:, i] = batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(_HALF)
    return np.ascontiguousarray(parts).view("S24").ravel()


def _counts(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows below each probe (a row lies below the probes greater than its key)."""
    edges = _probe_bytes(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, _keys_of(b), side="right")
            np.add.at(size, at, b.column("size").to_numpy())
            rows += np.bincount(at, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(rows[used])], ["at", "size", "n"])

    found = map_arrow(keys.select("h", "k", "u", "size"), count, "at long, size long, n long").groupBy("at").agg(F.sum("size"), F.sum("n")).collect()
    size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for at, s, n in found:
        size[at], rows[at] = s, n
    return np.cumsum(size)[:-1].tolist(), np.cumsum(rows)[:-1].tolist()


def find_splitters(keys: DataFrame, targets: list[tuple[float, float]], fan: int = 32) -> list[int]:
    """For each ``(bytes below, tolerance)`` the composite key of a boundary.

    Brackets shrink ``fan``-fold a round, first over hashes and, where a single hash's group holds
    the target and both its ends are out of tolerance, over ids and rows inside that group.
    """
    # state: low key, bytes below it, high key, bytes below it; low's rows lie left of the target
    total = keys.agg(F.sum("size")).first()[0] or 0
    open_ = {i: (0, 0, _ALL, total) for i in range(len(targets))}
    done: dict[int, int] = {}

    def settle(i: int) -> None:
        lo, lo_b, hi, hi_b = open_[i]
        want, tolerance = targets[i]
        key, off = min(((lo, abs(lo_b - want)), (hi, abs(hi_b - want))), key=lambda x: x[1])
        if off <= tolerance or hi - lo <= 1 or lo_b == hi_b:
            done[i] = key
            del open_[i]

    for i in list(open_):
        settle(i)
    while open_:
        asked: dict[int, list[int]] = {}
        for i, (lo, _, hi, _) in open_.items():
            unit = _LOW if (hi - lo) > _LOW else 1  # whole groups first
            a, b = -(-lo // unit), hi // unit
            if unit == _LOW and b - a < 1:
                unit, a, b = 1, lo, hi
            inside = {(a + (b - a) * j // fan) * unit for j in range(fan + 1)}
            asked[i] = sorted(p for p in inside if lo < p < hi)
        probes = sorted({p for ps in asked.values() for p in ps})
        below = dict(zip(probes, _counts(keys, probes)[0], strict=True)) if probes else {}
        for i, ps in asked.items():
            lo, lo_b, hi, hi_b = open_[i]
            for p in ps:
                if below[p] <= targets[i][0]:
                    lo, lo_b = p, below[p]
                else:
                    hi, hi_b = p, below[p]
                    break
            open_[i] = (lo, lo_b, hi, hi_b)
            settle(i)
    return [min(done[i], _ALL - 1) for i in range(len(targets))]


def shard_by_bytes(docs: DataFrame, shards: int = 16, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None, with_text: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    The law is ``bytes``: each shard's bytes are within ``tolerance`` of an even share at each
    boundary, or as near as the row at the boundary allows. ``slot`` counts from 0 without gaps in
    the order of ``(text hash, doc_id)``. ``grown_shard`` is null under this law. A null text has
    no bytes and size 1; very long texts count whole; null ids order first; rows that are wholly
    equal are told apart by the order in which the keys were written, so they can lie in different
    shards; an empty table gives no rows; further columns, whatever their names, are not read.
    ``with_text`` adds the row's own ``text``.
    """
    spark = docs.sparkSession
    carried = ["text"] if with_text else []
    text = F.col(text_col)
    keys = materialize(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), text_size(text).alias("size"), text_crc32(text).alias("text_crc32"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), *([text.alias("text")] if with_text else []),
        ).withColumns({"k": F.coalesce("doc_id", F.lit(-_HALF)), "u": F.monotonically_increasing_id()}),
        "shard",
    )
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = max(1, -(-parts // shards))  # ranges in each shard
    share = total / (shards * fine)
    targets = [(share * j, tolerance * share * fine if j % fine == 0 else 0.2 * share) for j in range(1, shards * fine)]
    cuts = find_splitters(keys, targets)
    for j in range(1, len(cuts)):  # a coarse cut never passes its neighbour
        cuts[j] = max(cuts[j], cuts[j - 1])
    below = [0, *_counts_at(keys, cuts)]
    first = [below[s * fine] for s in range(shards)]
    start = [below[r] - first[r // fine] for r in range(shards * fine)]
    edges, start_of = _probe_bytes(cuts) if cuts else np.empty(0, "S16"), np.array(start, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(edges, _keys_of(b), side="right").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(start_of[at])], [*b.schema.names, "range", "start"])

    kind = "doc_id long, size long, text_crc32 long, h long, " + ("text string, " if with_text else "") + "k long, u long, range long, start long"
    placed = map_arrow(keys, place, kind)
    rank = F.row_number().over(W.partitionBy("range").orderBy("h", "k", "u"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.floor(F.col("range") / fine).cast("int").alias("shard"),
        (F.col("start") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carried,
    )


def _counts_at(keys: DataFrame, cuts: list[int]) -> list[int]:
    """Rows below each cut; equal cuts share a count."""
    distinct = sorted(set(cuts))
    rows = dict(zip(distinct, _counts(keys, distinct)[1], strict=True)) if distinct else {}
    return [rows[c] for c in cuts]


def write_shards(docs: DataFrame, path: str, **kw: object) -> None:
    """Write the texts of ``docs`` under ``path``, one folder per shard, in slot order inside files.

    Every row is written, with its null, empty or very long text, its null id, and as often as it
    occurs; an empty table makes an empty folder; columns other than the two are left out. The texts
    are exchanged once: a task that has a range of a shard writes it.
    """
    placed = shard_by_bytes(docs, with_text=True, **kw).select("doc_id", "shard", "slot", "text")
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

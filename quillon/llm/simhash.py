"""SimHash near-duplicates by tiled exact comparison.

:func:`simhash_components` links fingerprints within a small radius; :func:`drop_near_copies` keeps
one text of each group of similar word shingles, which wide fingerprints find and an exact
comparison of the shingles confirms.

A fingerprint's population counts (set bits in each of its four 16-bit parts) form its tile.
Two fingerprints at distance r have counts whose differences sum to r or less, so tiles whose
counts differ beyond the radius are skipped, without loss. The rest are compared whole, tile
against tile, with numpy exclusive-or and bit counts. A tile pair reports a spanning forest of its
links, not the links, so a group of n close fingerprints costs about n rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, local_components, map_arrow, materialize
from .components import connected_components

SEED = 42
PARTS, PART_BITS = 4, 16
#: Fingerprints in a tile, about; a larger class of equal counts is cut into several tiles.
TILE = 1024


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 majority bits over XXH64 of the ``shingle``-word shingles, repeats included."""
    words = _words(text)
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return h(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    counts = np.zeros(64, np.int64)
    a, b = starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, len(a), 65536):
        hashes = np.array([h(joined[i:j], SEED) for i, j in zip(a[at : at + 65536], b[at : at + 65536], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = counts * 2 > len(a)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, fp long")


def near_offsets(radius: int) -> list[tuple[int, ...]]:
    """The differences of population counts that fingerprints within ``radius`` can have."""
    return [d for d in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, d)) <= radius]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        rows.append(i + at)
        cols.append(j)
    return np.concatenate(rows), np.concatenate(cols)


def fingerprint_links(distinct: DataFrame, radius: int = 2, tile: int = TILE) -> DataFrame:
    """``u, v``: pairs of fingerprints that connect, within components, all rows of ``distinct(fp)``
    that differ in at most ``radius`` bits. Fingerprints must be distinct."""
    width = (1 << PART_BITS) - 1
    count = lambda p: F.bit_count(F.shiftrightunsigned("fp", p * PART_BITS).bitwiseAND(F.lit(width)))
    base = PART_BITS + 2 * radius + 1  # room for offsets beyond either end
    code = sum(((count(p) + radius) * base**p for p in range(PARTS)), F.lit(0)).cast("int")
    coded = distinct.select("fp", code.alias("code"))
    # At most 17**4 = 83,521 rows, whatever the input: bounded by the width of a fingerprint.
    sizes = F.broadcast(coded.groupBy("code").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks")))
    tiles = (
        coded.join(sizes, "code")
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .groupBy("code", "chunk")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = materialize(tiles, "tiles")
    deltas = sorted(d for d in (sum(x * base**p for p, x in enumerate(o)) for o in near_offsets(radius)) if d >= 0)
    left = (
        tiles.select("code", "chunk", "fps", F.explode(F.array(*map(F.lit, deltas))).alias("delta"))
        .withColumn("code2", F.col("code") + F.col("delta"))
        .join(sizes.select(F.col("code").alias("code2"), "chunks"), "code2")
        .withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .filter("delta > 0 or chunk2 >= chunk")
    )
    right = tiles.select(F.col("code").alias("code2"), F.col("chunk").alias("chunk2"), F.col("fps").alias("fps2"))
    pairs = left.join(right, ["code2", "chunk2"]).select("fps", "fps2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_u, out_v = [], []
            for a, b in zip(batch.column("fps"), batch.column("fps2"), strict=True):
                fa, fb = np.asarray(a.values), np.asarray(b.values)
                u, v = _forest(fa, fb, *_links(fa.view(np.uint64), fb.view(np.uint64), radius))
                out_u.append(u)
                out_v.append(v)
            if out_u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_u)), pa.array(np.concatenate(out_v))], ["u", "v"])

    return map_arrow(pairs, compare, "u long, v long")


def _forest(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the links ``a[i]-b[j]``: each node, and the least it reaches."""
    if not len(i):
        return a[:0], a[:0]
    nodes, at = np.unique(np.concatenate((a[i], b[j])), return_inverse=True)
    label = local_components(len(nodes), at[: len(i)], at[len(i) :])
    hung = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[hung], nodes[label[hung]]


def simhash_components(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest ``doc_id`` reachable. Null, empty and blank texts have fingerprint zero and are linked
    like any other; very long texts are read whole. Rows without a ``doc_id`` link and connect like
    any other, but name no component; a component without any id has a null one. Repeated rows
    give repeated rows; an empty table gives none; further columns, whatever their names, are not
    read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("id")), "fps")
    found = connected_components(fingerprint_links(distinct, radius))
    classes = distinct.join(found, distinct.fp == found.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("class"))
    named = classes.groupBy("class").agg(F.min("id").alias("component_id"))
    classes = classes.join(named, "class").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies by wide fingerprints, confirmed by their shingles -----------------------------

#: Classes in a tile of wide fingerprints, texts in a block of shingles: two of them make a task's unit.
WIDE_TILE, BLOCK = 16_384, 500


def near_radius(similarity: float, bits: int) -> int:
    """Bits in which fingerprints of sets of this Jaccard similarity differ, but for 1 in 2,000.

    Majority bits of sets of equal size and cosine ``2s / (1 + s)`` differ with probability
    ``arccos / pi``; the radius lies 3.5 standard deviations above the mean.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + 3.5 * math.sqrt(bits * p * (1 - p)))


def shingle_hashes(words: list[bytes], size: int = 5) -> list[bytes]:
    """The distinct 128-bit hashes of the ``size``-word shingles; fewer words are one shingle, none have none."""
    if not words:
        return []
    joined, at = b" ".join(words), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    h = xxhash.xxh128_digest
    return list({h(joined[a : b - 1], SEED) for a, b in zip(at, at[size:] or at[-1:], strict=False)})


def wide_fingerprint(hashes: list[bytes]) -> np.ndarray:
    """128 majority bits of distinct shingles, as two numbers."""
    counts = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).view(np.int64)


def _wide_links(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` (columns: two fingerprint halves, shingles) that may be similar."""
    half, whole = near_radius(similarity, 64), near_radius(similarity, 128)
    order_a, order_b = np.argsort(a[:, 2], kind="stable"), np.argsort(b[:, 2], kind="stable")
    a, b = a[order_a], b[order_b]
    x, y = a[:, :2].astype(np.uint64).T.copy(), b[:, :2].astype(np.uint64).T.copy()
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = 64
    for at in range(0, len(a), step):
        end = min(at + step, len(a))
        low = int(np.searchsorted(b[:, 2], a[at, 2] * similarity - 1e-6))
        high = int(np.searchsorted(b[:, 2], a[end - 1, 2] / similarity + 1e-6, side="right"))
        for left in range(low, high, 4096):
            right = min(left + 4096, high)
            i, j = np.nonzero(np.bitwise_count(x[0, at:end, None] ^ y[0, None, left:right]) <= half)
            i, j = i + at, j + left
            far = np.bitwise_count(x[0, i] ^ y[0, j]) + np.bitwise_count(x[1, i] ^ y[1, j]) > whole
            rows.append(order_a[i[~far]])
            cols.append(order_b[j[~far]])
    return np.concatenate(rows), np.concatenate(cols)


def similar_pairs(sets: list[list[bytes]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``i < j`` of sets of this Jaccard similarity or more; empty sets have none."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.frombuffer(b"".join(b"".join(s) for s in sets), "S16")
    owner = np.repeat(np.arange(len(sets)), size)
    _, gram, times = np.unique(flat, return_inverse=True, return_counts=True)
    holders = owner[np.argsort(gram, kind="stable")]
    first = np.cumsum(times) - times
    out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    ends = np.cumsum(size)
    for i in range(len(sets)):
        mine = gram[ends[i] - size[i] : ends[i]]
        n = times[mine]
        at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        j = np.flatnonzero(both >= similarity * (size[i] + size - both) - 1e-9)
        j = j[(j > i) & (size[j] > 0)] if size[i] else j[:0]
        out_i.append(np.full(len(j), i))
        out_j.append(j)
    return np.concatenate(out_i), np.concatenate(out_j)


def _either(pairs: DataFrame, keys: list[str], run, kind: str) -> DataFrame:  # noqa: ANN001
    """``run`` over each group of ``pairs``, dealt out by its keys; groups are small, partitions are not merged."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys).applyInArrow(run, kind)


def near_groups(classes: DataFrame, similarity: float = 0.8, tile: int = WIDE_TILE) -> DataFrame:
    """``node, component``: classes ``(node, a, b, n)`` that candidates connect, of halves ``a`` and
    ``b`` of a fingerprint of ``n`` shingles.

    Sizes of similar sets differ by a factor of ``1 / similarity`` at most. Classes are dealt into
    tiles by that scale; tiles of the same or neighbouring sizes are compared whole, the others
    are skipped, without loss.
    """
    placed = classes.filter("n > 0").withColumn("s", F.floor(F.log("n") / -math.log(similarity)).cast("int"))
    # One row for each step of size: under 100, whatever the input.
    chunks = {r[0]: r[1] for r in placed.groupBy("s").agg(F.ceil(F.count("*") / tile).cast("int")).collect()}
    if not chunks:
        return classes.select("node", F.col("node").alias("component")).limit(0)
    table = F.create_map(*(F.lit(v) for s in chunks for v in (s, chunks[s])))
    many = lambda s: F.coalesce(F.try_element_at(table, s), F.lit(0))
    upto = lambda s: F.slice(F.sequence(F.lit(0), many(s)), F.lit(1), many(s))
    spot = lambda s, c1, d, c2, side: F.struct(s.alias("s"), c1.alias("c1"), d.alias("d"), c2.alias("c2"), side.alias("side"))
    placed = placed.withColumn("c", F.pmod(F.xxhash64("node"), many(F.col("s"))).cast("int"))
    s, c = F.col("s"), F.col("c")
    own = F.transform(upto(s), lambda x: spot(s, F.least(c, x), F.lit(0), F.greatest(c, x), (c > x).cast("int")))
    larger = F.transform(upto(s + 1), lambda x: spot(s, c, F.lit(1), x, F.lit(0)))
    smaller = F.transform(upto(s - 1), lambda x: spot(s - 1, x, F.lit(1), c, F.lit(1)))
    pairs = placed.select("node", "a", "b", "n", F.explode(F.concat(own, larger, smaller)).alias("p")).select("p.*", "node", "a", "b", "n")

    def compare(group: pa.Table) -> pa.Table:
        col = lambda name: group.column(name).to_numpy()
        rows, node, left = np.stack([col("a"), col("b"), col("n")], 1), col("node"), col("side") == 0
        same = col("d")[0] == 0 and col("c1")[0] == col("c2")[0]
        one, other = (left, left) if same else (left, ~left)
        u, v = _forest(node[one], node[other], *_wide_links(rows[one], rows[other], similarity))
        return pa.table({"u": u, "v": v})

    found = connected_components(_either(pairs, ["s", "c1", "d", "c2"], compare, "u long, v long"))
    return found.unionAll(found.select("component", "component").distinct())  # a component's least node names no link of its own


def _row_key(id_col: str, text: Column) -> list[Column]:
    """What tells rows apart: their id, ids before none, and text."""
    return [F.col(id_col).isNull().alias("bare"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h")]


def near_copy_rows(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", tile: int = WIDE_TILE, block: int = BLOCK) -> DataFrame:
    """``bare, id, h``: the key of the row that stays of each group of near copies (see :func:`drop_near_copies`)."""
    text = F.col(text_col)
    keyed = docs.select(*_row_key(id_col, text), text.alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same, wide, size = [], [], []
            for t in b.column("text"):
                words = _words(t.as_py())
                hashes = shingle_hashes(words, shingle)
                same.append(xxhash.xxh128_digest(b" ".join(words), SEED))
                wide.append(wide_fingerprint(hashes))
                size.append(len(hashes))
            halves = np.stack(wide) if wide else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bare", "id", "h")), pa.array(same, pa.binary()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(size, pa.int64())], ["bare", "id", "h", "same", "a", "b", "n"])

    sketches = map_arrow(keyed, sketch, "bare boolean, id long, h long, same binary, a long, b long, n long")
    classes = sketches.groupBy("same").agg(F.min(F.struct("bare", "id", "h")).alias("who"), F.min("a").alias("a"), F.min("b").alias("b"), F.min("n").alias("n"))
    classes = materialize(classes.drop("same").withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = materialize(near_groups(classes, similarity, tile), "groups")
    # Members of a group are compared block against block; a group of one block is one unit.
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = groups.join(sizes, "component").withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.join(classes.select("node", "who.*"), "node")
    # Merged whatever the size: the members grow with the input and are never sent to every task.
    texts = members.hint("merge").join(keyed, ["bare", "id", "h"]).dropDuplicates(["node"])
    each = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("k", x).alias("k1"), F.greatest("k", x).alias("k2")))
    units = texts.select("component", F.explode(each).alias("p"), "node", "text").select("component", "p.*", "node", "text")

    def verify(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        i, j = similar_pairs([shingle_hashes(_words(t.as_py()), shingle) for t in group.column("text")], similarity)
        u, v = _forest(node, node, i, j)
        return pa.table({"u": u, "v": v})

    found = connected_components(_either(units, ["component", "k1", "k2"], verify, "u long, v long"))
    final = classes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("class")).agg(F.min("who").alias("who"))
    kept = materialize(final.select("who.*"), "kept")
    for df in (classes, groups):
        discard(df)
    return kept


def drop_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near copies, with all their columns.

    Texts of the same words, and texts whose sets of ``shingle``-word shingles have Jaccard
    similarity ``similarity`` or more, are near copies, and so is what such links connect. The row
    of the smallest id stays, a row without an id only where there is no other; of rows of that id
    the one with the smallest text hash, and one of those that share id and text. Wide fingerprints
    propose the pairs (they miss about 1 in 2,000 at the lowest similarity, more where sets have
    under ten shingles, fewer above); the shingles themselves decide. Null, empty and blank texts
    are copies of each other; very long texts are read whole; an empty table gives no rows.
    """
    keys = [f"_quillon_{n}" for n in ("bare", "id", "h")]
    kept = near_copy_rows(docs, similarity, shingle, id_col, text_col, **sizes).toDF(*keys)
    rows = docs.select("*", *(k.alias(n) for k, n in zip(_row_key(id_col, F.col(text_col)), keys, strict=True)))
    return rows.join(kept.hint("merge"), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)

"""Embedding near-duplicates over a robust-pruned flat graph.

1. Equal vectors form one class; classes are compared, weighted by their sizes.
2. Classes go to the shards of their nearest few centroids, so shards overlap. Centroids come from
   k-means on a bounded sample. Where there are more classes than the centroids sent to tasks can
   part, wide shards are parted again by centroids of their own, which only their rows meet; so
   shards stay small at any size. A shard above ``block`` rows is cut into blocks by a hash.
3. In each block a proximity graph is built and pruned robustly: a neighbour is dropped if it is
   closer, by the factor ``alpha``, to a neighbour already taken. The adjacency lists that a class
   gets in its shards are united.
4. Every class searches the blocks of its shards greedily from their medoids with a beam; once it
   meets vectors within range, the search expands through all vectors in range.
5. What the search finds is verified: cosine in double precision, at least the threshold. Searches
   report the classes of the pairs found, in whatever shard and from whichever side.
6. The reported classes that share a shard are compared exactly, so each pair found counts for both
   ends. A pair is counted in one shard only, the lowest that holds both. Blocks report degrees and
   spanning forests, so a group of n close vectors costs about n rows.
7. The recall is audited: a sample's links, by brute force, against those counted.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, local_components, map_arrow, materialize
from .components import connected_components

#: Rows that k-means reads, centroids that are sent to tasks, rows of a block.
SAMPLE, CENTROIDS, BLOCK = 40_000, 4096, 2000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)  # so that neither tiny nor huge values leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Spherical k-means on unit rows; empty clusters keep their centre."""
    k = min(k, len(x))
    centre = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(x[i : i + 4096] @ centre.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, nearest, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        centre = np.where(size > 0, total / np.where(size > 0, size, 1), centre)
    return centre


def robust_prune(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours for each row from candidates ``ids`` (nearest first, -1 none) with similarities
    ``sims``: take the nearest, drop what is closer to it than to the row by ``alpha``; repeat."""
    n, width = ids.shape
    gap = np.where(ids >= 0, np.sqrt(np.maximum(0, 2 - 2 * sims)), np.inf)
    alive = ids >= 0
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    vectors = x[np.maximum(ids, 0)]
    for d in range(degree):
        at = np.argmax(alive, axis=1)
        some = alive[rows, at]
        if not some.any():
            break
        taken = np.where(some, ids[rows, at], -1)
        out[:, d] = taken
        to_taken = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nwd,nd->nw", vectors, x[np.maximum(taken, 0)], optimize=True)))
        alive &= ~((alpha * to_taken <= gap) & some[:, None])
        alive[rows, at] = False
    return out


def build_block(x: np.ndarray, degree: int, pool: int, alpha: float) -> np.ndarray:
    """Adjacency (row numbers, -1 none) of a block of unit rows, with back links within degree."""
    n = len(x)
    x = x.astype(np.float32)
    out = np.full((n, 2 * degree), -1, np.int64)
    if n < 2:
        return out
    width = min(pool, n - 1)
    for at in range(0, n, 256):
        sims = x[at : at + 256] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -9
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        value = np.take_along_axis(sims, near, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        out[at : at + 256, :degree] = robust_prune(value, near, x, degree, alpha)
    # back links fill the second half, those from a row's nearest neighbours first
    source, slot = np.nonzero(out[:, :degree] >= 0)
    target = out[source, slot]
    order = np.lexsort((slot, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    ok = place < degree
    out[target[ok], degree + place[ok]] = source[ok]
    return out


def greedy_range_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, threshold: float, beam: int = 32, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """``(query number, row)`` of rows within range, found along the graph from the medoid."""
    n, found_q, found_r = len(x), [], []
    x = x.astype(np.float32)
    medoid = int(np.argmax(x @ x.mean(0)))
    loose = threshold - 1e-4  # verified in double afterwards
    beam = min(beam, n)
    for at in range(0, len(queries), batch):
        q = queries[at : at + batch].astype(np.float32)
        m = len(q)
        rows = np.arange(m)
        seen = np.zeros((m, n), bool)
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -9.0, np.float32)
        open_ = np.zeros((m, beam), bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = medoid, q @ x[medoid], True
        seen[:, medoid] = True
        within = np.zeros((m, n), bool)
        within[:, medoid] = sims[:, 0] >= loose
        while open_.any():
            best = np.argmax(np.where(open_, sims, -99), axis=1)
            live = np.flatnonzero(open_[rows, best])
            node = ids[live, best[live]]
            open_[live, best[live]] = False
            near = graph[node]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            value = np.where(fresh, np.einsum("nwd,nd->nw", x[near], q[live], optimize=True), -9)
            r, c = np.nonzero(fresh)
            seen[live[r], near[r, c]] = True
            hit = value[r, c] >= loose
            within[live[r[hit]], near[r[hit], c[hit]]] = True
            all_ids = np.concatenate((ids[live], near), 1)
            all_sims = np.concatenate((sims[live], value), 1)
            all_open = np.concatenate((open_[live], fresh), 1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_open))
        frontier_q, frontier_r = np.nonzero(within)
        while len(frontier_q):  # expand through everything in range
            near = graph[frontier_r]
            qq = np.repeat(frontier_q, near.shape[1])
            near = near.ravel()
            ok = near >= 0
            key = np.unique(qq[ok] * np.int64(n) + near[ok])
            key = key[~seen.ravel()[key]]
            seen.ravel()[key] = True
            qq, near = key // n, key % n
            parts = [np.einsum("nd,nd->n", x[near[i : i + 65536]], q[qq[i : i + 65536]]) for i in range(0, len(near), 65536)]
            good = (np.concatenate(parts) if parts else np.empty(0)) >= loose
            frontier_q, frontier_r = qq[good], near[good]
            within[frontier_q, frontier_r] = True
        a, b = np.nonzero(within)
        found_q.append(a + at)
        found_r.append(b)
    return np.concatenate(found_q) if found_q else np.empty(0, int), np.concatenate(found_r) if found_r else np.empty(0, int)


def _close_pairs(q: np.ndarray, x: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row of q, row of x)`` of all pairs within range, the cosine of a pair the same from either side."""
    for at in range(0, len(q), 256):
        a, b = np.nonzero(q[at : at + 256] @ x.T >= threshold - 1e-9)
        for i in range(0, len(a), 65536):
            m, n = a[i : i + 65536] + at, b[i : i + 65536]
            exact = np.einsum("nd,nd->n", q[m], x[n])
            yield m[exact >= threshold], n[exact >= threshold]


def _lowest_common(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """For each pair of rows of shard numbers (-1 none) the lowest that both hold."""
    same = (mine[:, :, None] == theirs[:, None, :]) & (mine[:, :, None] >= 0)
    return np.where(same, mine[:, :, None], np.iinfo(np.int64).max).min((1, 2))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """``rows(vec_id, embedding, fit)`` and the classes ``(rep, embedding, n)`` of fit vectors.
    A vector is fit to link if it is not null, not zero, and has only finite components."""
    e = F.col("embedding")
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.coalesce(e.isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).withColumn("fit", fit)
    rows = rows.filter("vec_id is not null").unionAll(rows.filter("vec_id is null").withColumn("fit", F.lit(False)))
    return rows, rows.filter("fit").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))


#: Rows of a wide shard that its own centroids are learned from, and that are placed by them at once.
PART_SAMPLE, PART_ROWS = 20_000, 50_000


def _parted(placed: DataFrame, block: int, overlap: int) -> DataFrame:
    """``rep, embedding, n, shard``: rows of shards above two blocks go to the nearest of centroids of
    that shard, the others stay where they are."""
    wide = placed.groupBy("shard").agg(F.count("*").alias("rows")).filter(F.col("rows") > 2 * block)
    # At most CENTROIDS rows for each vector length.
    wide = F.broadcast(wide.select("shard", F.ceil(F.col("rows") / (block // 2)).alias("k"), F.ceil(F.col("rows") / PART_SAMPLE).alias("every"), F.ceil(F.col("rows") / PART_ROWS).cast("int").alias("slices")))
    rows = placed.select("rep", "embedding", "n", "shard").join(wide, "shard")

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        centre = kmeans(_unit(_matrix(pdf.sort_values("rep")["embedding"])), int(pdf["k"].iloc[0]))
        return pd.DataFrame({"shard": pdf["shard"].iloc[0], "rep": np.arange(len(centre)), "embedding": list(centre)})

    sample = rows.filter(F.pmod(F.xxhash64("rep", F.lit(3)), F.col("every")) == 0).select("shard", "rep", "embedding", "k")
    learned = materialize(sample.groupBy("shard").applyInPandas(learn, "shard long, rep long, embedding array<double>"), "centroids")
    asking = rows.select("shard", F.pmod(F.xxhash64("rep"), F.col("slices")).cast("int").alias("slice"), "rep", "embedding", "n")
    given = learned.join(wide, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "rep", "embedding", F.lit(None).cast("long").alias("n"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        centre, asks = pdf[pdf["n"].isna()].sort_values("rep"), pdf[~pdf["n"].isna()]
        if asks.empty or centre.empty:
            return asks[["rep", "embedding", "n", "shard"]].astype({"n": "int64"})
        c, x = _matrix(centre["embedding"]).astype(np.float32), _unit(_matrix(asks["embedding"])).astype(np.float32)
        near = np.concatenate([np.argsort(-(x[i : i + 4096] @ c.T), axis=1, kind="stable")[:, :overlap] for i in range(0, len(x), 4096)])
        at = np.repeat(np.arange(len(x)), near.shape[1])
        part = asks.iloc[at]
        return pd.DataFrame({"rep": part["rep"].to_numpy(), "embedding": part["embedding"].to_numpy(), "n": part["n"].to_numpy(np.int64), "shard": (part["shard"].to_numpy(np.int64) + 1 << 24) + near.ravel()})

    moved = asking.unionByName(given).groupBy("shard", "slice").applyInPandas(place, "rep long, embedding array<double>, n long, shard long")
    return placed.select("rep", "embedding", "n", "shard").join(wide, "shard", "left_anti").select("rep", "embedding", "n", "shard").unionByName(moved)


def near_links(classes: DataFrame, threshold: float = 0.95, overlap: int = 3, degree: int = 24, pool: int = 64, alpha: float = 1.2, beam: int = 32, block: int = BLOCK, most: int = CENTROIDS, passing: list[DataFrame] | None = None) -> DataFrame:
    """``node, other, degree``: for each class ``rep`` weighted counts of linked vectors (``other``
    null) and links of a spanning forest (``degree`` null). Classes are ``rep, embedding, n``.
    ``passing`` collects the tables that may go once the result has been written."""
    many = classes.count()
    dims = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    centres: dict[int, np.ndarray] = {}
    for d in dims:  # vectors of different length never link
        part = classes.filter(F.size("embedding") == d)
        k = int(min(most, max(1, (part.count() if len(dims) > 1 else many) // (block // 2))))
        sample = part.orderBy(F.xxhash64("rep"), "rep").limit(min(SAMPLE, 64 * k)).select("embedding").toPandas()
        centres[d] = kmeans(_unit(_matrix(sample["embedding"])), k).astype(np.float32)
    base = dict(zip(sorted(centres), np.cumsum([0, *(len(centres[d]) for d in sorted(centres))]).tolist(), strict=False))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            size = np.diff(np.asarray(lists.offsets))
            home: list = [None] * b.num_rows
            flat = np.asarray(lists.flatten())
            starts = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x = _unit(np.stack([flat[s : s + d] for s in starts[at].tolist()]))
                sims = x.astype(np.float32) @ centres[d].T
                top = np.argsort(-sims, axis=1, kind="stable")[:, : min(overlap, sims.shape[1])] + base[d]
                for n, t in zip(at.tolist(), top, strict=True):
                    home[n] = np.sort(t)
            yield pa.RecordBatch.from_arrays([b.column("rep"), lists, b.column("n"), pa.array(home, pa.list_(pa.int64()))], ["rep", "embedding", "n", "shards"])

    assigned = materialize(map_arrow(classes.select("rep", "embedding", "n"), assign, "rep long, embedding array<double>, n long, shards array<long>"), "shards")
    placed = assigned.withColumn("shard", F.explode("shards"))
    if many > most * block:
        placed = materialize(_parted(placed, block, overlap), "parted")
        homes = placed.groupBy("rep").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
        placed = placed.join(homes, "rep")
    # A row for each shard: at most ``most`` for each vector length, unless shards were parted.
    sizes = placed.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = placed.join(F.broadcast(sizes) if many <= most * block else sizes, "shard").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = materialize(members, "members")

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        reps = pdf["rep"].to_numpy()
        adjacency = build_block(_unit(_matrix(pdf["embedding"])), degree, pool, alpha)
        return pd.DataFrame({"rep": reps, "near": [reps[a[a >= 0]] for a in adjacency]})

    built = members.select("shard", "part", "rep", "embedding").groupBy("shard", "part").applyInPandas(graph, "rep long, near array<long>")
    united = built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    nodes = members.join(united, "rep")
    # Every block is searched by all rows of its shard, one slice of them at a time.
    stored = nodes.select("shard", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("slice"), "rep", "embedding", "near", F.lit(False).alias("asks"))
    asking = members.select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"), F.col("part").alias("slice"), "rep", "embedding", F.array().cast("array<long>").alias("near"), F.lit(True).alias("asks"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, has = pdf[pdf["asks"]].sort_values("rep"), pdf[~pdf["asks"]].sort_values("rep")
        if asks.empty or has.empty:
            return pd.DataFrame({"rep": []})
        x, q = _unit(_matrix(has["embedding"])), _unit(_matrix(asks["embedding"]))
        ids, ask_ids = has["rep"].to_numpy(), asks["rep"].to_numpy()
        width = max(1, max(map(len, has["near"])))
        links = np.full((len(ids), width), -1, np.int64)
        for row, near in enumerate(has["near"]):
            at = np.searchsorted(ids, near)
            at = at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == near)]
            links[row, : len(at)] = at
        a, b = greedy_range_search(x, links, q, threshold, beam)
        keep = ask_ids[a] != ids[b]
        a, b = a[keep], b[keep]
        exact = np.concatenate([np.einsum("nd,nd->n", q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]) if len(a) else np.empty(0)
        return pd.DataFrame({"rep": np.unique(np.concatenate((ask_ids[a[exact >= threshold]], ids[b[exact >= threshold]])))})

    linked = materialize(stored.unionAll(asking).groupBy("shard", "part", "slice").applyInPandas(search, "rep long").distinct(), "linked")
    again = materialize(members.join(linked, "rep"), "again")
    columns = ["rep", "embedding", "n", "shards"]
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    if passing is not None:
        passing += [assigned, members, linked, again]
    pairs = again.select("shard", "part", every.alias("slice"), *columns, F.lit(False).alias("asks")).unionAll(
        again.select("shard", every.alias("part"), F.col("part").alias("slice"), *columns, F.lit(True).alias("asks"))
    )

    def settle(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        asks, has = pdf[pdf["asks"]].sort_values("rep"), pdf[~pdf["asks"]].sort_values("rep")
        if asks.empty or has.empty:
            return pd.DataFrame({"node": [], "other": [], "degree": []})
        ids, ask_ids, n = has["rep"].to_numpy(), asks["rep"].to_numpy(), has["n"].to_numpy()
        wide = max(map(len, pdf["shards"]))
        homes = [np.stack([np.pad(v, (0, wide - len(v)), constant_values=-1) for v in f["shards"]]) for f in (asks, has)]
        nodes_ = np.unique(np.concatenate((ids, ask_ids)))
        at_ask, at_has = np.searchsorted(nodes_, ask_ids), np.searchsorted(nodes_, ids)
        count, label = np.zeros(len(asks), np.int64), np.arange(len(nodes_))
        for a, b in _close_pairs(_unit(_matrix(asks["embedding"])), _unit(_matrix(has["embedding"])), threshold):
            # a pair counts in the lowest shard that holds both
            keep = (ask_ids[a] != ids[b]) & (_lowest_common(homes[0][a], homes[1][b]) == shard)
            a, b = a[keep], b[keep]
            np.add.at(count, a, n[b])
            old = np.arange(len(nodes_))
            label = local_components(len(nodes_), np.concatenate((old, at_ask[a])), np.concatenate((label, at_has[b])))
        some, hung = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(nodes_)))
        return pd.DataFrame({
            "node": np.concatenate((ask_ids[some], nodes_[hung])),
            "other": pd.array([None] * len(some) + nodes_[label[hung]].tolist(), "Int64"),
            "degree": pd.array(count[some].tolist() + [None] * len(hung), "Int64"),
        })

    return pairs.groupBy("shard", "part", "slice").applyInPandas(settle, "node long, other long, degree long")


def embedding_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", **search: float) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Links join vectors of cosine ``threshold`` or more, in double precision, equal vectors
    included. Vectors that are null, empty or zero or hold a null or non-finite component link with
    nothing, nor do vectors of different length or rows without an id. Repeated rows are linked
    vectors; ``component_id`` is the smallest ``vec_id`` reachable, ``kept`` whether it is the row's
    own. Very long vectors are compared whole; an empty table gives no rows; further columns,
    whatever their names, are not read.
    """
    rows, classes = vector_classes(vectors, id_col, vec_col)
    rows, classes = materialize(rows, "vectors"), materialize(classes, "classes")
    passing: list[DataFrame] = []
    found = materialize(near_links(classes, threshold, passing=passing, **search), "links")
    for df in passing:
        discard(df)
    degree = found.filter("degree is not null").groupBy(F.col("node").alias("rep")).agg(F.sum("degree").alias("d"))
    component = connected_components(found.filter("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")))
    full = classes.join(degree, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    full = full.select("embedding", (F.coalesce("d", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    joined = rows.filter("fit").join(full, "embedding").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.filter("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audited_components(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", asked: int = 2000, enough: float = 0.9, **search: float) -> DataFrame:
    """:func:`embedding_components` with its measured ``recall`` in every row.

    ``asked`` vectors (those of smallest id hash) are compared with all by brute force; ``recall`` is
    the share of their links that were counted, 1 where they have none. Below ``enough`` a warning
    is raised.
    """
    out = materialize(embedding_components(vectors, threshold, id_col, vec_col, **search), "components")
    total, found = audit_recall(vectors, out, threshold, id_col, vec_col, asked)
    recall = found / total if total else 1.0
    if recall < enough:
        warnings.warn(f"{recall:.3f} of the links of {asked} audited vectors were found", stacklevel=2)
    return out.withColumn("recall", F.lit(recall))


def audit_recall(vectors: DataFrame, components: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", asked: int = 2000) -> tuple[int, int]:
    """Links of ``asked`` vectors with all others, by brute force, and how many of them ``components`` counts."""
    rows = vector_classes(vectors, id_col, vec_col)[0].filter("fit")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(asked).select("vec_id", "embedding").collect()
    parts = []
    for d in {len(r[1]) for r in sample}:
        ids, q = np.array([r[0] for r in sample if len(r[1]) == d]), _unit(np.array([r[1] for r in sample if len(r[1]) == d]))

        def count(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(q), np.int64)
            for b in batches:
                if b.num_rows:
                    total += (q @ _unit(np.stack(b.column("embedding").to_numpy(zero_copy_only=False))).T >= threshold).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["vec_id", "n"])

        parts.append(map_arrow(rows.filter(F.size("embedding") == d).select("embedding"), count, "vec_id long, n long"))
    if not parts:
        return 0, 0
    true = reduce(DataFrame.unionAll, parts).groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))  # not with itself
    counted = components.select("vec_id", "n_links").join(F.broadcast(true), "vec_id")  # at most ``asked`` rows
    got = counted.agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return got[0] or 0, got[1] or 0

"""Quality by importance resampling.

Two generative models of hashed n-grams (words and punctuation runs, and pairs of them), one of
target texts (labelled good) and one of all raw texts, give each text the log ratio of its
likelihoods. The sample is drawn without replacement by Gumbel top-k: every row's log ratio gets
independent Gumbel noise, a function of its id and the seed, and the k largest are selected. The
k-th largest key is found exactly by refining a histogram, without a global sort.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, map_arrow, materialize

BUCKETS = 10_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hasher:
    """Bucket numbers of a text's n-grams; single tokens are remembered."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.known) > 300_000:
            self.known.clear()
        tokens, known = _TOKEN.findall(text or ""), self.known
        codes = np.empty(len(tokens), np.uint64)
        for i, t in enumerate(tokens):
            c = known.get(t)
            if c is None:
                c = known[t] = zlib.crc32(t.encode())
            codes[i] = c
        pairs = (codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] + np.uint64(1)) >> np.uint64(20)
        return np.concatenate((codes % np.uint64(self.buckets), pairs % np.uint64(self.buckets))).astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, max_target: int = 4000, buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Log ratio of target to raw per bucket, and the share of good rows among labelled ones.

    ``labels`` has ``doc_id, quality``; rows whose crc32(doc_id) mod 5 is 0 are left out of it.
    Raw counts cover all documents; the target model reads at most ``max_target`` good rows, those
    of smallest id hash. Without good rows the ratio is 0 and the share 1.
    """
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    marked = labels.filter("doc_id is not null and quality is not null").filter(learn).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total, good = marked.agg(F.count("*"), F.sum("quality")).first()
    chosen = frozenset(r[0] for r in marked.filter("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).select("doc_id").collect())
    if not chosen:
        return np.zeros(buckets), 1.0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, hasher = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64), _Hasher(buckets)
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                found = np.bincount(hasher(t.as_py()), minlength=buckets)
                raw += found
                if i in chosen:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    raw, target = np.ones(buckets), np.ones(buckets)
    counted = map_arrow(docs.select("doc_id", "text"), count, "bucket long, raw long, target long")
    for b, r, t in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[b] += r
        target[b] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), good / total


def gumbel(doc_id: int | None, seed: int) -> float:
    raw = xxhash.xxh64_intdigest(str(doc_id), seed) >> 11
    return -math.log(-math.log((raw + 0.5) / (1 << 53)))


def score(docs: DataFrame, ratio: np.ndarray, seed: int = 17) -> DataFrame:
    """``doc_id, held_out, n_grams, log_ratio, gumbel_key`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(len(ratio))
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            grams = [hasher(t.as_py()) for t in b.column("text")]
            value = np.array([ratio[g].sum() for g in grams], np.float64)
            noise = np.array([gumbel(i, seed) for i in ids], np.float64)
            held = pa.array([id_bucket(i) == 0 for i in ids], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), held, pa.array([len(g) for g in grams], pa.int64()), pa.array(value), pa.array(value + noise)], ["doc_id", "held_out", "n_grams", "log_ratio", "gumbel_key"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, held_out boolean, n_grams long, log_ratio double, gumbel_key double")


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1000, small: int = 5000) -> float:
    """The exact ``k``-th largest value of a finite double column, k from 1 to the row count."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    left = k
    while low < high:
        inside = rows.filter(F.col(column).between(low, high))
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = {r[0]: r[1:] for r in inside.groupBy(at.alias("at")).agg(F.count("*"), F.min(column), F.max(column)).collect()}
        for b in sorted(found, reverse=True):
            n, b_low, b_high = found[b]
            if left <= n:
                break
            left -= n
        if n <= small:
            kept = inside.filter(F.col(column).between(b_low, b_high)).select(column).collect()
            return sorted((r[0] for r in kept), reverse=True)[left - 1]
        low, high = b_low, b_high
    return low


def importance_resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = 17, max_target: int = 4000) -> DataFrame:
    """Every row with its log ratio and whether the sample holds it.

    The sample has ``fraction`` of the rows (default: the share of good rows among labelled ones);
    rows that share the last key, such as repeats of a row, are selected together. Null and empty
    texts have no n-grams and log ratio 0, very long ones count whole; a null id has a noise of its
    own; an empty table gives no rows; further columns, whatever their names, are not read.
    """
    ratio, share = train(docs, labels, max_target)
    rows = materialize(score(docs, ratio, seed), "quality")
    k = round((share if fraction is None else fraction) * rows.count())
    bound = kth_largest(rows, "gumbel_key", k) if k > 0 else math.inf
    return rows.withColumn("selected", F.col("gumbel_key") >= bound)

"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over hashed word features (the word, and its first four and three bytes,
present or not) that lean towards toxic texts. It is trained in numpy from confirmed toxic texts
and unlabelled ones: with class prior ``p`` the risk is

    p * E_toxic[loss(+)] + max(0, E_unlabelled[loss(-)] - p * E_toxic[loss(-)])

and where the bracket turns negative its gradient is reversed, so the estimate cannot be driven
below zero by overfitting. Training reads a bounded sample of the labelled rows, those of smallest
id hash: ``max_positive`` toxic ones, and ``max_unlabelled`` taken without looking at their label, which
are the unlabelled texts; every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, map_arrow
from .decontam import words_of

BITS = 20
_MASK = (1 << BITS) - 1


def _word_features(word: bytes) -> tuple[int, ...]:
    out = {zlib.crc32(b"w" + word) & _MASK}
    if len(word) >= 3:
        out.add(zlib.crc32(b"3" + word[:3]) & _MASK)
    if len(word) >= 4:
        out.add(zlib.crc32(b"4" + word[:4]) & _MASK)
    return tuple(out)


def text_features(text: str | None) -> np.ndarray:
    return np.array(sorted({f for w in set(words_of(text)) for f in _word_features(w)}), np.int32)


def without_copies(rows: list[np.ndarray], alike: float = 0.6) -> list[np.ndarray]:
    """``rows`` without near copies of earlier ones, which would make chance features look like signs.

    Candidates share a pair of minimum hashes; the share of common features decides.
    """
    mix = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09], np.uint64)
    seen: dict[tuple[int, int, int], list[int]] = {}
    kept: list[np.ndarray] = []
    for row in rows:
        if not len(row):
            keys = [(0, 0, 0)]
        else:
            low = [int((((row.astype(np.uint64) + np.uint64(1)) * m) & np.uint64(0xFFFFFFFF)).min()) for m in mix]
            keys = [(i, low[i], low[i + 1]) for i in range(0, len(low), 2)]
        near = {n for k in keys for n in seen.get(k, ())}
        if any(2 * len(np.intersect1d(row, kept[n], assume_unique=True)) >= 2 * alike / (1 + alike) * (len(row) + len(kept[n])) for n in near):
            continue
        for k in keys:
            seen.setdefault(k, []).append(len(kept))
        kept.append(row)
    return kept


class ToxicityModel:
    """Weights of the kept features and a bias; without positives every margin is very low."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, kept: int = 2048, rounds: int = 400, rate: float = 0.05, decay: float = 1e-3) -> ToxicityModel:
        if not positive or not unlabelled:
            return cls({}, -20.0)
        prior = float(np.clip(prior, 1e-4, 0.9))
        positive, unlabelled = without_copies(positive), without_copies(unlabelled)
        count = lambda rows: np.bincount(np.concatenate([*rows, np.empty(0, np.int32)]), minlength=_MASK + 1)
        in_p, in_u, n_p, n_u = count(positive), count(unlabelled), len(positive), len(unlabelled)
        rate_p, rate_u = (in_p + 0.5) / (n_p + 1), (in_u + 0.5) / (n_u + 1)
        lean = (rate_p - rate_u) / np.sqrt(rate_u * (1 - rate_u) * (1 / n_p + 1 / n_u) + 1e-12)
        lean[(in_p < max(3, 0.01 * n_p)) | (rate_p < 4 * rate_u)] = 0
        chosen = np.argsort(-lean, kind="stable")[:kept]
        chosen = chosen[lean[chosen] > 4]
        slot = np.full(_MASK + 1, -1, np.int32)
        slot[chosen] = np.arange(len(chosen))

        def matrix(rows: list[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(rows), len(chosen) + 1), np.float32)
            out[:, -1] = 1
            for n, r in enumerate(rows):
                at = slot[r]
                out[n, at[at >= 0]] = 1
            return out

        x_p, x_u = matrix(positive), matrix(unlabelled)
        w = np.zeros(len(chosen) + 1, np.float64)
        w[-1] = np.log(prior / (1 - prior))
        m, v = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, rounds + 1):
            s_p, s_u = 1 / (1 + np.exp(-np.clip(x_p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(x_u @ w, -30, 30)))
            risk = -np.log1p(-np.minimum(s_u, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(s_p, 1 - 1e-12)).mean()
            rest = x_u.T @ s_u / n_u - prior * (x_p.T @ s_p) / n_p
            grad = (-prior * (x_p.T @ (1 - s_p)) / n_p + rest if risk >= 0 else -rest) + decay * np.append(w[:-1], 0) / len(w) ** 0.5
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return cls({int(f): float(x) for f, x in zip(chosen, w[:-1], strict=True)}, float(w[-1]))

    def scorer(self):  # noqa: ANN201
        """A function from a text to its score."""
        weights, bias, known = self.weights, self.bias, {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for w in set(words_of(text)):
                hit = known.get(w)
                if hit is None:
                    if len(known) > 300_000:
                        known.clear()
                    hit = known[w] = tuple(f for f in _word_features(w) if f in weights)
                if hit:
                    found.update(hit)
            return float(1 / (1 + np.exp(-np.clip(bias + sum(weights[f] for f in sorted(found)), -30, 30))))

        return score


def _trained(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 0


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 2000, max_unlabelled: int = 6000) -> ToxicityModel:
    """A model from rows whose crc32(doc_id) mod 5 is not 0. ``labels`` has ``doc_id, toxic``.

    Only confirmed toxic rows serve as labelled. The unlabelled sample is drawn from all rows of
    ``labels``, toxic or not, so the class prior, the share of toxic rows among them, is its own.
    Ids that are null or no document's, and null marks, are not read; of several marks of an id the
    highest counts; repeated documents count each; null, empty and very long texts are whole texts;
    without a toxic row, or with empty tables, every score is near 0; further columns are not read.
    """
    marked = labels.filter("doc_id is not null and toxic is not null").filter(_trained("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total, toxic = marked.agg(F.count("*"), F.sum("toxic")).first()
    prior = (toxic or 0) / total if total else 0.0
    pick = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    p = pick(marked.filter("toxic = 1").select("doc_id"), max_positive).withColumn("positive", F.lit(True))
    u = pick(marked.select("doc_id"), max_unlabelled).withColumn("positive", F.lit(False))
    # At most max_positive + max_unlabelled ids: a bounded side.
    rows = docs.select("doc_id", "text").join(F.broadcast(p.unionAll(u)), "doc_id").select("positive", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_features(t).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("positive"), pa.array(found, pa.binary())], ["positive", "features"])

    positive, unlabelled = [], []
    for is_p, raw in map_arrow(rows, run, "positive boolean, features binary").collect():
        (positive if is_p else unlabelled).append(np.frombuffer(raw, np.int32))
    order = lambda rows: sorted(rows, key=lambda r: r.tobytes())  # noqa: E731  the same sum in any arrival order
    return ToxicityModel.fit(order(positive), order(unlabelled), prior)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``held_out``: crc32(doc_id as text) mod 5 is 0 (a null id counts as empty text). Null and empty
    texts have no features and get the score of the bias; repeated rows give repeated rows; an
    empty table gives none; without toxic labels every score is near 0. Further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            ids = b.column("doc_id")
            s = np.array([score(t.as_py()) for t in b.column("text")], np.float64)
            held = pa.array([id_bucket(i) == 0 for i in ids.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([ids, held, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more, with all their columns, whatever their names.

    Null and empty texts have the score of the bias, very long ones are read whole; rows without an
    id and repeated rows are judged like others; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t.as_py()) < 0.5 for t in b.column("text")], pa.bool_()))

    return map_arrow(docs, run, docs.schema)

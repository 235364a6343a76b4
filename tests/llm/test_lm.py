"""The language model against plain loops, finite differences, a smoothed bigram and another partitioning."""

import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from quillon.llm import lm
from quillon.llm.common import materialize
from quillon.llm.tokens import TextEncoder

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 400
ROWS = [(1, "The quick brown fox"), (2, "the QUICK  fox"), (3, None), (4, ""), (5, "  \t\n "), (6, LONG), (8, "a  b\u00a0c \u00e9 \x00"), (8, "a  b\u00a0c \u00e9 \x00"), (None, "no id at all"), (9, "one\ntwo  "), (17, "\x0bThe end")]


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, [b"x"]) for i, t in ROWS], "doc_id long, text string, row int, ids array<binary>")


def _model(seed=1):
    rng = np.random.default_rng(seed)
    features = rng.normal(size=(lm.GROUPS + 2, lm.FEATURES)).astype(np.float32)
    features[lm.PAD] = 0
    prior = np.log(rng.dirichlet(np.ones(lm.CLASSES), lm.GROUPS + 2)).astype(np.float32)
    return lm.AttentionModel(features, rng.normal(0, 0.15, lm.AttentionModel.SIZE)), prior, rng


@pytest.mark.parametrize("stride", [lm.STRIDE, lm.WINDOW])
def test_gradient(stride):
    model, prior, rng = _model()
    many = np.array([5, 70, 33])
    x, goal, _ = lm.windows_of(rng.integers(0, 40, 108), rng.integers(0, lm.CLASSES, 108), many, stride)

    def loss(flat):
        return -float(lm.AttentionModel(model.features, flat).score(x, prior, goal).mean())

    g = model.gradient(x, prior, goal)
    for name_at in np.cumsum([0, *(math.prod(s) for _, s in model.SHAPES)])[:-1]:
        i = name_at + int(np.argmax(np.abs(g[name_at : name_at + 60])))
        up, down = model.flat.copy(), model.flat.copy()
        up[i] += 0.01
        down[i] -= 0.01
        assert (loss(up) - loss(down)) / 0.02 == pytest.approx(g[i], rel=0.05, abs=2e-4)


def _counts(rng, kinds=60):
    ids = np.zeros(lm.VOCAB, np.int64)
    ids[rng.choice(lm.END_ID, kinds, replace=False)] = rng.integers(1, 500, kinds)
    ids[lm.END_ID] = 7
    some = np.flatnonzero(ids)
    pairs = [(g, f, rng.integers(1, 9, len(f))) for g in [*range(30), lm.START] for f in [rng.choice(some, 20, replace=False)]]
    return ids, pairs


def test_probabilities_sum_to_one_and_scores_equal_a_plain_loop():
    model, _, rng = _model(2)
    ids, pairs = _counts(rng)
    counts = lm.Counts(ids, iter(pairs))
    model = lm.AttentionModel(counts.features, model.flat)
    some = np.append(np.flatnonzero(ids), [1, 2, 3])
    texts = [np.append(rng.choice(some, n), lm.END_ID) for n in (0, 1, 31, 32, 33, 200)]

    def spread(text, n):
        """The probability of every id after the first ``n`` of a text."""
        block = n // lm.STRIDE
        inputs = [lm.START, *counts.group[text[:n]].tolist()]  # place i is predicted from inputs[0..i]
        seen = inputs[max(0, (block - 1) * lm.STRIDE) :]
        q, k = model.features[seen[-1]] @ model.p["q"], model.features[seen] @ model.p["k"]
        weight = np.exp(k @ q + model.p["distance"][np.arange(len(seen))[::-1]])
        mixed = weight @ (model.features[seen] @ model.p["v"]) / weight.sum()
        z = mixed @ model.p["out"] + model.p["bias"] + counts.prior[seen[-1]]
        z = np.exp(z - z.max())
        z /= z.sum()
        return z[counts.class_of] * 10.0 ** counts.inner[seen[-1], counts.rank]

    want = []
    for t in texts:
        total = 0.0
        for n in range(len(t)):
            p = spread(t, n)
            assert p.sum() == pytest.approx(1, abs=2e-3)
            total += math.log10(p[t[n]])
        want.append(total)
    got = lm.score_ids(model, counts, np.concatenate(texts), np.array(list(map(len, texts))))
    assert np.allclose(got, want, atol=2e-3, rtol=1e-4)


def test_attention_sees_far_back_but_never_ahead():
    model, prior, rng = _model(3)
    g = rng.integers(0, 40, 100)
    x, goal, place = lm.windows_of(g, np.zeros(100, int), np.array([100]))
    assert sorted(place.tolist()) == list(range(100)) and (goal >= 0).sum() == 100
    for change, first in ((20, 21), (60, 61)):
        other = g.copy()
        other[change] = 41
        a, b = (model.score(lm.windows_of(s, np.zeros(100, int), np.array([100]))[0], prior, goal) for s in (g, other))
        moved = np.flatnonzero(np.abs(a - b) > 1e-9)
        assert moved.min() == first and moved.max() >= min(99, change + 30)


def test_base_score_against_brute_force(spark, docs):
    rows = lm.score_documents(docs, head=2).collect()
    c = Counter(w for i, t in ROWS if not held(i) for w in [*words(t), ""])
    total = sum(c.values())
    want = Counter((i, held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), ""]), total, round(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (len(c) + 1))) for w in [*words(t), ""]), 6)) for i, t in ROWS)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows) and len({round(r["score"], 4) for r in rows if r["doc_id"] == 8}) == 1
    assert lm.score_documents(docs.limit(0)).count() == 0
    only_held = lm.score_documents(spark.createDataFrame([(i, "word " * 3) for i in range(99) if held(i)], "doc_id long, text string")).collect()
    assert len(only_held) > 5 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in only_held)


def test_counts_against_brute_force(spark, docs):
    wide = ["def f(x):\n        return  x\n\n    # end", "a   b    c\n  d", "   ", "one two\nthree four", " lead and trail ", "tab\t \tgap", ""]
    rows = docs.select("doc_id", "text").unionAll(spark.createDataFrame([(100 + i, t) for i, t in enumerate(wide * 3)], "doc_id long, text string")).collect()
    made = materialize(lm.tokenized(spark.createDataFrame(rows, "doc_id long, text string")), "t")
    one, ids, found, pairs = TextEncoder(lm.TOKENIZER).one, Counter(), Counter(), Counter()
    for i, t in rows:
        if not held(i):
            seq = [*one(t or "").tolist(), lm.END_ID]
            ids.update(seq)
            found.update([*(w.encode() for w in words(t)), b""])
            pairs.update(zip([None, *seq], seq, strict=False))
    got = lm.training_counts(made).collect()
    assert {int.from_bytes(r["token"], "little"): r["c"] for r in got if r["kind"] == 2} == dict(ids)
    assert {bytes(r["token"]): r["c"] for r in got if r["kind"] == 1} == dict(found)
    array = np.zeros(lm.VOCAB, np.int64)
    array[list(ids)] = list(ids.values())
    _, group = lm.ranked(array)
    want = Counter()
    for (a, b), n in pairs.items():
        want[lm.START if a is None else int(group[a]), b] += n
    assert {(r["g"], c["id"]): c["n"] for r in lm.count_pairs(made, array).collect() for c in r["following"]} == dict(want)


def test_learns_all_rows_whatever_the_partitions(spark):
    """Held-out ids cost fewer bits than under a smoothed bigram, and scores do not hang on the partitioning."""
    rng = random.Random(6)
    kinds = [[f"{a}{b}" for a in "bdfgklmnprst" for b in v] for v in ("ae", "io", "uy")]
    texts = [(i, " ".join("".join(rng.choice(kinds[i % 3]) for _ in range(rng.randint(1, 3))) for _ in range(60))) for i in range(900)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    one = {r["doc_id"]: r for r in lm.score_documents(frame.repartition(2), shard=10_000).collect()}
    two = {r["doc_id"]: r["score"] for r in lm.score_documents(frame.repartition(7, "text"), shard=10_000).collect()}
    assert all(r["score"] == pytest.approx(two[i], rel=1e-3) for i, r in one.items())
    encode, c, uni, last = TextEncoder(lm.TOKENIZER).one, Counter(), Counter(), Counter()
    seqs = {i: [-1, *encode(t).tolist(), lm.END_ID] for i, t in texts}
    for i, s in seqs.items():
        if not held(i):
            c.update(zip(s, s[1:], strict=False))
            uni.update(s[1:])
            last.update(s[:-1])
    after = Counter(a for a, _ in c)
    total = sum(uni.values())
    mine = base = 0.0
    for i, s in seqs.items():
        if held(i):
            mine -= one[i]["score"]
            base -= sum(math.log10(max(c[a, b] - 0.75, 0) / max(last[a], 1) + (0.75 * after[a] / last[a] if last[a] else 1) * (uni[b] + 0.5) / (total + 0.5 * lm.VOCAB)) for a, b in zip(s, s[1:], strict=False))
    assert mine < 0.98 * base


def _seconds(run):
    """CPU seconds of the quickest of some runs."""
    times = []
    for _ in range(20):
        began = time.process_time()
        run()
        times.append(time.process_time() - began)
    return min(times)


@pytest.mark.parametrize(("size", "stride"), [(0.15, lm.WINDOW), (0.15, lm.STRIDE), (0.8, lm.WINDOW), (3.0, lm.WINDOW)])
def test_whole_gradient_against_a_plain_formula(size, stride):
    """All weights' gradients, also over more than one part, with odds and weights beyond their bounds."""
    model, prior, rng = _model(4)
    model = lm.AttentionModel(model.features, model.flat * np.float32(size / 0.15))
    many = rng.integers(1, 90, 70)
    x, goal, _ = lm.windows_of(rng.integers(0, 40, many.sum()), rng.integers(0, lm.CLASSES, many.sum()), many, stride)
    assert len(x) > lm.PART
    p, f, first = {n: w.astype(float) for n, w in model.p.items()}, model.features.astype(float)[x], x.shape[1] - goal.shape[1]
    q, k, v, gap = f[:, first:] @ p["q"], f @ p["k"], f @ p["v"], np.arange(first, x.shape[1])[:, None] - np.arange(x.shape[1])
    raw = q @ k.transpose(0, 2, 1) + p["distance"][np.maximum(gap, 0)]
    e = np.where((gap < 0) | (x == lm.PAD)[:, None], 0, np.exp(np.minimum(raw, 60)))
    total = e.sum(2, keepdims=True) + 1e-30
    mixed = e @ v / total
    z = mixed @ p["out"] + p["bias"] + prior[x[:, first:]]
    z = np.clip(z, -80, 80) if model.steep else z
    z = np.exp(z - z.max(2, keepdims=True))
    z /= z.sum(2, keepdims=True)
    z -= np.eye(lm.CLASSES + 1)[goal][:, :, :-1]
    z *= (goal >= 0)[:, :, None] / (goal >= 0).sum()
    d_u = z @ p["out"].T / total
    d_s = e * (d_u @ v.transpose(0, 2, 1) - (d_u * mixed).sum(2, keepdims=True) * (x != lm.PAD)[:, None])
    want = {
        "q": np.einsum("bif,biw->fw", f[:, first:], d_s @ k), "k": np.einsum("bjf,bjw->fw", f, d_s.transpose(0, 2, 1) @ q), "v": np.einsum("bjf,bjw->fw", f, e.transpose(0, 2, 1) @ d_u),
        "distance": [d_s[:, gap == t].sum() for t in range(lm.WINDOW)], "out": np.einsum("biw,bic->wc", mixed, z), "bias": z.sum((0, 1)),
    }
    got, at = model.gradient(x, prior, goal), 0
    for name, shape in model.SHAPES:
        part, wanted = got[at : at + math.prod(shape)].reshape(shape), np.array(want[name])
        at += math.prod(shape)
        assert np.isfinite(part).all() and np.allclose(part, wanted, rtol=1e-2, atol=2e-3 * max(np.abs(wanted).max(), 1e-6)), name


def test_steps_stay_in_the_cache_and_counts_cost_little():
    """a step of descent once held over 6 MB at a time, a pair's count cost over 20 times a plain count."""
    model, prior, rng = _model(5)
    x, goal = rng.integers(0, 1000, (lm.STEP, lm.WINDOW)).astype(np.int16), rng.integers(0, lm.CLASSES, (lm.STEP, lm.WINDOW)).astype(np.int16)
    tracemalloc.start()
    model.gradient(x, prior, goal)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5.5e6
    ids = rng.integers(0, 3000, 1_000_000)
    found, group, rank = np.zeros((lm.GROUPS + 2) * 3000, np.int32), np.minimum(np.arange(3000), lm.GROUPS - 1).astype(np.int16), np.arange(3000)
    cells = group[ids].astype(np.int64) * 3000 + ids
    assert _seconds(lambda: lm._add_pairs(found, ids, np.array([len(ids)]), group, rank, 3000)) < 15 * _seconds(lambda: np.bincount(cells, minlength=len(found)))


def test_no_pass_to_sample_and_no_sorted_words(spark, docs, monkeypatch):
    """training read the ids twice a round, and all rare words were sorted for their counts."""
    monkeypatch.setattr(type(docs), "repartitionByRange", lambda *_: pytest.fail("the table is sampled"))
    plan = lm.score_documents(docs, head=2)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [word" in plan and "SortMergeJoin [word" not in plan


def test_a_step_holds_half_as_much():
    """Second round: a step of descent held over 5 MB at a time, more than a processor's own cache."""
    model, prior, rng = _model(6)
    x, goal = rng.integers(0, 1000, (lm.STEP, lm.WINDOW)).astype(np.int16), rng.integers(0, lm.CLASSES, (lm.STEP, lm.WINDOW)).astype(np.int16)
    tracemalloc.start()
    model.gradient(x, prior, goal)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3.2e6


def test_padding_weighs_nothing_beside_the_smallest_weights():
    model, prior, rng = _model(7)
    model.p["distance"][:] = np.where(np.arange(lm.WINDOW) < 20, -95, 55)  # padding is far back
    model.refresh()
    x, goal, _ = lm.windows_of(rng.integers(0, 40, 10), rng.integers(0, lm.CLASSES, 10), np.array([10]))
    mixed = model.attend(model.q[x[:, lm.STRIDE :]], model.kv[x])[1]
    assert np.isfinite(mixed).all() and np.abs(mixed[0, 0]).max() < 1e-6 and np.isfinite(model.score(x, prior, goal)).all() and np.isfinite(model.gradient(x, prior, goal)).all()

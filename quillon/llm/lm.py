"""Language-model scoring with a causal self-attention model over subword ids.

A text's score is the log10 probability of all its subword ids and of its end. Given the ids before,

    p(id) = p(class of id | window) * p(id | class, group of the last id)

* Counts over all training rows (crc32(doc_id) mod 5 is not 1) give the discounted probability of
  each id after each group of last ids; the ``GROUPS - 1`` most frequent ids are groups of their own.
* Ids fall into classes, and groups get their features, by the company they keep in these counts.
* A self-attention layer over the window's groups shifts the classes' log odds away from what the
  last id alone says. Without its shift the model is the counted one.
* The attention's weights are trained in numpy on every training row, once: rows are dealt by a hash
  of their ids into logical shards of about ``SHARD`` ids, so the result does not depend on how the
  table is partitioned. Shards descend from common weights; their results are averaged by the ids
  they saw, in ``ROUNDS`` rounds of different shards.
* Scoring cuts a text's ids into windows of ``WINDOW`` that overlap by half; the ids in a window's
  second half are scored, each once, with the whole window before them as context.

Beside it stands the base score, unigrams of words. Frequent words (``HEAD``, a bounded table) are
looked up in the task; all others are joined with the full table of counts. Every text is tokenized
once; its ids are kept in the shared folder until the result is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ann import _unit as unit
from .ann import kmeans
from .common import BATCH_ROWS, id_bucket, map_arrow, materialize
from .tokens import TOGETHER, TextEncoder, together, vocabulary

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: Ids of the vocabulary, the end's among them; all fit into 16 bits.
VOCAB, END_ID = 50_257, 50_256
GROUPS, CLASSES, FEATURES, WIDTH = 1024, 64, 64, 32
WINDOW, STRIDE = 64, 32
PAD, START = GROUPS, GROUPS + 1
DISCOUNT = 0.75
SHARD, ROUNDS = 4_000_000, 3
HEAD = 65_536
#: Distinct words whose counts a task of the join holds, about.
PART_WORDS = 250_000
#: Windows of one step of descent.
STEP = 64
#: Windows whose gradients are worked out together, and windows scored together: what they need stays in the processor's cache.
PART, SCORED = 16, 32
ONES = np.ones(CLASSES, np.float32)


# --- the model ---------------------------------------------------------------------------------


class AttentionModel:
    """One causal self-attention layer over groups of ids that shifts the log odds of classes.

    The groups' ``features`` are given, not learned: they come from the counts.
    """

    SHAPES = (("q", (FEATURES, WIDTH)), ("k", (FEATURES, WIDTH)), ("v", (FEATURES, WIDTH)), ("distance", (WINDOW,)), ("out", (WIDTH, CLASSES)), ("bias", (CLASSES,)))
    SIZE = sum(math.prod(s) for _, s in SHAPES)

    def __init__(self, features: np.ndarray, flat: np.ndarray | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.features = features
        self.flat = (rng.normal(0, FEATURES**-0.5, self.SIZE) if flat is None else flat).astype(np.float32)
        self.p, at = {}, 0
        for name, shape in self.SHAPES:
            self.p[name] = self.flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        if flat is None:
            self.p["distance"][:] = -0.05 * np.arange(WINDOW)
            self.p["out"] *= 0.1
            self.p["bias"][:] = 0
        #: Keys, and values beside a one, of every group; padding has the value and the one of nothing.
        self.kv = np.ones((GROUPS + 2, 2 * WIDTH + 1), np.float32)
        self.kv[PAD, 2 * WIDTH] = 0
        ahead = np.arange(WINDOW)[None, :] - np.arange(WINDOW)[:, None]  # from a key to a query
        self.gap, self.spread = np.maximum(ahead, 0), ahead + WINDOW - 1
        self.refresh()

    def refresh(self) -> None:
        """What follows from the weights for every group and distance."""
        p = self.p
        self.q = self.features @ p["q"]
        self.kv[:, : 2 * WIDTH] = self.features @ np.concatenate((p["k"], p["v"]), 1)
        self.of = self.biased = None
        self.shift = np.concatenate((np.full(WINDOW - 1, -1e9, np.float32), p["distance"])).take(self.spread)  # a key that is ahead has no weight
        v = self.kv[:, WIDTH : 2 * WIDTH]
        # By the largest number of all values, else by the largest norm of a group's.
        self.steep = not max(v.max(), -v.min()) * np.abs(p["out"]).sum(0).max() + p["bias"].max() <= 60
        if self.steep:
            self.steep = not math.sqrt(np.einsum("ij,ij->i", v, v).max() * (p["out"] ** 2).sum(0).max()) + p["bias"].max() <= 60

    def attend(self, q: np.ndarray, kv: np.ndarray) -> tuple:
        """Weights (of keys for queries; a query's sum to one, beside those of padding, whose value is
        nothing) and mixtures of the windows' last places, given their queries and the keys and values
        of all places.

        Here and below no second factor is transposed and products are by window: so they are
        small, and the library multiplies them in place.
        """
        first, places = kv.shape[1] - q.shape[1], kv.shape[1]
        e = kv[:, :, :WIDTH] @ np.ascontiguousarray(q.transpose(0, 2, 1))
        e += self.shift[:places, first:places]
        if not e.max(initial=0) <= 60:  # else no exponential can overflow
            np.minimum(e, np.float32(60), out=e)
        np.exp(e, out=e)
        total = kv[:, :, 2 * WIDTH :].transpose(0, 2, 1) @ e + np.float32(1e-30)
        if not total.min(initial=1) >= 1e-12:  # else padding's weights cannot overflow
            e *= kv[:, :, 2 * WIDTH :]
        e *= 1 / total
        return e, e.transpose(0, 2, 1) @ kv[:, :, WIDTH : 2 * WIDTH]

    def _odds(self, mixed: np.ndarray, prior: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The classes' log odds, a row for each place."""
        if self.of is not prior:
            self.of, self.biased = prior, prior + self.p["bias"]
        z = (mixed @ self.p["out"]).reshape(-1, CLASSES)
        z += self.biased.take(last.reshape(-1), 0)
        return np.clip(z, -80, 80, out=z) if self.steep else z

    def score(self, x: np.ndarray, prior: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Natural log probability of each class in ``goal`` (-1 none) after the windows' last places."""
        x = x.astype(np.intp)
        last = x[:, x.shape[1] - goal.shape[1] :]
        mixed = self.attend(self.q.take(last, 0), self.kv.take(x, 0))[1]
        at, goal = np.flatnonzero(goal.reshape(-1) >= 0), goal.reshape(-1)
        goal = goal[at]
        if len(at) < 0.75 * last.size:  # else it is cheaper to leave the few others in
            mixed, last, at = mixed.reshape(-1, WIDTH)[at], last.reshape(-1)[at], np.arange(len(at))
        z = self._odds(mixed, prior, last)
        value = z[at, goal].astype(np.float64)
        np.exp(z, out=z)
        return value - np.log(z @ ONES)[at]

    def gradient(self, x: np.ndarray, prior: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Gradient of the mean loss over the classes in ``goal`` (-1 none), in the layout of ``flat``."""
        share = np.float32(1 / max(1, int((goal >= 0).sum())))
        flat, g, at = np.zeros(self.SIZE, np.float32), {}, 0
        for name, shape in self.SHAPES:
            g[name] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        met = np.zeros((x.shape[1], goal.shape[1]), np.float32)  # by key and query
        x = x.astype(np.intp)
        for at in range(0, len(x), PART):
            self._gradient(x[at : at + PART], prior, goal[at : at + PART], share, g, met)
        g["distance"][:] = np.bincount(self.gap[: len(met), x.shape[1] - goal.shape[1] : x.shape[1]].ravel(), met.ravel(), WINDOW)  # of keys ahead 0
        return flat

    def _gradient(self, x: np.ndarray, prior: np.ndarray, goal: np.ndarray, share: np.float32, g: dict[str, np.ndarray], met: np.ndarray) -> None:
        """Add the gradient of the loss times ``share``, summed over the classes in ``goal``, to ``g``;
        that of the distances to ``met``, by key and query."""
        first, places = x.shape[1] - goal.shape[1], x.shape[1]
        q, kv = self.q.take(x[:, first:], 0), self.kv.take(x, 0)
        mixed, seen = np.empty(q.shape, np.float32), []
        for low in range(first, places, STRIDE):  # no place sees a later one, so the first need not meet the last
            high = min(low + STRIDE, places)
            mine = slice(low - first, high - first)
            e, mixed[:, mine] = self.attend(q[:, mine], kv[:, :high])
            seen.append((e, mine, low, high))
        # The classes: ``z`` becomes the odds' gradient.
        z, hit = self._odds(mixed, prior, x[:, first:]), goal.reshape(-1)
        np.exp(z, out=z)
        sums = z @ ONES
        if self.steep:
            z /= sums[:, None]
            sums[:] = 1
        scale = share / sums
        if hit.min(initial=0) < 0:
            at = np.flatnonzero(hit >= 0)
            scale[hit < 0] = 0
            z *= scale[:, None]
            z.reshape(-1)[at * CLASSES + hit[at]] -= share
        else:
            z *= scale[:, None]
            z.reshape(-1)[np.arange(0, z.size, CLASSES) + hit] -= share
        g["bias"] += np.ones(len(z), np.float32) @ z
        z = z.reshape(len(x), -1, CLASSES)
        g["out"] += (mixed.transpose(0, 2, 1) @ z).sum(0)
        d_u = z @ np.ascontiguousarray(self.p["out"].T)
        d_total = -((d_u * mixed).reshape(-1, WIDTH) @ ONES[:WIDTH]).reshape(goal.shape)
        # The attention: gradients of each place's query, key and value.
        d_q, d_k = np.empty(q.shape, np.float32), None
        for e, mine, low, high in seen[::-1]:  # first the last places, which meet all
            turned = np.empty((len(x), WIDTH + 1, high - low), np.float32)
            turned[:, :WIDTH], turned[:, WIDTH] = d_u[:, mine].transpose(0, 2, 1), d_total[:, mine]
            d_s = kv[:, :high, WIDTH:] @ turned
            d_s *= e
            np.matmul(d_s.transpose(0, 2, 1), kv[:, :high, :WIDTH], out=d_q[:, mine])
            if d_k is None:
                d_k, d_v = d_s @ q[:, mine], e @ d_u[:, mine]
            else:
                d_k[:, :high] += d_s @ q[:, mine]
                d_v[:, :high] += e @ d_u[:, mine]
            met[:high, mine] += d_s.sum(0)
        rows = self.features.take(x, 0).transpose(0, 2, 1)  # of padding 0
        for name, d in (("q", rows[:, :, first:] @ d_q), ("k", rows @ d_k), ("v", rows @ d_v)):
            g[name] += d.sum(0)

    def descend(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], prior: np.ndarray, rate: float = 0.005) -> int:
        """Adam steps over batches of windows and goals; the number of goals seen."""
        m, v, seen = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        for t, (x, goal) in enumerate(batches, 1):
            g = self.gradient(x, prior, goal)
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            self.flat -= np.float32(rate / (1 - 0.9**t)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-8))
            self.refresh()
            seen += int((goal >= 0).sum())
        return seen


def windows_of(groups: np.ndarray, classes: np.ndarray, many: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts' groups, the classes to predict in their last ``stride`` places (-1 none),
    and each id's place among these. ``many`` ids of each text follow one another, its end the last.
    No window spans two texts: a text starts after padding, if windows overlap."""
    before = WINDOW - stride  # places of a window that only give context
    blocks = -(-many // stride)
    rows = blocks + bool(before)
    flat = np.full(int(rows.sum()) * stride + 1, PAD, np.int16)
    goal = np.full((int(blocks.sum()), stride), -1, np.int16)
    start, first, ends = np.cumsum(rows) - blocks, np.cumsum(blocks) - blocks, np.cumsum(many)
    place = np.repeat(first * stride - (ends - many), many)
    place += np.arange(len(place))
    goal.reshape(-1)[place] = classes
    after = place + np.repeat((start - first) * stride + 1, many) if before else place + 1
    flat[after] = groups
    flat[after[ends - 1]] = PAD  # the end precedes nothing
    flat[start * stride] = START
    x = flat[:-1].reshape(-1, stride)
    if not before:
        return x, goal, place
    head = np.repeat(start, blocks) + np.arange(len(goal)) - np.repeat(first, blocks)
    return np.concatenate((x[head - 1], x[head]), 1), goal, place


# --- what is counted ---------------------------------------------------------------------------


class Counts:
    """The counted side of the model: groups, classes and probabilities of ids."""

    def __init__(self, ids: np.ndarray, pairs: Iterator[tuple[int, np.ndarray, np.ndarray]]):
        """``ids``: how often each occurs; ``pairs``: for a group, the ids that follow it and how often."""
        self.order, self.group = ranked(ids)
        self.used = max(1, int((ids > 0).sum()))  # columns of the tables, by rank; the last stands for all unseen ids
        self.rank = np.minimum(np.argsort(self.order), self.used).astype(np.int32)
        share = (ids + 0.5) / (ids.sum() + 0.5 * VOCAB)
        base = share[self.order][: self.used]
        rest = 1 - base.sum()
        table = np.zeros((GROUPS + 2, self.used), np.float32)
        for g, following, n in pairs:
            table[g, self.rank[following]] = n
        self.classes = id_classes(table)
        self.features = group_features(table)
        total = table.sum(1, keepdims=True, dtype=np.float64)
        kinds = (table > 0).sum(1, keepdims=True)
        back = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1)
        members = np.append(self.classes, CLASSES - 1)[None, :] == np.arange(CLASSES)[:, None]
        self.prior = np.empty((GROUPS + 2, CLASSES), np.float32)
        self.inner = np.empty((GROUPS + 2, self.used + 1), np.float32)
        for g in range(GROUPS + 2):
            p = np.append(np.maximum(table[g] - DISCOUNT, 0) / max(total[g, 0], 1) + back[g] * base, back[g] * rest)
            p = np.maximum(p, 1e-30)
            kept = np.maximum(members @ p, 1e-30)
            self.prior[g] = np.log(kept)
            p /= kept[np.append(self.classes, CLASSES - 1)]
            p[-1] /= max(1, VOCAB - self.used)  # one of the unseen ids
            self.inner[g] = np.log10(np.maximum(p, 1e-38))
        self.class_of = np.append(self.classes, CLASSES - 1)[self.rank].astype(np.int16)


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids by falling frequency, and each id's group."""
    order = np.lexsort((np.arange(VOCAB), -ids))
    group = np.full(VOCAB, GROUPS - 1, np.int16)
    group[order[: GROUPS - 1]] = np.arange(GROUPS - 1)
    return order, group


def id_classes(table: np.ndarray) -> np.ndarray:
    """The class of each column of ``table`` (how often ids follow groups): a cluster of the like.

    Columns are compared by the square roots of their shares, projected to fewer dimensions at
    random; all columns are placed by the centres.
    """
    total = np.maximum(table.sum(0), 1e-9)
    project = np.random.default_rng(7).normal(size=(len(table), 48)).astype(np.float32)
    x = np.sqrt(table / total).T @ project
    x[np.abs(x).sum(1) == 0] = 1
    x = unit(x - x.mean(0) + 1e-9)
    centre = kmeans(x[: 64 * CLASSES], CLASSES)
    return np.argmax(x @ centre.T, 1).astype(np.int16)


def group_features(table: np.ndarray) -> np.ndarray:
    """What the attention sees of each group: the company it keeps, projected at random, and random
    numbers of its own; padding has none."""
    rng = np.random.default_rng(13)
    after = np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1))
    before = np.zeros((GROUPS + 2, GROUPS), np.float32)  # the groups before each group that is one id
    n = min(GROUPS - 1, table.shape[1])
    before[:n] = table[:GROUPS, :n].T
    before = np.sqrt(before / np.maximum(before.sum(1, keepdims=True), 1))
    half = FEATURES // 4
    parts = [after @ rng.normal(size=(table.shape[1], half)), before @ rng.normal(size=(GROUPS, half)), rng.normal(size=(GROUPS + 2, FEATURES - 2 * half))]
    parts = [(x - x.mean(0)) * x.any(1, keepdims=True) for x in parts]  # none of groups without counts
    out = np.concatenate([x * math.sqrt(x.shape[1]) / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9) for x in parts], 1).astype(np.float32)
    out[PAD] = 0
    return out


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[0x09 : 0x0D + 1] = 0x20


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts (A-Z lower-cased), the number of each occurrence's word and of its text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _FOLD[np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and len(texts) else np.empty(0, np.uint8)
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]) if len(texts) else np.zeros(1, np.int64)), pa.py_buffer(data))
    split = pc.split_pattern(folded, " ")
    flat = split.flatten()
    owner = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    found = flat.dictionary_encode()
    words, code = found.dictionary, found.indices.to_numpy().astype(np.int64)
    nothing = pc.index(words, "").as_py()
    if nothing < 0:
        return words, code, owner
    real = code != nothing
    code, owner = code[real], owner[real]
    code -= code > nothing
    return pa.concat_arrays([words[:nothing], words[nothing + 1 :]]), code, owner


def _held(doc_id: int | None) -> bool:
    return id_bucket(doc_id) == 1


class _Sums:
    """Counts by word, merged now and then."""

    def __init__(self):
        self.parts: list[pa.Table] = []

    def add(self, words: pa.Array, n: np.ndarray) -> None:
        self.parts.append(pa.table({"token": words.cast(pa.large_binary()), "c": n}))
        if sum(map(len, self.parts)) > 1_500_000:
            self.parts = [self.merged()]

    def merged(self) -> pa.Table:
        if not self.parts:
            return pa.table({"token": pa.array([], pa.large_binary()), "c": pa.array([], pa.int64())})
        every = pa.concat_tables(self.parts)
        tokens = every.column("token").combine_chunks().dictionary_encode()
        sums = np.bincount(tokens.indices.to_numpy(), every.column("c").to_numpy(), len(tokens.dictionary))  # exact to 2**53
        return pa.table({"token": tokens.dictionary, "c": sums.astype(np.int64)})


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Each text with its ids (little-endian 16-bit numbers, without the end), and the counts of its task.

    ``kind`` 0: ``row, doc_id, held, text, ids``; 1: a training word (the end as the empty word) as
    ``token`` and its count ``c``; 2: a training id, likewise, as 4 little-endian bytes.
    """
    table = vocabulary(tokenizer)
    if table is None or max(table.values()) >= END_ID:
        raise ValueError(f"{tokenizer} is no vocabulary of ranks below {END_ID}")
    names = ["kind", "row", "doc_id", "held", "text", "ids", "token", "c"]
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.binary(), pa.int64()]

    def batch(kind: int, size: int, **given: pa.Array) -> pa.RecordBatch:
        cols = [given[n].cast(k) if n in given else pa.nulls(size, k) for n, k in zip(names[1:], kinds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int8)), *cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        encoder, ids, words = TextEncoder(tokenizer), np.zeros(VOCAB, np.int64), _Sums()
        for b in together(batches):
            held = np.array([_held(d) for d in b.column("doc_id").to_pylist()], bool)
            found, many = encoder(b.column("text"))
            ids += np.bincount(found[np.repeat(~held, many)], minlength=VOCAB)
            ids[END_ID] += int((~held).sum())
            distinct, code, owner = words_of(b.column("text"))
            n = np.bincount(code[~held[owner]], minlength=len(distinct))
            words.add(distinct.filter(pa.array(n > 0)), n[n > 0])
            cut = np.concatenate(([0], np.cumsum(many))) * 2
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(cut), pa.py_buffer(found.astype("<u2"))])
            for at in range(0, b.num_rows, BATCH_ROWS):
                size = min(BATCH_ROWS, b.num_rows - at)
                yield batch(0, size, row=pa.array(np.arange(row, row + size)), doc_id=b.column("doc_id").slice(at, size), held=pa.array(held[at : at + size]), text=b.column("text").slice(at, size), ids=raw.slice(at, size))
                row += size
        merged = words.merged()
        for at in range(0, len(merged), 50_000):
            part = merged.slice(at, 50_000).combine_chunks()
            yield batch(1, len(part), token=part.column("token").combine_chunks(), c=part.column("c").combine_chunks())
        yield batch(1, 1, token=pa.array([b""], pa.binary()), c=pa.array([int(ids[END_ID])]))
        at = np.flatnonzero(ids)
        yield batch(2, len(at), token=pa.array([int(i).to_bytes(4, "little") for i in at], pa.binary()), c=pa.array(ids[at]))

    return map_arrow(docs, run, "kind byte, row long, doc_id long, held boolean, text string, ids binary, token binary, c long")


def training_counts(made: DataFrame) -> DataFrame:
    """``kind, token, c`` over all training rows of :func:`tokenized`."""
    return made.filter("kind > 0").groupBy("kind", "token").agg(F.sum("c").alias("c")).filter("c > 0")


def _flat_ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with their ends, and how many each text has."""
    raw = column.cast(pa.large_binary())
    cut = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    many = np.diff(cut) // 2
    held = np.frombuffer(raw.buffers()[2], np.uint8)[cut[0] : cut[-1]].view("<u2") if raw.buffers()[2] is not None else np.empty(0, "<u2")
    ends = np.cumsum(many + 1) - 1
    out = np.empty(int((many + 1).sum()), np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = held, END_ID
    return out, many + 1


def _add_pairs(found: np.ndarray, flat: np.ndarray, many: np.ndarray, group: np.ndarray, rank: np.ndarray, used: int) -> None:
    """Count the texts' ids by the group before and their own rank, in a table of ``used`` ranks."""
    before = np.empty(len(flat), np.int64)
    before[1:] = group[flat[:-1]]
    before[np.cumsum(many) - many] = START
    np.add.at(found, before * used + rank[flat], np.int32(1))  # a number of another type takes 30 times as long


def count_pairs(made: DataFrame, ids: np.ndarray) -> DataFrame:
    """``g, following``: for each group that occurs, the ids that follow it in training rows, with
    their numbers (``id, n``). At most ``GROUPS + 1`` rows of ``VOCAB`` entries."""
    order, group = ranked(ids)
    rank, used = np.argsort(order), max(1, int((ids > 0).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((GROUPS + 2) * used, np.int32)  # touched where ids occur; at most 206 MB
        for b in batches:
            if b.num_rows:
                flat, many = _flat_ids(b.column("ids"))
                _add_pairs(found, flat, many, group, rank, used)
        at = np.flatnonzero(found)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array((part // used).astype(np.int32)), pa.array(order[part % used].astype(np.int32)), pa.array(found[part].astype(np.int64))], ["g", "id", "n"])

    cells = map_arrow(made.filter("kind = 0 and not held").select("ids"), run, "g int, id int, n long")
    return cells.groupBy("g", "id").agg(F.sum("n").alias("n")).groupBy("g").agg(F.collect_list(F.struct("id", "n")).alias("following"))


# --- training ----------------------------------------------------------------------------------


def _batches(texts: Iterator[tuple[np.ndarray, np.ndarray]], counts: Counts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and goals of the texts, ``STEP`` at a time."""
    x_wait, goal_wait = np.empty((0, WINDOW), np.int16), np.empty((0, WINDOW), np.int16)
    for ids, many in texts:
        x, goal, _ = windows_of(counts.group[ids], counts.class_of[ids], many, WINDOW)
        x, goal = np.concatenate((x_wait, x)), np.concatenate((goal_wait, goal))
        full = len(x) - len(x) % STEP
        for at in range(0, full, STEP):
            yield x[at : at + STEP], goal[at : at + STEP]
        x_wait, goal_wait = x[full:], goal[full:]
    if len(x_wait):
        yield x_wait, goal_wait


def train(made: DataFrame, counts: Counts, total: int, shard: int = SHARD, rounds: int = ROUNDS) -> AttentionModel:
    """The attention model, descended over all training rows of :func:`tokenized`.

    ``total``: their ids. There are as many logical shards as give each about ``shard`` ids; what
    goes to the driver are the sums of all shards' weights, one row for each weight.
    """
    spark = made.sparkSession
    shards = rounds * max(1, -(-total // (shard * rounds)))
    rows = made.filter("kind = 0 and not held").select(F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("shard"), F.coalesce("doc_id", F.lit(0)).alias("d"), "ids")
    model, held = AttentionModel(counts.features), spark.sparkContext.broadcast(counts)
    for turn in range(rounds):
        flat = model.flat.copy()

        def descend(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat) -> Iterator[pa.RecordBatch]:
            counts, sums, seen = held.value, np.zeros(AttentionModel.SIZE), 0
            for texts in _by_shard(batches):
                mine = AttentionModel(counts.features, flat.copy())
                n = mine.descend(_batches(texts, counts), counts.prior)
                sums += n * mine.flat.astype(np.float64)
                seen += n
            if seen:
                for at in range(0, len(sums) + 1, 20_000):
                    part = np.append(sums, seen)[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part)], ["at", "total"])

        # a shard to a task, known without a pass that samples the rows
        dealt = rows.filter(F.col("shard") % rounds == turn).repartitionById(shards // rounds, ((F.col("shard") - turn) / rounds).cast("int"))
        dealt = dealt.sortWithinPartitions("shard", "d", F.xxhash64("ids"))
        found = map_arrow(dealt.select("shard", "ids"), descend, "at long, total double").groupBy("at").agg(F.sum("total").alias("total"))
        sums = np.zeros(AttentionModel.SIZE + 1)
        for at, value in found.collect():  # one row for each weight
            sums[at] = value
        if sums[-1]:
            model = AttentionModel(counts.features, sums[:-1] / sums[-1])
    return model


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[np.ndarray, np.ndarray]]]:
    """For each run of rows of one shard, the ids of its batches; rows come sorted by shard."""
    parts = (b.slice(int(i), int(j - i)) for b in batches if b.num_rows for cut in [_runs(b.column("shard").to_numpy())] for i, j in zip(cut[:-1], cut[1:], strict=True))
    waiting: list[pa.RecordBatch] = []

    def texts(shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while waiting and waiting[0].column("shard")[0].as_py() == shard:
            yield _flat_ids(waiting.pop().column("ids"))
            waiting.extend(x for x in [next(parts, None)] if x is not None)

    waiting.extend(x for x in [next(parts, None)] if x is not None)
    while waiting:
        yield texts(waiting[0].column("shard")[0].as_py())


def _runs(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(np.diff(values)) + 1, [len(values)]))


# --- scoring -----------------------------------------------------------------------------------


def score_ids(model: AttentionModel, counts: Counts, ids: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Log10 probability of each text; ``many`` ids of each follow one another, its end the last."""
    groups, starts = counts.group[ids], np.cumsum(many) - many
    x, goal, place = windows_of(groups, counts.class_of[ids], many)
    found = np.zeros(goal.shape)
    for at in range(0, len(x), SCORED):
        part = goal[at : at + SCORED]
        found[at : at + SCORED][part >= 0] = model.score(x[at : at + SCORED], counts.prior, part)
    last = np.empty(len(ids), np.int64)
    last[1:] = groups[:-1]
    last[starts] = START
    last *= counts.inner.shape[1]
    last += counts.rank[ids]
    each = found.reshape(-1).take(place)
    each /= math.log(10)
    each += counts.inner.reshape(-1).take(last)
    return np.add.reduceat(each, starts) if len(many) else np.empty(0)


def fit(docs: DataFrame, tokenizer: str = TOKENIZER, shard: int = SHARD) -> tuple[DataFrame, DataFrame, Counts, AttentionModel]:
    """The tokenized table, the training counts, the counted model and the attention model."""
    made = materialize(tokenized(docs, tokenizer), "tokens", "zstd")
    counted = materialize(training_counts(made), "counts")
    ids = np.zeros(VOCAB, np.int64)
    for token, n in counted.filter("kind = 2").select("token", "c").collect():  # at most VOCAB rows
        ids[int.from_bytes(token, "little")] = n
    pairs = ((r["g"], *(np.array(c, np.int64) for c in zip(*r["following"], strict=True))) for r in count_pairs(made, ids).toLocalIterator())
    counts = Counts(ids, pairs)
    return made, counted, counts, train(made, counts, int(ids.sum()), shard)


def score_documents(docs: DataFrame, tokenizer: str = TOKENIZER, head: int = HEAD, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids`` for every row.

    ``held_out``: crc32(doc_id as text) mod 5 is 1 (a null id counts as empty text and as training).
    Null and empty texts are the end alone; very long texts are read whole, in windows. Without
    training rows all counts are 0 and the model is its starting point. Repeated rows give repeated
    rows with the same scores but for rounding; an empty table gives none; further columns, whatever their names, are
    not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made, counted, counts, model = fit(docs, tokenizer, shard)
    words = counted.filter("kind = 1").select(F.col("token").alias("word"), "c")
    # How many words have each count: different counts are fewer than the root of twice the tokens.
    sizes = words.groupBy("c").count().toArrow().sort_by([("c", "descending")])
    often, at_least = np.cumsum(sizes.column("count").to_numpy()), sizes.column("c").to_numpy()
    total, distinct = int(at_least @ np.diff(often, prepend=0)), int(often[-1]) if len(often) else 0
    base = math.log10(total + 0.5 * (distinct + 1))
    # The most frequent words, all that have some count or more: at most ``head`` of them.
    known = int(np.searchsorted(often, head, "right"))
    top = words.filter(F.col("c") >= F.lit(int(at_least[known - 1]) if known else total + 1)).toArrow()
    ends = next((r[0] for r in words.filter("word = X''").select("c").collect()), 0)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((counts, model.flat, top.column("word").combine_chunks().cast(pa.large_binary()).cast(pa.large_string()), np.log10(top.column("c").to_numpy() + 0.5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, flat, known, value = held.value
        mine = AttentionModel(counts.features, flat)
        value = np.append(value, 0.0)
        for b in together(batches, bound=TOGETHER // 2):
            n = b.num_rows
            ids, many = _flat_ids(b.column("ids"))
            ends_at = np.cumsum(many)
            score = np.concatenate([score_ids(mine, counts, ids[ends_at[i] - many[i] : ends_at[j - 1]], many[i:j]) for i, j in _slices(many)])
            distinct, code, owner = words_of(b.column("text"))
            place = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy().astype(np.int64)
            often = place[code]
            near = np.bincount(owner, value[often], n) + math.log10(ends + 0.5)
            have = np.bincount(owner[often >= 0], minlength=n) + (ends > 0)
            far = often < 0
            pair, times = np.unique(owner[far] * max(1, len(distinct)) + code[far], return_counts=True)
            cut = np.searchsorted(pair // max(1, len(distinct)), np.arange(n + 1)).astype(np.int32)
            rare = distinct.take(pa.array(pair % max(1, len(distinct)))).cast(pa.binary())
            rare = pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([rare, pa.array(times.astype(np.int64))], ["word", "m"]))
            cols = [
                b.column("row"), b.column("doc_id"), b.column("held"), pa.array(np.bincount(owner, minlength=n) + 1), pa.array(have), pa.array(near), pa.array(score), pa.array(many), rare,
            ]
            for at in range(0, n, BATCH_ROWS):
                yield pa.RecordBatch.from_arrays([c.slice(at, BATCH_ROWS) for c in cols], ["row", "doc_id", "held_out", "n_tokens", "known", "sum", "score", "n_ids", "rare"])

    kind = "row long, doc_id long, held_out boolean, n_tokens long, known long, sum double, score double, n_ids long, rare array<struct<word:binary,m:long>>"
    scored = materialize(map_arrow(made.filter("kind = 0").select("row", "doc_id", "held", "text", "ids"), run, kind), "scored", "zstd")
    each = scored.select("row", F.inline("rare"))
    # Words are dealt so that a task can hold its part of their counts: then neither side is sorted.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-distinct // PART_WORDS))
    joined = each.repartition(tasks, "word").join(words.repartition(tasks, "word").hint("shuffle_hash"), "word", "left").groupBy("row").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare_sum"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("rare_known")
    )
    return scored.drop("rare").join(joined, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sum") + F.coalesce("rare_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(base)).alias("base_score"), "score", "n_ids",
    )


def _slices(many: np.ndarray, ids: int = 200_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``ids`` ids together."""
    at, ends = 0, np.cumsum(many)
    while at < len(many):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + ids)))
        yield at, to
        at = to

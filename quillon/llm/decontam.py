"""Benchmark decontamination with an FM-index over each shard of the training texts.

Test phrases are windows of consecutive words of the benchmark's items. A shard's texts become
word numbers; words that no item has become separators, and stretches too short for the shortest
phrase are left out, which loses no occurrence. Over what is left a shard builds a suffix array by
prefix doubling (separators are distinct and ordered by place, so order is total), its
Burrows-Wheeler transform as a wavelet matrix, and suffix positions sampled at every eighth place.
All phrases are searched backward together; occurrences are located by walking to a sampled
position; covered words merge into spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize

WINDOW = 8
SAMPLE = 8
#: Kept symbols and texts of one index.
SHARD_SYMBOLS, SHARD_TEXTS = 1_000_000, 20_000
#: Bytes of benchmark text in one block; a larger benchmark is searched block by block.
BLOCK_BYTES = 8_000_000

#: Columns that :func:`contamination` adds.
WORDS, SPANS, ITEMS = "_benchmark_words", "_benchmark_spans", "_benchmark_items"

_TABLE = bytes((c + 32) if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters and digits and of all non-ASCII characters."""
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """The distinct windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.window = window
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.windows = list(found)
        self.items = sorted({i for s in found.values() for i in s})
        number = {x: n for n, x in enumerate(self.items)}
        self.of_window = [np.array(sorted(number[i] for i in found[w]), np.int64) for w in self.windows]
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.shortest = int(self.lengths.min()) if self.windows else 0
        self.patterns = np.zeros((len(self.windows), window), np.int64)
        for n, w in enumerate(self.windows):
            self.patterns[n, window - len(w) :] = w  # right-aligned: searched from the last word back


class WaveletMatrix:
    """Ranks and symbols of a sequence of small integers, one bit vector for each bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.n, self.levels = len(values), []
        for b in range(bits - 1, -1, -1):
            bit = ((values >> b) & 1).astype(np.uint8)
            padded = np.zeros((len(bit) // 64 + 1) * 64, np.uint8)
            padded[: len(bit)] = bit
            blocks = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(blocks), dtype=np.int64)))
            zeros = len(bit) - int(before[-1])
            self.levels.append((b, blocks, before, zeros))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    @staticmethod
    def _ones(level: tuple, at: np.ndarray) -> np.ndarray:
        _, blocks, before, _ = level
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        below = blocks[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return before[word] + np.bitwise_count(below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        base = np.zeros_like(at)
        for level in self.levels:
            bit = ((symbol >> level[0]) & 1).astype(bool)
            ones, ones_base = self._ones(level, at), self._ones(level, base)
            at = np.where(bit, level[3] + ones, at - ones)
            base = np.where(bit, level[3] + ones_base, base - ones_base)
        return at - base

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for level in self.levels:
            bit = (level[1][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, at)
            symbol |= bit.astype(np.int64) << level[0]
            at = np.where(bit == 1, level[3] + ones, at - ones)
        return symbol


class FMIndex:
    """``text``: word numbers from 1; 0 separates and must end it."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        stops = np.flatnonzero(text == 0)
        rank = text + len(stops) - 1
        rank[stops] = np.arange(len(stops))
        order = np.argsort(rank, kind="stable")
        step = 1
        while True:
            ahead = np.minimum(np.arange(n) + step, n - 1)
            second = np.where(np.arange(n) + step < n, rank[ahead] + 1, 0)
            key = rank * (n + symbols + 2) + second
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            rank, step = fresh, step * 2
            if n < 2 or rank[order[-1]] == n - 1:
                break
        self.n = n
        bwt = text[order - 1]  # row 0's place wraps to the last symbol, a separator
        self.matrix = WaveletMatrix(bwt, max(1, int(symbols).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1)))).astype(np.int64)
        opens = np.concatenate(([True], text[:-1] == 0))
        sampled = (np.arange(n) % SAMPLE == 0) | opens
        marked = sampled[order]
        self.marked, self.before = marked, np.cumsum(marked) - marked
        self.samples = order[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of right-aligned patterns (0 pads on the left)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((patterns[:, column] > 0) & (low < high))
            if len(live):
                c = patterns[live, column]
                low[live] = self.first[c] + self.matrix.rank(c, low[live])
                high[live] = self.first[c] + self.matrix.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of rows, by backward steps to the nearest sampled place."""
        rows, out, steps = rows.copy(), np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.marked[rows[todo]]
            done = todo[here]
            out[done] = self.samples[self.before[rows[done]]] + steps[done]
            todo = todo[~here]
            if len(todo):
                at = rows[todo]
                c = self.matrix.access(at)
                rows[todo] = self.first[c] + self.matrix.rank(c, at)
                steps[todo] += 1
        return out


def search_texts(numbers: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[int]]]:
    """For each text (as word numbers, 0 unknown): merged hit spans in words, and item numbers."""
    spans: list[list[tuple[int, int]]] = [[] for _ in numbers]
    items: list[list[int]] = [[] for _ in numbers]
    pieces, owners, places = [], [], []
    for n, ids in enumerate(numbers):
        known = np.concatenate(([0], (ids > 0).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(known))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= phrases.shortest:
                pieces.append(ids[a:b])
                pieces.append(np.zeros(1, np.int64))
                owners.append((n, a, b - a + 1))
    if not pieces or not phrases.windows:
        return spans, items
    text = np.concatenate(pieces).astype(np.int64)
    lengths = np.array([o[2] for o in owners])
    owner = np.repeat(np.array([o[0] for o in owners]), lengths)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    places = np.arange(len(text)) - np.repeat(starts, lengths) + np.repeat(np.array([o[1] for o in owners]), lengths)
    index = FMIndex(text, len(phrases.vocab))
    low, high = index.search(phrases.patterns)
    many = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(many)), many)
    rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = index.locate(rows)
    if not len(at):
        return spans, items
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[which], -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover)[:-1] > 0).astype(np.int8), [0]))))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):  # a separator ends every stretch
        spans[owner[a]].append((int(places[a]), int(places[a]) + b - a))
    pairs = np.unique(owner[at] * np.int64(len(many)) + which)
    for pair in pairs.tolist():
        items[pair // len(many)].extend(phrases.of_window[pair % len(many)].tolist())
    return spans, [sorted(set(x)) for x in items]


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about ``block_bytes`` of text, read one partition at a time."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += len(text or "") + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_bytes: int = BLOCK_BYTES, clean_below: int | None = None) -> DataFrame:
    """``docs`` with its words counted (``WORDS``), ``SPANS`` (hit words, merged, end exclusive) and
    ``ITEMS``; these columns have names of their own, so none of ``docs``' columns is lost.

    A benchmark of any size works: it is read in blocks of bounded size, each of which passes once
    over the texts and adds to the spans found before; between two passes the texts are written, so
    no stage holds two blocks. Null and empty texts have no words, very long ones are searched whole;
    rows with a null id and repeated rows count each; an empty benchmark hits nothing; a null item id
    counts as empty text; items with one id are one item.
    """
    held = [f.name for f in docs.schema.fields if f.name not in (WORDS, SPANS, ITEMS)]
    out = docs.select(*held).withColumns({WORDS: F.lit(0).cast("long"), SPANS: F.array().cast("array<struct<start:int,end:int>>"), ITEMS: F.array().cast("array<string>")})
    schema = out.schema
    blocks = benchmark_blocks(benchmark, block_bytes=block_bytes)
    block = next(blocks, [])
    while True:
        after = next(blocks, None)
        finish = None if after is not None or clean_below is None else _cleaner(text_col, clean_below)
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))  # of block_bytes of text at most
        out = map_arrow(out, _search_block(phrases, text_col, finish), schema)
        if after is None:
            return out
        out = materialize(out, "contamination")
        block = after


def _cleaner(text_col: str, clean_below: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def clean(b: pa.RecordBatch) -> pa.RecordBatch:
        count = np.diff(np.asarray(b.column(ITEMS).offsets))
        b = b.filter(pa.array(count < clean_below))
        spans, column = b.column(SPANS), b.column(text_col)
        hit = np.flatnonzero(np.diff(np.asarray(spans.offsets)))
        if len(hit):
            texts = column.to_pylist()
            for n in hit.tolist():
                texts[n] = word_spans_cut(texts[n], [(s["start"], s["end"]) for s in spans[n].as_py()])
            column = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([column if c == text_col else b.column(c) for c in b.schema.names], b.schema.names)

    return clean


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search_block(held: Broadcast, text_col: str, finish: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        get = phrases.vocab.get
        waiting: list[pa.RecordBatch] = []
        numbers: list[np.ndarray] = []
        totals: list[int] = []
        symbols = 0

        def flush() -> Iterator[pa.RecordBatch]:
            spans, items = search_texts(numbers, phrases)
            at = 0
            for b in waiting:
                n = b.num_rows
                old = b.column(SPANS).to_pylist(), b.column(ITEMS).to_pylist()
                now_spans = [_merged([(s["start"], s["end"]) for s in o] + f) for o, f in zip(old[0], spans[at : at + n], strict=True)]
                now_items = [sorted({*o, *(phrases.items[i] for i in f)}) for o, f in zip(old[1], items[at : at + n], strict=True)]
                new = {
                    WORDS: pa.array(totals[at : at + n], pa.int64()),
                    SPANS: pa.array([[{"start": x, "end": y} for x, y in s] for s in now_spans], b.schema.field(SPANS).type),
                    ITEMS: pa.array(now_items, b.schema.field(ITEMS).type),
                }
                made = pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], b.schema.names)
                yield made if finish is None else finish(made)
                at += n
            waiting.clear(), numbers.clear(), totals.clear()

        for b in batches:
            for cut in range(0, b.num_rows, 2000):
                part = b.slice(cut, 2000)
                for t in part.column(text_col):
                    words = words_of(t.as_py())
                    ids = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
                    numbers.append(ids)
                    totals.append(len(ids))
                    symbols += len(ids)
                waiting.append(part)
                if symbols >= 4 * SHARD_SYMBOLS or len(numbers) >= SHARD_TEXTS:
                    yield from flush()
                    symbols = 0
        yield from flush()

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", min_items: int = 2) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row.

    Null and empty texts have no words, very long ones are searched whole; null ids stay null, repeated
    rows give repeated rows; an item that occurs several times, or under several rows, counts once; an
    empty table gives no rows, an empty benchmark no hits; further columns, whatever their names, are
    not read.
    """
    rows = contamination(docs.select(F.col(id_col).alias("doc_id"), "text"), benchmark, window)
    size = F.aggregate(SPANS, F.lit(0).cast("long"), lambda a, s: a + s.end - s.start)
    return rows.select(
        "doc_id", F.col(WORDS).alias("n_words"), size.alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(ITEMS), ","), 256).alias("items_sha256"), (F.size(ITEMS) >= min_items).alias("contaminated"),
    )


def word_spans_cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words in ``spans`` (and what stands between them); a line break marks each cut."""
    if not text or not spans:
        return text
    raw = text.encode()
    clean = raw.translate(_TABLE)
    inside = np.frombuffer(clean, np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    out.append(raw[at:])
    return b"\n".join(out).decode()

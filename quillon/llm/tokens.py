"""Public tokenizer ids, fast on running text.

The byte-level pattern starts a new piece at every space that stands alone between two other
characters, so a text without neighbouring white space splits at its spaces into chunks that can be
tokenized on their own. Most chunks repeat within a batch: the distinct ones are joined, tokenized in
one call and cut apart again by their bytes, and kept for the batches that follow; the texts' ids are
gathered from them. Texts with a space next to other white space are tokenized whole.
"""

from __future__ import annotations

import os
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: Bytes of text that are tokenized together, about: their distinct chunks are tokenized once.
TOGETHER = 8 << 20
#: Chunks whose ids are kept from batch to batch; when there are more the store starts afresh.
STORE = 750_000
_SPACE = r"[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WIDE = f"{_SPACE} | {_SPACE}"
_EDGE = f"^{_SPACE}|{_SPACE}$|^$"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """``name`` itself if it is a path, else the public tokenizers' file of that name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _process_store() -> dict:
    """A dictionary that outlives tasks in a reused Python worker."""
    return sys.modules.setdefault("_quillon_process_store", types.ModuleType("_quillon_process_store")).__dict__


def load_tokenizer(name: str = DEFAULT_TOKENIZER):  # noqa: ANN201
    from tokenizers import Tokenizer

    kept = _process_store()
    if name not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        found = Tokenizer.from_file(tokenizer_path(name))
        found.encode_special_tokens = True
        kept[name] = found
    return kept[name]


def vocabulary(name: str = DEFAULT_TOKENIZER) -> dict[bytes, int] | None:
    """The bytes of every id, where the vocabulary also comes as ranks."""
    ranks = os.path.splitext(tokenizer_path(name))[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    import base64

    with open(ranks, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TextEncoder:
    """Ids of whole texts as flat arrays."""

    def __init__(self, name: str = DEFAULT_TOKENIZER):
        kept = _process_store()
        if ("encoder", name) not in kept:
            table = vocabulary(name)
            if table is None:  # texts one by one, with the library the file belongs to
                whole = load_tokenizer(name)
                kept["encoder", name] = (lambda t: np.array(whole.encode(t, add_special_tokens=False).ids, np.uint32)), None
            else:  # the same ids, several times as fast
                import public_tokenizers
                import tiktoken

                found = tiktoken.Encoding("quillon", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
                width = np.zeros(max(table.values()) + 1, np.int64)
                width[list(table.values())] = list(map(len, table))
                kept["encoder", name] = found.encode_to_numpy, width
        self.one, self.width = kept["encoder", name]
        self._forget()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and each text's number of ids. Null
        texts count as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        alone = pc.match_substring_regex(texts, _WIDE).to_numpy(zero_copy_only=False).astype(bool)
        if self.width is None:
            alone[:] = True
        split = pc.split_pattern(texts.filter(pa.array(~alone)), " ")
        flat, ends = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        rest = flat.dictionary_encode()
        heads = flat.take(pa.array(ends[:-1])).dictionary_encode()  # no space stands before a text's first chunk
        place = self._chunks(rest.dictionary)
        others = [self.one(t) for t in heads.dictionary.to_pylist() + texts.filter(pa.array(alone)).to_pylist()]
        known = len(self.size)
        table = np.concatenate([self.table, *others])
        size = np.concatenate((self.size, np.fromiter(map(len, others), np.int64, len(others))))
        # Each text's entries of the table: of its chunks, or the one of the whole text.
        code = place[rest.indices.to_numpy()]
        code[ends[:-1]] = heads.indices.to_numpy() + known
        entries = np.ones(len(texts), np.int64)
        entries[~alone] = np.diff(ends)
        if alone.any():
            whole = np.repeat(alone, entries)
            every = np.empty(len(whole), np.int64)
            every[~whole] = code
            every[whole] = np.arange(alone.sum()) + known + len(heads.dictionary)
            code = every
        many = size[code]
        before = np.concatenate(([0], np.cumsum(many)))
        at = np.repeat((np.cumsum(size) - size)[code] - before[:-1], many)
        at += np.arange(before[-1])
        return table[at], np.diff(before[np.concatenate(([0], np.cumsum(entries)))])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        ids, many = self(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(many)[:-1])

    def _chunks(self, chunks: pa.Array) -> np.ndarray:
        """The entry of each of the distinct chunks, each after a space; new ones are added."""
        if len(self.known) > STORE:
            self._forget()
        place = pc.fill_null(pc.index_in(chunks, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = chunks.filter(pa.array(place < 0))
        if not len(new):
            return place
        edge = pc.match_substring_regex(new, _EDGE)
        plain, odd = new.filter(pc.invert(edge)), new.filter(edge)
        tables, sizes = [self.table], [self.size]
        if len(plain):
            spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), plain, pa.scalar(" ", pa.large_string()))
            ends = np.cumsum(pc.binary_length(spaced).to_numpy())
            ids = self.one(memoryview(spaced.buffers()[2])[: ends[-1]].tobytes().decode())
            cut = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            tables.append(ids)
            sizes.append(np.diff(cut, prepend=0))
        for t in odd.to_pylist():  # these would run into their neighbours
            tables.append(self.one(" " + t))
            sizes.append(np.array([len(tables[-1])], np.int64))
        hard = edge.to_numpy(zero_copy_only=False).astype(bool)
        self.table, self.size = np.concatenate(tables), np.concatenate(sizes)
        place[place < 0] = len(self.known) + np.where(hard, len(plain) + np.cumsum(hard) - 1, np.cumsum(~hard) - 1)
        self.known = pa.concat_arrays([self.known, plain, odd])
        return place

    def _forget(self) -> None:
        self.known, self.table, self.size = pa.array([], pa.large_string()), np.empty(0, np.uint32), np.empty(0, np.int64)


def together(batches: Iterator[pa.RecordBatch], column: str = "text", bound: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of about ``bound`` bytes of text; a longer text stands
    with few others."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= bound:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


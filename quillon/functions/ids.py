"""Document ids: 128-bit, as 26 characters of Crockford's base 32."""

from __future__ import annotations

import os
import threading
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

#: The alphabet, and the 128-bit FNV-1a basis and prime.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
FNV_BASIS = 0x6C62272E07BB014262B821756295C58D
FNV_PRIME = 0x0000000001000000000000000000013B

_lock, _sequence = threading.Lock(), [0]


def encode(number: int) -> str:
    return "".join(ALPHABET[number >> shift & 31] for shift in range(125, -1, -5))


def is_id(text: object) -> bool:
    return isinstance(text, str) and len(text) == 26 and text[0] in "01234567" and all(c in ALPHABET for c in text.upper())


def checked_id(text: object) -> str:
    if not is_id(text):
        raise EngineError("InvalidDocumentId", f"{text!r} is not a document id")
    return text.upper()


def new_id(now_ms: int | None = None) -> str:
    """48 bits of milliseconds, a 16-bit sequence and 64 random bits."""
    with _lock:
        _sequence[0] = (_sequence[0] + 1) & 0xFFFF
        at = _sequence[0]
    ms = int(time.time() * 1000) if now_ms is None else now_ms
    return encode((ms & (1 << 48) - 1) << 80 | at << 64 | int.from_bytes(os.urandom(8), "big"))


def derived_id(collection: str, key: str) -> str:
    """The same id for the same collection and key, everywhere."""
    value = FNV_BASIS
    for byte in collection.encode() + b"\0" + key.encode():
        value = (value ^ byte) * FNV_PRIME % (1 << 128)
    return encode(value)


def _digests(prefix: bytes, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """High and low halves of the 128-bit FNV-1a of ``prefix`` and each key, all keys at once.

    The prime is ``2**88 + 315``, so a product is a shift and a small multiple.
    """
    raw = pc.fill_null(keys, "").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    high, low = np.full(len(raw), FNV_BASIS >> 64, np.uint64), np.full(len(raw), FNV_BASIS & (1 << 64) - 1, np.uint64)
    small, half, shift = np.uint64(FNV_PRIME & 0xFFFF), np.uint64(32), np.uint64(24)

    def step(rows: np.ndarray | slice, byte: np.ndarray | np.uint64) -> None:
        lo, hi = low[rows] ^ byte, high[rows]
        carry = ((lo >> half) * small + ((lo & np.uint64(0xFFFFFFFF)) * small >> half)) >> half
        high[rows], low[rows] = hi * small + carry + (lo << shift), lo * small

    for byte in prefix:
        step(slice(None), np.uint64(byte))
    rows, at = np.arange(len(raw)), 0
    while len(rows := rows[size[rows] > at]):
        step(rows, data[ends[rows] + at].astype(np.uint64))
        at += 1
    return high, low


def _texts(high: np.ndarray, low: np.ndarray) -> pa.Array:
    letters = np.frombuffer(ALPHABET.encode(), np.uint8)
    out = np.empty((len(high), 26), np.uint8)
    for n, at in enumerate(range(125, -1, -5)):
        if at >= 64:
            part = high >> np.uint64(at - 64)
        else:
            part = low >> np.uint64(at)
            if at > 59:  # the five bits lie in both halves
                part |= high << np.uint64(64 - at)
        out[:, n] = letters[(part & np.uint64(31)).astype(np.int64)]
    return pa.array(out.reshape(-1).view("S26"), pa.binary()).cast(pa.string())


def derived_id_column(collection: str, key: Column) -> Column:
    """:func:`derived_id` of each key; 128-bit products have no SQL type, hence an Arrow UDF."""
    prefix = collection.encode() + b"\0"

    @F.arrow_udf("string")
    def run(keys: pa.Array) -> pa.Array:
        return pc.if_else(keys.is_valid(), _texts(*_digests(prefix, keys)), None)

    return run(key.cast("string"))

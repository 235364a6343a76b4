"""Field encryption: AES-256-GCM bound to document and field, keys from passphrases."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError

#: Fixed value: the fewest rounds that a key may be derived with.
MIN_ROUNDS = 600_000
PREFIX = "enc1:"


def derive_key(passphrase: str, salt: bytes, rounds: int = MIN_ROUNDS) -> bytes:
    if rounds < MIN_ROUNDS:
        raise EngineError("Encryption", f"at least {MIN_ROUNDS} rounds")
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, rounds, 32)


def _aad(field: str) -> Column:
    return F.concat(F.col("_id").cast("string"), F.lit("\0"), F.lit(field))


def encrypt_fields(df: DataFrame, fields: list[str], key: bytes) -> DataFrame:
    """Each field as JSON under AES-GCM with a fresh nonce; what was encrypted cannot be moved to
    another document or field. Null stays null."""
    sealed = {f: F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(F.to_json(F.struct(F.col(f).alias("v"))).cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), _aad(f).cast("binary")))) for f in fields}
    return df.withColumns({f: F.when(F.col(f).isNotNull(), c) for f, c in sealed.items()})


def decrypt_fields(df: DataFrame, fields: dict[str, str], key: bytes) -> DataFrame:
    """Undo :func:`encrypt_fields`; ``fields`` gives each field's type. A wrong key or a moved value
    raises; strings that are not encrypted pass as they are."""
    out = {}
    for f, kind in fields.items():
        body = F.unbase64(F.substring(F.col(f), len(PREFIX) + 1, 1 << 30))
        plain = F.aes_decrypt(body, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), _aad(f).cast("binary")).cast("string")
        opened = F.from_json(plain, f"v {kind}").getField("v")
        out[f] = F.when(F.startswith(F.col(f), F.lit(PREFIX)), opened).otherwise(F.col(f) if kind == "string" else F.lit(None))
    return df.withColumns(out)


def rekey(df: DataFrame, fields: dict[str, str], old: bytes, new: bytes) -> DataFrame:
    return encrypt_fields(decrypt_fields(df, fields, old), list(fields), new)

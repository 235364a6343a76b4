"""One exception class with a stable code."""

from __future__ import annotations

#: The codes that callers may test for.
CODES = frozenset({
    "ChangesetTooLarge", "CompoundIndexMultipleArrays", "Config", "DuplicateId", "Encryption", "IndexNotFound",
    "InvalidDocumentId", "InvalidFilter", "InvalidName", "InvalidOperation", "InvalidSnapshot", "Migration", "NotFound",
    "QueryTimeout", "Serialization", "Storage", "TypeError", "VectorDimensionMismatch", "VectorIndexNotFound",
    "WatchClosed",
})


class EngineError(Exception):
    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code = code

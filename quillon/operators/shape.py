"""Shape versions: documents that were stored by an older or newer client, read in one shape.

A step from version k to k+1 gives the new expressions of the fields that it changes. Rows carry
their version in ``_v`` (null: 0); reads bring older rows up to date without rewriting them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError


def migrate(df: DataFrame, steps: Sequence[Mapping[str, Column]]) -> DataFrame:
    """``df`` at version ``len(steps)``: each row passes the steps from its own version on. Rows of a
    later version stay as they are."""
    version = F.coalesce(F.col("_v"), F.lit(0)) if "_v" in df.columns else F.lit(0)
    out = df.withColumn("__v", version)
    for k, step in enumerate(steps):
        old = {n: F.col(f"`{n}`") if n in out.columns else F.lit(None) for n in step}
        out = out.withColumns({n: F.when(F.col("__v") <= k, new).otherwise(old[n]) for n, new in step.items()})
    return out.withColumn("_v", F.greatest("__v", F.lit(len(steps)))).drop("__v")


def downgrade(df: DataFrame, steps: Mapping[int, Mapping[str, Column]], to: int) -> DataFrame:
    """Rows newer than ``to`` in that shape; ``steps[k]`` leads from version k to k-1."""
    out = df.withColumn("__v", F.coalesce(F.col("_v"), F.lit(0)))
    for k in sorted(steps, reverse=True):
        if k > to:
            out = out.withColumns({n: F.when(F.col("__v") >= k, new).otherwise(F.col(f"`{n}`") if n in out.columns else F.lit(None)) for n, new in steps[k].items()})
    return out.withColumn("_v", F.least("__v", F.lit(to))).drop("__v")


def check_writable(df: DataFrame, version: int) -> None:
    """Refuse to change rows that a newer client wrote."""
    if "_v" in df.columns and df.filter(F.col("_v") > version).limit(1).count():
        raise EngineError("InvalidOperation", f"a document is newer than version {version}")

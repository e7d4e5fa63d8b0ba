"""Deterministic orders: hash shuffles and tie breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(*parts) -> Column:
    """SHA-256 of the parts joined by colons: a shuffle that any engine repeats."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def value_at_max(value, by, then) -> Column:
    """Aggregate: the non-null ``value`` with the greatest ``by``, of equals the least ``then``, then the least value."""
    return F.min(F.when(value.isNotNull(), F.struct((-by).alias("b"), then.alias("t"), value.alias("v"))))["v"]

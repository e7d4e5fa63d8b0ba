"""Train-fitted item features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaler(items: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, nulls, n) over ``items`` in one pass; a zero or null deviation is refused by ``feature_matrix``."""
    wide = items.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("nulls", lambda c: F.count_if(F.col(c).isNull())), ("n", lambda c: F.count(F.lit(1))))])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"mean_{c}").alias("mean"), F.col(f"std_{c}").alias("std"), F.col(f"nulls_{c}").alias("nulls"), F.col(f"n_{c}").alias("n")) for c in columns]))
    return wide.select(rows.alias("r")).select("r.*")


def one_hot(column: str, values: list, prefix: str, other: str) -> dict[str, F.Column]:
    """0/1 columns for ``values``, and ``other`` for null or anything else."""
    flags = {f"{prefix}_{v}": F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int") for v in values}
    return flags | {f"{prefix}_{other}": F.coalesce(~F.col(column).isin(*values), F.lit(True)).cast("int")}


def feature_matrix(items: DataFrame, fitted: DataFrame, continuous: list[str], binary: list[str], hots: dict) -> DataFrame:
    """(item_id, <column>_z, binaries, one-hots): null continuous values become the mean, so 0.

    ``hots`` maps a column to (values, prefix, name for the rest). The fit's few numbers
    become literals of the plan.
    """
    stats = {r.feature: (r.mean, r.std) for r in fitted.collect()}
    bad = [c for c in continuous if not stats[c][1]]
    if bad:
        raise ValueError(f"no variance in {bad}")
    z = {f"{c}_z": (F.coalesce(F.col(c).cast("double"), F.lit(stats[c][0])) - stats[c][0]) / stats[c][1] for c in continuous}
    flags = {c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in binary}
    for column, (values, prefix, other) in hots.items():
        flags |= one_hot(column, values, prefix, other)
    return items.select("item_id", *[c.alias(n) for n, c in (z | flags).items()])


def genre_hots(train_items: DataFrame, column: str = "genre") -> dict:
    """One-hot specification of the genres seen in training (their number is that of the genre list)."""
    values = [r[0] for r in train_items.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).collect()]
    return {column: (values, "genre", "unknown")}


def validate_matrix(matrix: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(check_name, violations): repeated ids, nulls, and one-hot groups that don't sum to one."""
    cells = [c for c in matrix.columns if c != "item_id"]
    nulls = sum((F.col(c).isNull().cast("int") for c in cells), F.lit(0))
    exprs = [(F.count("*") - F.count_distinct("item_id")).alias("repeated_ids"), F.sum(nulls).alias("null_cells")]
    exprs += [F.count_if(sum((F.col(c) for c in names), F.lit(0)) != 1).alias(f"bad_{g}") for g, names in groups.items()]
    wide = matrix.agg(*exprs)
    return wide.unpivot([], wide.columns, "check_name", "violations")


def as_vectors(matrix: DataFrame, columns: list[str] | None = None, first: int | None = None) -> DataFrame:
    """(item_id, features array<double>); ``first`` keeps the leading columns only."""
    columns = columns or [c for c in matrix.columns if c != "item_id"]
    return matrix.select("item_id", F.array(*[F.col(c).cast("double") for c in columns[:first]]).alias("features"))

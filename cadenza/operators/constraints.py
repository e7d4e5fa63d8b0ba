"""Declared table constraints, checked as violation counts."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Constraints:
    """Primary key, columns that must not be null, named predicates, and foreign keys (column -> table, column)."""

    key: list[str] = field(default_factory=list)
    not_null: list[str] = field(default_factory=list)
    checks: dict[str, str] = field(default_factory=dict)
    foreign: dict[str, tuple[DataFrame, str]] = field(default_factory=dict)


def violations(df: DataFrame, rules: Constraints) -> DataFrame:
    """(constraint_name, violations). A predicate that is null holds, as in SQL."""
    parts = []
    if rules.key:
        repeated = df.groupBy(*rules.key).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(repeated.agg(F.lit("key:" + ",".join(rules.key)).alias("constraint_name"), F.count("*").alias("violations")))
    single = {f"not_null:{c}": F.col(c).isNull() for c in rules.not_null} | {f"check:{n}": ~F.expr(e) for n, e in rules.checks.items()}
    if single:
        wide = df.agg(*[F.count_if(p).alias(n) for n, p in single.items()])
        parts.append(wide.unpivot([], [f"`{c}`" for c in wide.columns], "constraint_name", "violations"))
    for column, (parent, other) in rules.foreign.items():
        orphans = df.where(F.col(column).isNotNull()).join(parent.select(F.col(other).alias(column)), column, "left_anti")
        parts.append(orphans.agg(F.lit(f"foreign:{column}").alias("constraint_name"), F.count("*").alias("violations")))
    return reduce(DataFrame.union, parts)

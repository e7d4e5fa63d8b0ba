"""Deterministic splits of interactions, with integrity checks and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.ordering import hash_order

PARTS = ("train", "validation", "test")


def _shuffled(seed: int):
    return hash_order(seed, F.col("user_id"), F.col("item_id"))


def three_way_split(edges: DataFrame, seed: int = 42, min_evaluation_items: int = 20, validation_fraction: float = 0.1, test_fraction: float = 0.1) -> DataFrame:
    """``edges`` with ``split``: of users with enough items a share each goes to validation and test.

    A user's items are put in the order of SHA-256 of seed, user and item; the first
    max(1, floor(n * fraction)) are validation, as many by the other fraction test. One
    shuffle by user; whole histories of one user are the largest group.
    """
    if min_evaluation_items < 3:
        raise ValueError("evaluation users need at least three items")
    if validation_fraction <= 0 or test_fraction <= 0 or validation_fraction + test_fraction >= 1:
        raise ValueError("fractions must be positive and leave room for training")
    user = Window.partitionBy("user_id")
    ranked = edges.withColumn("n", F.count("*").over(user)).withColumn("place", F.row_number().over(user.orderBy(_shuffled(seed), "item_id")))
    v = F.greatest(F.lit(1), F.floor(F.col("n") * validation_fraction))
    t = F.greatest(F.lit(1), F.floor(F.col("n") * test_fraction))
    part = F.when(F.col("n") < min_evaluation_items, "train").when(F.col("place") <= v, "validation").when(F.col("place") <= v + t, "test").otherwise("train")
    return ranked.withColumn("split", part).drop("n", "place")


def split_integrity(edges: DataFrame, assigned: DataFrame, min_evaluation_items: int = 20) -> DataFrame:
    """(check_name, violations): rows missing, extra or repeated, and users whose parts don't fit their size."""
    keys = ["user_id", "item_id"]
    missing = edges.join(assigned, keys, "left_anti").agg(F.lit("missing_rows").alias("check_name"), F.count("*").alias("violations"))
    extra = assigned.join(edges, keys, "left_anti").agg(F.lit("extra_rows"), F.count("*"))
    repeated = assigned.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.lit("repeated_rows"), F.count("*"))
    users = assigned.groupBy("user_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("split") == p).alias(p) for p in PARTS])
    whole = users.where((F.col("n") >= min_evaluation_items) & ((F.col("train") == 0) | (F.col("validation") == 0) | (F.col("test") == 0)))
    sparse = users.where((F.col("n") < min_evaluation_items) & (F.col("train") < F.col("n")))
    return missing.union(extra).union(repeated).union(whole.agg(F.lit("eligible_users_without_a_part"), F.count("*"))).union(sparse.agg(F.lit("sparse_users_held_out"), F.count("*")))


def split_audit(assigned: DataFrame) -> DataFrame:
    """(metric, value): rows of each part, users evaluated, training users and items, held-out rows of items that training lacks, repeated pairs."""
    wide = assigned.agg(
        *[F.count_if(F.col("split") == p).alias(f"{p}_rows") for p in PARTS],
        F.count_distinct(F.when(F.col("split") == "validation", F.col("user_id"))).alias("evaluation_users"),
        F.count_distinct(F.when(F.col("split") == "train", F.col("user_id"))).alias("train_users"),
        F.count_distinct(F.when(F.col("split") == "train", F.col("item_id"))).alias("train_items"),
    )
    absent = assigned.where("split <> 'train'").join(assigned.where("split = 'train'").select("item_id").distinct(), "item_id", "left_anti")
    repeated = assigned.groupBy("user_id", "item_id").agg((F.count("*") - 1).alias("n"))
    wide = wide.crossJoin(absent.agg(F.count("*").alias("held_out_rows_absent_from_train"))).crossJoin(repeated.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_assignments")))  # one row each
    names = wide.columns
    return wide.unpivot([], names, "metric", "value")


def cold_items(assigned: DataFrame) -> DataFrame:
    """(split, item_id) held out but absent from training."""
    train = assigned.where("split = 'train'").select("item_id").distinct()
    return assigned.where("split <> 'train'").select("split", "item_id").distinct().join(train, "item_id", "left_anti").select("split", "item_id")


def _with_size(rows: DataFrame) -> DataFrame:
    items = rows.groupBy("user_id", "item_id").agg(F.max("play_count").alias("play_count"))
    return items.withColumn("n", F.count("*").over(Window.partitionBy("user_id")))


def leave_largest_out(rows: DataFrame, minimum_to_split: int = 5, seed: int = 311) -> tuple[DataFrame, DataFrame]:
    """(train, held): each user's most played item is held out, with all its rows.

    Users with fewer than ``minimum_to_split`` items stay whole. Equal counts are settled
    by the hash order.
    """
    order = Window.partitionBy("user_id").orderBy(F.desc("play_count"), _shuffled(seed), "item_id")
    held = _with_size(rows).where(F.col("n") >= minimum_to_split).withColumn("place", F.row_number().over(order)).where("place = 1").select("user_id", "item_id")
    return rows.join(held, ["user_id", "item_id"], "left_anti"), held


def hold_out(rows: DataFrame, how: str = "frac", frac: float = 0.2, n: int = 1, minimum_to_split: int = 5, seed: int = 311) -> tuple[DataFrame, DataFrame]:
    """(train, held): a share (``frac``) or number (``n``) of each user's items in hash order; one stays at least."""
    size = F.col("n")
    if how == "frac":
        take = F.greatest(F.lit(1), F.least(F.floor(size * frac), size - 1))
    elif how == "n":
        take = F.least(F.lit(n), size - 1)
    else:
        raise ValueError("how is frac or n")
    order = Window.partitionBy("user_id").orderBy(_shuffled(seed), "item_id")
    held = _with_size(rows).where(size >= minimum_to_split).withColumn("place", F.row_number().over(order)).where(F.col("place") <= take).select("user_id", "item_id")
    return rows.join(held, ["user_id", "item_id"], "left_anti"), held


def country_sample(users: DataFrame, country: str, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Users of a country in the order of SHA-256 of seed and user: the first max(1, round(n * fraction)).

    Halves are rounded to even. The window holds the users of one country.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction is in (0, 1]")
    own = users.where(F.col("country") == country)
    every = Window.partitionBy("country")
    ranked = own.withColumn("n", F.count("*").over(every)).withColumn("place", F.row_number().over(every.orderBy(hash_order(seed, F.col("user_id")), "user_id")))
    return ranked.where(F.col("place") <= F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(fraction), 0))).drop("n", "place")

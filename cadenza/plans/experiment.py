"""Experiment data: a loader over published tables, and the contract that models rely on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators.features import as_vectors
from cadenza.operators.registry import Registry
from cadenza.sources.tables import require_checksum


def check_split(split: str, allow_test: bool) -> None:
    """Known splits only, and test only when it is unlocked."""
    if split not in ("train", "validation", "test"):
        raise ValueError(f"unknown split {split}")
    if split == "test" and not allow_test:
        raise PermissionError("the test split is locked; pass allow_test=True")


@dataclass
class Split:
    train: DataFrame
    validation: DataFrame
    test: DataFrame
    metadata: dict


@dataclass
class ExperimentData:
    """Lazy frames of one experiment."""

    train: DataFrame
    truth: DataFrame
    vectors: DataFrame
    catalog: DataFrame
    seen: DataFrame
    evaluation_split: str
    metadata: dict


def experiment_violations(train: DataFrame, truth: DataFrame, vectors: DataFrame) -> DataFrame:
    """(check_name, violations): catalogs that differ, truth outside the catalog, repeated pairs."""
    items = train.select("item_id").distinct()
    featured = vectors.select("item_id").distinct()

    def count(name, df):
        return df.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))

    repeated = train.groupBy("user_id", "item_id").agg(F.count("*").alias("n")).where("n > 1")
    parts = count("train_items_without_features", items.join(featured, "item_id", "left_anti"))
    parts = parts.union(count("features_without_train_items", featured.join(items, "item_id", "left_anti")))
    parts = parts.union(count("truth_outside_catalog", truth.select("item_id").distinct().join(items, "item_id", "left_anti")))
    return parts.union(count("repeated_train_pairs", repeated))


@dataclass
class DataLoader:
    """Reads one version of the interactions, split and features that ``registry`` says belong together."""

    spark: SparkSession
    registry: Registry
    data_version: str
    split_version: str
    feature_version: str
    root: str
    allow_test: bool = False

    def __post_init__(self):
        self.registry.require("dataset", self.data_version)
        self.registry.require("split", self.split_version, dataset=self.data_version)
        self.registry.require("features", self.feature_version, dataset=self.data_version, split=self.split_version)

    def _read(self, kind: str, version: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.root}/{kind}/{version}")
        if df.isEmpty():
            raise ValueError(f"{kind} {version} is empty")
        return df

    def graph(self) -> DataFrame:
        """(user_id, item_id, play_count) sorted; nulls are refused."""
        df = self._read("dataset", self.data_version).select("user_id", "item_id", "play_count")
        if not df.where("user_id is null or item_id is null or play_count is null").isEmpty():
            raise ValueError("the interaction graph has nulls")
        return df.orderBy("user_id", "item_id")

    def split(self, name: str) -> DataFrame:
        """(user_id, item_id, play_count) of a split."""
        check_split(name, self.allow_test)
        own = self._read("split", self.split_version).where(F.col("split") == name).select("user_id", "item_id")
        return own.join(self._read("dataset", self.data_version).select("user_id", "item_id", "play_count"), ["user_id", "item_id"])

    def split_records(self, name: str) -> DataFrame:
        """``split`` in the order of user and item."""
        return self.split(name).orderBy("user_id", "item_id")

    def splits(self) -> Split:
        check_split("test", self.allow_test)
        return Split(*[self.split(s) for s in ("train", "validation", "test")], self.registry.require("split", self.split_version))

    def truth(self, name: str) -> DataFrame:
        """(user_id, items) of a held-out split."""
        return self.split(name).groupBy("user_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))

    def single_truth(self, name: str) -> DataFrame:
        """(user_id, item_id); refused where a user has more than one item."""
        rows = self.split(name).select("user_id", "item_id").distinct()
        if not rows.groupBy("user_id").agg(F.count("*").alias("n")).where("n <> 1").isEmpty():
            raise ValueError("users have several held-out items")
        return rows

    def feature_matrix(self) -> DataFrame:
        """The feature table as it was published, by item; columns, rows, ids and checksum must be the registered ones."""
        config = self.registry.require("features", self.feature_version)
        df = self._read("features", self.feature_version)
        columns = config.get("columns")
        if columns and df.columns != ["item_id", *columns]:
            raise ValueError("feature columns differ from the registered ones")
        rows, ids = df.agg(F.count("*"), F.count_distinct("item_id")).first()
        if rows != ids or rows != config.get("rows", rows):
            raise ValueError(f"{rows} feature rows of {ids} items, {config.get('rows', ids)} registered")
        if "checksum" in config:
            require_checksum(df, config["checksum"])
        return df.orderBy("item_id")

    def vectors(self) -> DataFrame:
        """(item_id, features) of ``feature_matrix``."""
        return as_vectors(self.feature_matrix())

    def experiment(self, evaluation_split: str = "validation") -> ExperimentData:
        """The bundle of one evaluation; 'train' can't be evaluated, and the contract must hold."""
        if evaluation_split == "train":
            raise ValueError("train can't be evaluated")
        train, truth, vectors = self.split("train"), self.split(evaluation_split).select("user_id", "item_id"), self.vectors()
        broken = [r.check_name for r in experiment_violations(train, truth, vectors).where("violations > 0").collect()]
        if broken:
            raise ValueError(f"experiment contract broken: {broken}")
        seen = train.select("user_id", "item_id")
        return ExperimentData(train, truth, vectors, vectors.select("item_id"), seen, evaluation_split, self.registry.require("split", self.split_version))

"""Frames behind the reports of tuning and test runs; drawing them is left to the reader's tool."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.features import as_vectors
from cadenza.operators.models import catalog_plane, cluster_weights

#: Metric of a record and its name in result files, and the cuts that are tried in turn (fixed values).
METRICS = {"recall": "recall", "ndcg": "ndcg", "hit_rate": "hit_rate", "coverage": "catalog_coverage"}
CUTS = (20, 10)


def parse_config(name: str) -> dict[str, float]:
    """A configuration from its name: a number is alpha, otherwise each word before a number names it."""
    if re.fullmatch(r"[-+]?[0-9.]+(e[-+]?[0-9]+)?", name):
        return {"alpha": float(name)}
    return {word: float(value) for word, value in re.findall(r"([a-z]+)_(-?[0-9.]+)(?=_|$)", name)}


def load_results(spark: SparkSession, path: str, model: str = "", k: int = 20) -> list[dict]:
    """Records (model, configuration, recall, ndcg, hit_rate, coverage) of a JSON result file.

    The file has a list ``runs`` of configurations and metrics, or metrics by a configuration's
    name. A metric is taken at ``k``, else at 20, else at 10; a file without recall is refused.
    """
    raw = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(raw, dict):
        raise ValueError(f"{path} holds no results")
    if "runs" in raw:
        runs = [(r.get("configuration", {}) | ({"cf_weight": r["cf_weight"]} if "cf_weight" in r else {}), r["metrics"]) for r in raw["runs"]]
    else:
        runs = [(parse_config(name), metrics) for name, metrics in raw.items()]
    records = []
    for config, metrics in runs:
        found = {m: next((metrics[f"{name}@{c}"] for c in (k, *CUTS) if f"{name}@{c}" in metrics), None) for m, name in METRICS.items()}
        if found["recall"] is None:
            raise ValueError(f"{path} has no recall")
        records.append({"model": model, "configuration": config, **found})
    return records


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """(model, configuration, place, recall, ndcg, hit_rate, coverage); ``place`` is the record's place in its list."""
    rows = [(r["model"], {a: str(b) for a, b in r["configuration"].items()}, i, *(None if r[m] is None else float(r[m]) for m in METRICS)) for i, r in enumerate(records)]
    return spark.createDataFrame(rows, "model string, configuration map<string,string>, place long, recall double, ndcg double, hit_rate double, coverage double")


def best_per_model(records: DataFrame, metric: str = "recall") -> DataFrame:
    """The first record with the greatest metric of each model; null is least."""
    order = Window.partitionBy("model").orderBy(F.desc_nulls_last(metric), "place")
    return records.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def sweep(records: DataFrame, parameter: str, metric: str = "recall") -> DataFrame:
    """(model, value, best, mean, runs): the metric by the values of one parameter, for bars, trends and curves."""
    value = F.col("configuration")[parameter]
    return records.where(value.isNotNull()).groupBy("model", value.cast("double").alias("value")).agg(F.max(metric).alias("best"), F.avg(metric).alias("mean"), F.count("*").alias("runs")).orderBy("model", "value")


def heat(records: DataFrame, rows: str, columns: str, metric: str = "recall") -> DataFrame:
    """One row for each value of a parameter, one column for each of another, cells by the greatest metric."""
    config = F.col("configuration")
    named = records.select(config[rows].cast("double").alias(rows), config[columns].alias("c"), metric)
    return named.groupBy(rows).pivot("c").agg(F.max(metric)).orderBy(rows)


def cut_comparison(metrics: DataFrame) -> DataFrame:
    """One row for each k of an evaluation's rows (model, k, metrics), models side by side by recall."""
    return metrics.groupBy("k").pivot("model").agg(F.first("recall")).orderBy("k")


def test_table(metrics: DataFrame, baselines: DataFrame, names=("recall", "ndcg", "hit_rate", "coverage")) -> DataFrame:
    """(metric, one column for each model): test results beside the baselines; a metric that a model lacks is NaN."""
    long = [d.select("model", *[F.col(n).cast("double") if n in d.columns else F.lit(None).cast("double").alias(n) for n in names]) for d in (metrics, baselines)]
    rows = long[0].unionByName(long[1]).unpivot("model", list(names), "metric", "value").withColumn("value", F.coalesce("value", F.lit(float("nan"))))
    return rows.groupBy("metric").pivot("model").agg(F.first("value")).orderBy("metric")


def interest_counts(rows: DataFrame, labels: DataFrame, min_history: int = 15) -> DataFrame:
    """(user_id, clusters, items) of users with enough items: the points of the scatter."""
    own = rows.join(labels, "item_id").groupBy("user_id").agg(F.count_distinct("label").alias("clusters"), F.count_distinct("item_id").alias("items"))
    return own.where(F.col("items") >= min_history)


def interest_histogram(rows: DataFrame, labels: DataFrame, min_history: int = 15) -> DataFrame:
    """(clusters, users): how many users touch so many clusters."""
    return interest_counts(rows, labels, min_history).groupBy("clusters").agg(F.count("*").alias("users"))


def example_user(rows: DataFrame, labels: DataFrame, min_history: int = 15) -> DataFrame:
    """(user_id, label, weight) of the user a quarter down the list of users by clusters touched, the most first."""
    counts = interest_counts(rows, labels, min_history)
    n = counts.count()
    picked = counts.orderBy(F.desc("clusters"), "user_id").offset(n // 4).limit(1)
    return cluster_weights(rows, labels).join(picked.select("user_id"), "user_id", "left_semi")


def interest_plane(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, x, y, label): the catalog on its two principal components."""
    vectors = matrix if "features" in matrix.columns else as_vectors(matrix)
    return catalog_plane(vectors).join(labels, "item_id", "left")


def audit_lines(audit: DataFrame) -> list[str]:
    """``metric: value`` lines in the order of the metric; audits are a few rows by their making."""
    return [f"{r.metric}: {r.value:,.0f}" if float(r.value).is_integer() else f"{r.metric}: {r.value:,.4f}" for r in audit.orderBy("metric").collect()]

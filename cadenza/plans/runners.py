"""Runners: grids of configurations, timed and ranked, and the small demo."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadenza.operators import models as M
from cadenza.operators.factorization import ImplicitALS, sgd_factors
from cadenza.operators.metrics import assert_unseen, evaluate_topk, single_truth_metrics
from cadenza.operators.splits import country_sample, leave_largest_out
from cadenza.session import checkpointed, free_shuffles


def grid(**options) -> list[dict]:
    """All combinations of the options' values, in the order given."""
    return [dict(zip(options, values, strict=True)) for values in itertools.product(*options.values())]


#: Grids of the tuning runs (fixed values).
ITEM_KNN_GRID = {"alpha": [1, 10, 40], "neighbours": [50, 100, 200], "weighting": ["cosine", "bm25"], "min_cooccurrence": [2, 5]}
ALS_GRID = {"alpha": [1, 10, 40], "factors": [32, 64, 128], "regularization": [0.01, 0.1], "iterations": [10, 20]}
CONTENT_GRID = {"alpha": [0.7, 0.8, 0.9, 0.95]}
MULTI_GRID = {"alpha": [0.9], "global_weight": [0.1, 0.2, 0.3], "clusters": [8, 16]}


def run_grid(configs: list[dict], recommend: Callable[..., DataFrame], seen: DataFrame, truth: DataFrame, catalog: DataFrame, k_values=(10, 20)) -> list[dict]:
    """Metrics and seconds of each configuration, best NDCG at the largest k first, equals in the order of their values.

    Each configuration is a distributed job of its own; only its few metrics reach the driver.
    """
    results = []
    for config in configs:
        began = time.perf_counter()
        recs = recommend(**config).cache()
        assert_unseen(recs, seen)
        rows = evaluate_topk(recs, truth, catalog, k_values).collect()
        recs.unpersist()
        free_shuffles(seen.sparkSession)
        scores = {f"{name}@{r.k}": getattr(r, name) for r in rows for name in ("recall", "ndcg", "hit_rate", "coverage")}
        results.append({"config": config, "metrics": scores, "seconds": time.perf_counter() - began})
    best = f"ndcg@{max(k_values)}"
    return sorted(results, key=lambda r: (-round(r["metrics"][best], 9), [str(v) for v in r["config"].values()]))


def run_item_knn(train: DataFrame, truth: DataFrame, catalog: DataFrame, options: dict | None = None, k: int = 20) -> list[dict]:
    def recommend(alpha, neighbours, weighting, min_cooccurrence):
        similar = M.item_neighbours(train, neighbours, alpha, weighting, min_cooccurrence)
        return M.recommend_neighbours(train, similar, k, alpha)

    return run_grid(grid(**(options or ITEM_KNN_GRID)), recommend, train, truth, catalog)


def run_als(train: DataFrame, truth: DataFrame, catalog: DataFrame, options: dict | None = None, k: int = 20) -> list[dict]:
    return run_grid(grid(**(options or ALS_GRID)), lambda **c: ImplicitALS(**c).fit(train).recommend(k), train, truth, catalog)


def run_hybrid(train: DataFrame, truth: DataFrame, vectors: DataFrame, weights=(0.9, 0.95, 1.0), k: int = 20, neighbours: int = 200) -> list[dict]:
    similar = M.item_neighbours(train, neighbours, 1.0, "bm25", 2)
    cf = M.neighbour_scores(train, similar).cache()
    content = M.content_scores(M.content_profiles(train, vectors), vectors).cache()
    return run_grid(grid(cf_weight=list(weights)), lambda cf_weight: M.top_k_unseen(M.hybrid_dense(cf, content, cf_weight), train, k), train, truth, vectors.select("item_id"))


def run_content(train: DataFrame, truth: DataFrame, vectors: DataFrame, options: dict | None = None, k: int = 20) -> list[dict]:
    return run_grid(grid(**(options or CONTENT_GRID)), lambda alpha: M.recommend_content(train, vectors, k, alpha), train, truth, vectors.select("item_id"))


def run_multi_interest(train: DataFrame, truth: DataFrame, vectors: DataFrame, options: dict | None = None, k: int = 20, seed: int = 311) -> list[dict]:
    """The catalog is clustered once for each number of clusters."""
    options = options or MULTI_GRID
    labels = {n: checkpointed(M.catalog_clusters(vectors, n, seed)) for n in options["clusters"]}

    def recommend(alpha, global_weight, clusters):
        return M.top_k_unseen(M.multi_interest_scores(train, vectors, labels[clusters], alpha, global_weight), train, k)

    return run_grid(grid(**options), recommend, train, truth, vectors.select("item_id"))


def run_baselines(train: DataFrame, truth: DataFrame, popularity: DataFrame, k_values=(10, 20), seed: int = 42) -> list[dict]:
    """Metrics of global popularity, history-matched popularity and random lists, in this order."""
    k, users = max(k_values), truth.select("user_id").distinct()
    models = {
        "popularity": lambda: M.recommend_popular(train, users, k),
        "history_popularity": lambda: M.recommend_history_popularity(train, users, popularity, k),
        "random": lambda: M.recommend_random(train, users, k, seed),
    }
    return [run_grid([{}], make, train, truth, train, k_values)[0] | {"model": name} for name, make in models.items()]


def country_rows(rows: DataFrame, users: DataFrame, country: str = "United States", fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Rows of a hash sample of a country's users, for the runs on one country."""
    return rows.join(country_sample(users, country, fraction, seed).select("user_id"), "user_id", "left_semi")


def demo(spark: SparkSession, seed: int = 8) -> dict[str, dict]:
    """Six models on a small generated catalog of two tastes: recall and NDCG at 2."""
    rng = random.Random(seed)
    tastes = {"calm": (0.9, 0.2), "loud": (0.1, 0.8)}
    items = {f"{taste}{n}": [x + rng.uniform(0, 0.1) for x in middle] for taste, middle in tastes.items() for n in range(5)}
    plays = [(u, i, float(rng.randint(1, 30))) for u in range(1, 9) for i in rng.sample(sorted(items), 8) if i.startswith("calm") == (u % 2 == 0) or rng.random() < 0.3]
    rows = spark.createDataFrame(plays, "user_id int, item_id string, play_count double")
    vectors = spark.createDataFrame(list(items.items()), "item_id string, features array<double>")
    train, truth = leave_largest_out(rows, 3, 1)
    users = train.select("user_id").distinct()
    similar = M.item_neighbours(train)
    cf, content = M.neighbour_scores(train, similar), M.content_scores(M.content_profiles(train, vectors), vectors)
    lists = {
        "popularity": M.recommend_popular(train, users, 2),
        "item_knn": M.recommend_neighbours(train, similar, 2),
        "mf": M.top_k_unseen(sgd_factors(train), train, 2),
        "content": M.recommend_content(train, vectors, 2),
        "multi_interest": M.top_k_unseen(M.multi_interest_scores(train, vectors, M.catalog_clusters(vectors, 2)), train, 2),
        "hybrid": M.top_k_unseen(M.hybrid_sparse(cf, content), train, 2),
    }
    return {name: single_truth_metrics(recs, truth, 2).first().asDict() for name, recs in lists.items()}

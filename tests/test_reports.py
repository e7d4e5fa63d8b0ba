import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from cadenza import __main__ as cli
from cadenza.plans import reports as R
from cadenza.sources import tables as T


def test_results(spark, tmp_path):
    one = {"runs": [{"configuration": {"neighbours": n}, "cf_weight": w, "metrics": {"recall@20": r, "ndcg@20": r / 2, "catalog_coverage@10": 0.5}} for n, w, r in ((10, 0.1, 0.2), (20, 0.1, 0.3), (20, 0.5, 0.3))]}
    two = {"0.7": {"recall@10": 0.1}, "alpha_0.80_gw_0.30_km_16": {"recall@50": 0.4, "recall@20": 0.2}}
    for name, value in (("a", one), ("b", two), ("c", {"0.1": {"ndcg@20": 1.0}}), ("d", [])):
        (tmp_path / name).write_text(json.dumps(value, indent=1))
    records = R.load_results(spark, str(tmp_path / "a"), "knn") + R.load_results(spark, str(tmp_path / "b"), "content")
    assert records[4]["configuration"] == {"alpha": 0.8, "gw": 0.3, "km": 16.0} and records[3]["recall"] == 0.1 and records[0]["coverage"] == 0.5 and records[3]["ndcg"] is None
    for bad in "cd":
        with pytest.raises(ValueError):
            R.load_results(spark, str(tmp_path / bad))
    frame = R.records_frame(spark, records)
    assert {(r.model, r.place) for r in R.best_per_model(frame).collect()} == {("knn", 1), ("content", 4)}
    assert [(r.value, r.best, r.runs) for r in R.sweep(frame.where("model = 'knn'"), "neighbours").collect()] == [(10.0, 0.2, 1), (20.0, 0.3, 2)]
    assert R.heat(frame.where("model = 'knn'"), "neighbours", "cf_weight").count() == 2
    metrics = spark.createDataFrame([("m", 10, 0.2), ("m", 20, 0.3)], "model string, k int, recall double")
    assert [r.m for r in R.cut_comparison(metrics).collect()] == [0.2, 0.3]
    base = spark.createDataFrame([("random", 0.01)], "model string, recall double")
    table = {r.metric: r for r in R.test_table(metrics.where("k = 20"), base).collect()}
    assert table["recall"].random == 0.01 and str(table["ndcg"].m) == "nan"


def test_interests(spark):
    rows = spark.createDataFrame([(u, f"i{j}", 1.0) for u in range(8) for j in range(u + 1)], "user_id int, item_id string, play_count double")
    labels = spark.createDataFrame([(f"i{j}", j % 3) for j in range(8)], "item_id string, label long")
    assert {(r.clusters, r.users) for r in R.interest_histogram(rows, labels, 2).collect()} == {(2, 1), (3, 6)}
    assert {r.user_id for r in R.example_user(rows, labels, 2).collect()} == {3}


def test_publishing(spark, tmp_path):
    path = str(tmp_path / "t")
    T.publish(spark.range(3), path)
    T.insert(spark.range(3, 5), path)
    T.delete(spark, path, "id % 2 = 0")
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 3}
    shutil.move(path, f"{path}.former")  # as a crash between the renames leaves it
    assert T.recover(spark, path) and not T.recover(spark, path) and spark.read.parquet(path).count() == 2
    spark.range(2).createOrReplaceTempView("summary_of_two")
    assert ("summary_of_two", 2) in T.catalog_summary(spark)
    spark.catalog.dropTempView("summary_of_two")


def test_command_line(spark, small, tmp_path):
    from cadenza.plans import fixtures as fx
    from cadenza.operators.cleaning import canonical_tracks, stage_tracks

    root = str(tmp_path)
    edges = fx.fixture(spark, small, fx.INTERACTIONS).selectExpr("user_id", "concat('t', item_id) AS item_id", "play_count")
    T.publish(edges, f"{root}/raw")
    tracks = canonical_tracks(stage_tracks(fx.fixture(spark, small, fx.RAW_TRACKS))).withColumnRenamed("track_id", "item_id")
    T.publish(tracks, f"{root}/items")
    T.publish(edges.select("item_id").distinct().selectExpr("item_id", "50L AS popularity"), f"{root}/popularity")
    lines = cli.run(spark, [root, "filter", "--min-user-items", "6"])
    assert lines[0].startswith("iteration_count: ") and any(x.startswith("retained_rows: ") for x in lines)
    assert any(x == "duplicate_assignments: 0" for x in cli.run(spark, [root, "split", "--min-evaluation-items", "10"]))
    assert cli.run(spark, [root, "matrix"]) == ["29 columns"]
    found = cli.run(spark, [root, "item-knn", "--alpha", "1", "--neighbours", "5", "10", "--weighting", "bm25", "--min-cooccurrence", "1"])
    assert len(found) == 2 and found[0]["metrics"]["ndcg@20"] >= found[1]["metrics"]["ndcg@20"]
    assert [r["model"] for r in cli.run(spark, [root, "baselines", "--k", "5"])] == ["popularity", "history_popularity", "random"]
    with pytest.raises(PermissionError):
        cli.run(spark, [root, "baselines", "--evaluation-split", "test"])


def test_without_the_training_part(tmp_path):
    """Queries, SQL and entry work in a copy without both folders, whether the pipeline's file is there or not."""
    repo = Path(__file__).resolve().parent.parent
    for keep in (True, False):
        copy = tmp_path / str(keep)
        shutil.copytree(repo, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'op1_suffixes' not in q and len(q) > 60 and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "HOME": str(tmp_path)})

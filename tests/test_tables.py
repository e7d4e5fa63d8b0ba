import pytest

from cadenza.operators import cleaning as C
from cadenza.operators import constraints as K
from cadenza.operators.registry import Registry
from cadenza.plans.experiment import DataLoader, check_split
from cadenza.sources import tables as T


def test_sinks_and_checksums(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "cast(id % 7 as double) / 2 AS x", "nullif(concat('n', id % 3), 'n1') AS name")
    path = str(tmp_path / "t")
    T.publish(df, path)
    T.publish(df, path)
    back = T.read_parquet(spark, path, ["id", "x", "name"], 100)
    assert T.content_checksum(back.repartition(7)) == T.content_checksum(df)
    with pytest.raises(ValueError):
        T.require_checksum(back.where("id > 0"), T.content_checksum(df))
    with pytest.raises(ValueError):
        T.read_parquet(spark, path, ["id"])
    with pytest.raises(ValueError):
        T.read_parquet(spark, path, rows=1)
    T.write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 100
    T.write_json(spark, {"b": 1, "a": 2}, str(tmp_path / "m.json"))
    assert (tmp_path / "m.json").read_text().index('"a"') < (tmp_path / "m.json").read_text().index('"b"')


def test_csv_and_parameters(spark, tmp_path):
    line = "0,id1,A;B,album,\"Title, with comma\",50,1000,True,.1,.2,3,-4,1,.1,.2,.3,.4,.5,120,4,pop"
    header = ",track_id,artists,album_name,track_name,popularity,duration_ms,explicit,danceability,energy,key,loudness,mode,speechiness,acousticness,instrumentalness,liveness,valence,tempo,time_signature,track_genre"
    (tmp_path / "t.csv").write_text(f"{header}\n{line}\n")
    row = T.read_csv(spark, str(tmp_path / "t.csv")).first()
    assert row.track_name == "Title, with comma" and row.popularity == 50 and row.explicit is True
    assert T.execute_query(spark, "SELECT :x + 1 AS y", {"x": 1}, "one").y == 2
    assert len(T.execute_query(spark, "SELECT explode(sequence(1, ?)) AS y", [3], "all")) == 3
    with pytest.raises(ValueError):
        T.execute_query(spark, "SELECT 1", fetch="two")


def test_reasons_and_artists(spark):
    columns = "source_row_id int, track_id string, artists string, track_name string, popularity int, track_genre string, tempo double"
    rows = [(1, None, "a", "t", 1, "g", 1.0), (2, "x", " ", "t", 1, "g", 1.0), (3, "x", "a;;b", "T-1!", 5, "g", 0.0), (4, "x", "a", "t", 5, "f", 9.0)]
    staged = C.stage_tracks(spark.createDataFrame(rows, columns))
    assert [r.rejection_reason for r in C.rejected_tracks(staged).orderBy("source_row_id").collect()] == ["missing_track_id", "missing_artists"]
    best = C.canonical_tracks(staged).first()
    assert best.source_row_id == 4 and best.tempo == 9.0
    odd = C.track_artists(C.canonical_tracks(staged.where("source_row_id = 3")))
    assert [(r.artist_name, r.artist_order) for r in odd.orderBy("artist_order").collect()] == [("a", 1), ("b", 3)]


def test_constraints(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, -1)], "id int, v int")
    parent = spark.createDataFrame([(1,)], "id int")
    found = {r.constraint_name: r.violations for r in K.violations(df, K.Constraints(["id"], ["v"], {"positive": "v > 0"}, {"id": (parent, "id")})).collect()}
    assert found == {"key:id": 1, "not_null:v": 1, "check:positive": 1, "foreign:id": 1}


def test_registry_and_loader(spark, tmp_path):
    reg = Registry()
    assert reg.register("dataset", "d1", {"a": 5}) and not reg.register("dataset", "d1", {"a": 5})
    with pytest.raises(ValueError):
        reg.register("dataset", "d1", {"a": 6})
    reg.register("split", "s1", {"dataset": "d1"})
    reg.register("features", "f1", {"dataset": "d1", "split": "s1", "columns": ["x"]})
    reg = Registry.loads(reg.dumps())
    edges = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0), (2, "a", 1.0), (2, "c", 1.0), (3, "b", 1.0)], "user_id int, item_id string, play_count double")
    split = spark.createDataFrame([(1, "a", "train"), (1, "b", "validation"), (2, "a", "train"), (2, "c", "test"), (3, "b", "train")], "user_id int, item_id string, split string")
    T.publish(edges, str(tmp_path / "dataset/d1"))
    T.publish(split, str(tmp_path / "split/s1"))
    T.publish(spark.createDataFrame([("a", 1.0), ("b", 0.0)], "item_id string, x double"), str(tmp_path / "features/f1"))
    loader = DataLoader(spark, reg, "d1", "s1", "f1", str(tmp_path))
    assert loader.graph().count() == 5 and loader.split("train").count() == 3
    bundle = loader.experiment("validation")
    assert bundle.truth.count() == 1 and bundle.vectors.count() == 2
    assert loader.single_truth("validation").count() == 1
    for bad in ("train", "nothing"):
        with pytest.raises(ValueError):
            loader.experiment(bad)
    with pytest.raises(PermissionError):
        loader.splits()
    with pytest.raises(PermissionError):
        check_split("test", False)
    with pytest.raises(ValueError):
        DataLoader(spark, reg, "d2", "s1", "f1", str(tmp_path))

import pytest
from conftest import same

from cadenza.llm import warc
from cadenza.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, duck, name):
    got, want = same(QUERIES[name](spark, small), duck, ORACLE_SQL[name])
    assert got == want


def leaves(spark, changes=()):
    rows = [(r, f, o * 100, f * 1000 + o, f"h{f}-{o}") for r in ("a", "b") for f in (*range(40), -1) for o in range(30)]
    changed = {(r, f, o): v for r, f, o, v in changes}
    rows = [(*x[:4], changed.get(x[:3], x[4])) for x in rows if changed.get(x[:3], "") is not None]
    return spark.createDataFrame(rows, "replica string, file long, offset long, page_id long, sha256 string")


def test_equal_replicas(spark):
    same_ = leaves(spark)
    top = warc.merkle_levels(same_, 500, 4)[-1].nodes.collect()
    assert len(top) == 2 and top[0].sha256 == top[1].sha256
    assert warc.audit(same_, "a", "b", 500, 4).count() == 0


def test_differences(spark):
    rows = warc.audit(leaves(spark, [("b", 3, 700, "x"), ("b", 39, 2900, None), ("a", 0, 0, None), ("b", -1, 100, "y")]), "a", "b", 500, 4).collect()
    assert {(r.file, r.offset, r.status) for r in rows} == {(3, 700, "changed"), (39, 2900, "missing"), (0, 0, "extra"), (-1, 100, "changed")}


def test_nulls_repeats_and_extras(spark, tmp_path):
    import duckdb

    rows = [(i, f"u{i}", f"page {i} é", "x") for i in (5, 9, 7, 108, 112, 102, 1005, 2000, 1112)]
    rows += [(None, None, None, None), (None, "u", "no id", "x"), (None, "u", "no id", "x"), (5, "u5", "", "y"), (9, "u9", "page 9 é", "x"), (7, None, None, "z"), (4, "", "", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, file string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = same(warc.op10_warc(spark, str(tmp_path)), con, ORACLE_SQL["op10_warc"])
    assert got == want
    found = warc.op10_warc(spark, str(tmp_path)).collect()
    assert {r.status for r in found} == {"missing", "extra", "changed"} and all(r.page_id is not None for r in found)
    assert sum(r.status == "extra" for r in found) == 3 and sum(r.status == "missing" for r in found) == 3
    index = warc.record_index(warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string, file string"))).collect()
    assert len({(r.file, r.offset) for r in index}) == len(rows) and sum(r.file < 0 for r in index) == 3


def test_nothing(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op10_warc(spark, str(tmp_path)).count() == 0
    assert warc.audit(leaves(spark).limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("compress", [False, True])
def test_files(spark, small, tmp_path, compress):
    records = warc.page_records(spark.read.parquet(f"{small}/pages.parquet")).orderBy("page_id").collect()
    data = warc.join_warc([r.raw.encode() for r in records], compress)
    (tmp_path / "p.warc").write_bytes(data + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort")
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("offset").collect()
    assert len(rows) == len(records) and {r.type for r in rows} == {"resource"}
    html = {f"<urn:page:{r.page_id}>": (r.html or "").encode() for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert all(bytes(r.payload) == html[r.record_id] for r in rows)
    if not compress:
        assert all(data[r.offset : r.offset + r.length] == x.raw.encode() for r, x in zip(rows, records, strict=True))

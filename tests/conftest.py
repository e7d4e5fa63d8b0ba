import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from cadenza.session import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{small}/{file}'")
    return con


def same(df, con, sql):
    """Rows of a frame and of DuckDB, ready to compare: columns by name, doubles to five places."""

    def cell(x):
        if isinstance(x, float):
            return round(x, 5) + 0.0
        if isinstance(x, list):
            return tuple(map(cell, x))
        return x if x is None or isinstance(x, (str, bool, int)) else str(x)

    def rows(values, names):
        order = sorted(range(len(names)), key=names.__getitem__)
        return sorted([tuple(cell(v[i]) for i in order) for v in values], key=str)

    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return rows(df.collect(), df.columns), rows(found.fetchall(), names)

"""Sources and sinks: typed CSV, validated Parquet, staged publishing, checksums, parameterised queries."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a raw catalog CSV, its unnamed first one being the row number (fixed values).
TRACK_CSV = (
    "source_row_id INT, track_id STRING, artists STRING, album_name STRING, track_name STRING, popularity SMALLINT, duration_ms INT, explicit BOOLEAN, "
    "danceability DOUBLE, energy DOUBLE, key SMALLINT, loudness DOUBLE, mode SMALLINT, speechiness DOUBLE, acousticness DOUBLE, instrumentalness DOUBLE, "
    "liveness DOUBLE, valence DOUBLE, tempo DOUBLE, time_signature SMALLINT, track_genre STRING"
)


def read_csv(spark: SparkSession, path: str, schema: str = TRACK_CSV) -> DataFrame:
    """A CSV with a header by an explicit schema: no pass over the data to infer it."""
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=False)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, rows: int | None = None, order: str | None = None) -> DataFrame:
    """A Parquet table that must have exactly ``columns``, in order, and ``rows`` rows; never empty."""
    df = spark.read.parquet(path)
    if columns is not None and list(df.columns) != list(columns):
        raise ValueError(f"{path} has columns {df.columns}, not {list(columns)}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{path} has {n} rows, not {rows}")
    if rows is None and df.isEmpty():
        raise ValueError(f"{path} is empty")
    return df.orderBy(order) if order else df


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write Parquet beside ``path`` and rename it into place.

    The former table is set aside by a rename and deleted last, so that a whole table is on
    the store at any time: under ``path``, or under ``path.former`` after a crash between the
    two renames, which the next call puts back first.
    """
    spark = df.sparkSession
    building = f"{path}.building"
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(building)
    recover(spark, path)
    jvm, new, fs = _fs(spark, building)
    final, former = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.former"))
    if fs.exists(final):
        fs.delete(former, True)
        if not fs.rename(final, former):
            raise OSError(f"could not set {path} aside")
    if not fs.rename(new, final):
        fs.rename(former, final)
        raise OSError(f"could not publish {path}")
    fs.delete(former, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back a table that a crash between the renames of ``publish`` left aside; tells whether it did."""
    _, final, fs = _fs(spark, path)
    _, former, _ = _fs(spark, f"{path}.former")
    return bool(not fs.exists(final) and fs.exists(former) and fs.rename(former, final))


def insert(df: DataFrame, path: str) -> None:
    """Rows of ``df`` added to a published table by columns' names; the table is published anew, so all or none are seen."""
    former = df.sparkSession.read.parquet(path)
    publish(former.unionByName(df.select(*former.columns)), path)


def delete(spark: SparkSession, path: str, condition: str) -> None:
    """Rows for which the SQL ``condition`` holds removed from a published table; those for which it is null stay."""
    rows = spark.read.parquet(path)
    publish(rows.where(~F.coalesce(F.expr(condition), F.lit(False))), path)


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """A CSV with a header; one file for review sheets, which are small by their limit."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json(spark: SparkSession, value, path: str) -> None:
    """A small value as JSON with sorted keys, through Spark's file system so that any store works."""
    jvm, p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, indent=2).encode()))
    finally:
        out.close()


def content_checksum(df: DataFrame) -> str:
    """A digest of a table's rows in any order and partitioning: equal tables have equal ones.

    Rows are hashed to twice 60 bits; sums of the two, the number of rows and the schema are
    hashed again. Part files are not byte-stable, so files are not what is hashed.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(2)]
    sums = df.agg(*[F.sum(h) for h in halves], F.count("*")).first()
    text = json.dumps([df.dtypes, *[str(v) for v in sums]])
    return df.sparkSession.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


def require_checksum(df: DataFrame, expected: str) -> DataFrame:
    if (found := content_checksum(df)) != expected:
        raise ValueError(f"checksum {found} is not {expected}")
    return df


def execute_query(spark: SparkSession, sql: str, params: Sequence | dict | None = None, fetch: str = "df"):
    """A parameterised query as a frame (``df``), its first row (``one``) or all rows (``all``)."""
    df = spark.sql(sql, args=params if params is None or isinstance(params, dict) else list(params))
    if fetch == "df":
        return df
    if fetch == "one":
        return df.first()
    if fetch == "all":
        return df.collect()
    raise ValueError("fetch is df, one or all")


def catalog_summary(spark: SparkSession) -> list[tuple[str, int]]:
    """(table, rows) of the session's catalog, by name."""
    return [(t.name, spark.table(t.name).count()) for t in sorted(spark.catalog.listTables(), key=lambda t: t.name)]

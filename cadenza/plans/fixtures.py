"""Tables of the supplied star schema in the shapes that the operators read.

Each is one SELECT that Spark and DuckDB both run, so a query and its oracle start from
the same rows. They hold the rows that cleaning is about: blank and repeated ids, nulls,
and values out of range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.session import ship

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

INTERACTIONS = "SELECT o_custkey AS user_id, l_partkey AS item_id, sum(l_quantity) AS play_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey"

RAW_TRACKS = """
SELECT p_partkey AS source_row_id,
  CASE WHEN p_partkey % 97 = 0 THEN ' ' ELSE concat('t', CAST(p_partkey - (p_partkey % 5) % 2 AS STRING), ' ') END AS track_id,
  CASE WHEN p_partkey % 89 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN concat(p_brand, ';;', p_type) ELSE concat(p_brand, ';', p_type) END AS artists,
  p_brand AS album_name, CASE WHEN p_partkey % 83 = 0 THEN '' ELSE p_name END AS track_name,
  CAST(p_size * 2 + CASE WHEN p_partkey % 61 = 0 THEN 99 ELSE 0 END AS INT) AS popularity,
  CAST((p_size % 10) * 1000 AS INT) AS duration_ms, p_partkey % 7 = 0 AS explicit,
  CAST(p_size % 4 AS DOUBLE) / 4 AS danceability, CAST(p_partkey % 53 AS DOUBLE) / 50 AS energy,
  CAST(p_size % 14 - 1 AS INT) AS key, -CAST(p_size AS DOUBLE) / 8 AS loudness, CAST(p_partkey % 37 % 3 AS INT) AS mode,
  0.25 * CAST(p_size % 3 AS DOUBLE) AS speechiness, 0.5 * CAST(p_size % 2 AS DOUBLE) AS acousticness, 0.125 * CAST(p_size % 8 AS DOUBLE) AS instrumentalness,
  0.25 * CAST(p_size % 5 AS DOUBLE) AS liveness, CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE 0.125 * CAST(p_partkey % 9 AS DOUBLE) END AS valence,
  CAST(p_size % 11 AS DOUBLE) * 12.5 AS tempo, CAST(p_size % 6 AS INT) AS time_signature,
  CASE WHEN p_partkey % 29 = 0 THEN '' ELSE p_type END AS track_genre
FROM part"""

RAW_USERS = "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 17 = 0 THEN ' ' ELSE n_name END AS country, CAST(floor(c_acctbal) AS BIGINT) AS total_scrobbles FROM customer JOIN nation ON c_nationkey = n_nationkey"

RAW_LISTENING = """
SELECT CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE o_custkey END AS user_id, l_linenumber - CASE WHEN l_orderkey % 67 = 0 THEN 3 ELSE 0 END AS rank,
  CASE WHEN l_partkey % 71 = 0 THEN ' ' WHEN l_partkey % 2 = 0 THEN upper(p_name) ELSE concat(p_name, '!') END AS track_name,
  CASE WHEN l_partkey % 73 = 0 THEN NULL ELSE p_brand END AS artist_name,
  CAST(l_quantity AS BIGINT) - CASE WHEN l_orderkey % 59 = 0 THEN 20 ELSE 0 END AS playcount,
  CASE WHEN l_partkey % 3 = 0 THEN concat('m', CAST(l_partkey AS STRING)) END AS mbid
FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"""

ITEMS = "SELECT p_partkey AS item_id, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_size END AS size, p_retailprice AS price, p_partkey % 7 = 0 AS explicit, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_size % 12 AS INT) END AS key, p_type AS genre FROM part"

VECTORS = "SELECT vec_id AS item_id, embedding AS features FROM embeddings"

LABELS = "SELECT vec_id AS item_id, CAST(label AS BIGINT) AS label FROM embeddings"


def views(spark: SparkSession, sf_dir: str) -> None:
    """Registers the tables under their names, read lazily."""
    ship(spark)
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    views(spark, sf_dir)
    return spark.sql(sql)

"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import discard, free_shuffles, ship, stored  # noqa: F401


#: Bytes of the rows that Spark sends to a Python worker at once, where the session names no bound of its own.
ARROW_BYTES = 3 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A named table of a data folder; read by Spark, so any store works.

    Arrow batches are bounded by bytes as well as rows, since 10,000 long texts are too many at once.
    """
    ship(spark)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(bound, None) is None:
        spark.conf.set(bound, ARROW_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sorted_join(df: DataFrame) -> DataFrame:
    """``df`` marked for a sort-merge join: a table that grows with the data is never gathered in the driver for a broadcast."""
    return df.hint("merge")


def default_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each holds about ``limit`` bytes.

    Each slice has at least one row; a text beyond the limit is alone in its slice.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        yield batch.slice(first)


def release() -> None:
    """Give memory that Python and Arrow have freed back to the system; their allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, with ``release`` at its end: workers live on from stage to stage, and so would what they hold."""

    def outer(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return outer


def in_fold(doc_id, modulus: int, fold: int):
    """Whether crc32 of the id as decimal text leaves ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == fold


def _edge_state(edges: DataFrame) -> tuple:
    """Count and hash sum of distinct edges: equal for equal sets."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``: rows (node, component).

    ``component`` is the smallest node reachable. Alternates large-star and small-star
    rounds until nothing changes, each a shuffle with map-side aggregation; edges are
    written to the shared folder each round so that lineage stays short. Nodes without
    edges are not listed. An error is raised where the rounds, far more than the logarithm of
    any graph's size, were not enough.
    """
    cur = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = _edge_state(cur)
    for _ in range(60):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: larger neighbours go to the least of the closed neighbourhood
        large = both.join(sorted_join(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, name)
        # small-star: smaller neighbours and the node itself go to the least neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(sorted_join(least), "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = stored(small, name)
        before, after = state, _edge_state(new)
        discard(large)
        discard(cur)
        cur, state = new, after
        if before == after:
            break
    else:
        raise RuntimeError("components have not converged")
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

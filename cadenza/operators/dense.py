"""Dense scoring in tiles: matrix products over Arrow batches, with the best of each tile kept."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import free_shuffles, ship, stored

#: Users that meet a tile of items in one task, and items of a tile, where all scores are wanted.
USER_BLOCK, ITEM_TILE = 4096, 512
#: Bytes of a block's or a tile's vectors where only the best go on: each user is sent once a tile, each item once a block.
SIDE_BYTES = 16 << 20
#: Users of a task that all items stream past, and items scored at once: few at first, for a first bound.
STREAM_USERS, FIRST_ITEMS, STREAM_ITEMS = 1 << 16, 1 << 11, 1 << 14
_ONE_TASK = "spark.sql.unionOutputPartitioning"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _dealt(users: DataFrame, items: DataFrame, n_users: int, block: int, n_items: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``block`` and ``tile``: users dealt to blocks and copied for each tile, items the other way round."""
    tasks = 2 * users.sparkSession.sparkContext.defaultParallelism
    block = min(block, max(USER_BLOCK, math.ceil(n_users / tasks)))  # smaller where few blocks would leave cores idle
    tiles, blocks = max(1, math.ceil(n_items / tile)), max(1, math.ceil(n_users / block))
    u = users.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(blocks))).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    i = items.withColumn("tile", F.pmod(F.xxhash64("item_id"), F.lit(tiles)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return u, i


def _best(part: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``keep`` best finite scores of each row, to nine places, then by column."""
    n = part.shape[1]
    least = np.partition(part, n - keep, axis=1)[:, n - keep] if keep < n else np.full(len(part), -np.inf)
    r, c = np.nonzero((part >= least[:, None] - 2e-9) & np.isfinite(part))
    order = np.lexsort((c, -np.round(part[r, c], 9), r))
    r, c = r[order], c[order]
    first = np.searchsorted(r, r)
    kept = np.arange(len(r)) - first < keep
    return r[kept], c[kept]


def tiled_products(users: DataFrame, items: DataFrame, tile: int | None = None, keep: int | None = None) -> DataFrame:
    """(user_id, item_id, score): inner products of ``features`` of all users and items.

    Users are dealt to blocks and items to tiles, by hash; a block and a tile meet in one
    group, whose memory is bounded by their sizes. With ``keep`` only that many best items
    of a tile go on for each user, after dropping those in ``seen`` if that column exists;
    ties at the cut are settled by item. Blocks and tiles are then larger, by bytes, since
    each user is sent once for each tile.
    """
    ship(users.sparkSession)
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("features")), F.lit(1)).alias("width")).first()
    side = max(1, SIDE_BYTES // (8 * max(1, size.width)))
    n_users, has_seen = users.count(), "seen" in users.columns
    text, kind = dict(items.dtypes)["item_id"], dict(users.dtypes)["user_id"]
    u, i = _dealt(users, items, n_users, USER_BLOCK if keep is None else side, size.n, tile or (ITEM_TILE if keep is None else side))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("user_id", left.schema.field("user_id").type), ("item_id", right.schema.field("item_id").type), ("score", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        right = right.take(pc.sort_indices(right["item_id"]))
        names = right["item_id"].combine_chunks()
        x, y = _matrix(left["features"]), _matrix(right["features"])
        rows, cols, values = [], [], []
        step = 256 if keep is None else max(1, (1 << 21) // len(y))
        for low in range(0, len(x), step):
            part = x[low : low + step] @ y.T
            if keep is None:
                r, c = np.divmod(np.arange(part.size), part.shape[1])
            else:
                if has_seen:
                    seen = left["seen"].slice(low, step).combine_chunks()
                    at = pc.index_in(seen.flatten(), value_set=names).to_numpy(zero_copy_only=False)
                    of = np.repeat(np.arange(len(part)), pc.list_value_length(seen).to_numpy(zero_copy_only=False))
                    known = ~np.isnan(at.astype(float))
                    part[of[known], at[known].astype(np.int64)] = -np.inf
                r, c = _best(part, keep)
            rows.append(r + low)
            cols.append(c)
            values.append(part[r, c])
        return pa.table([left["user_id"].take(pa.array(np.concatenate(rows))), names.take(pa.array(np.concatenate(cols))), pa.array(np.concatenate(values))], schema=schema)

    grouped = u.groupBy("block", "tile").cogroup(i.groupBy("block", "tile"))
    return grouped.applyInArrow(meet, f"user_id {kind}, item_id {text}, score double")


class _Lists:
    """The ``keep`` best unseen items of users past which tiles of items go.

    Scores of a tile are formed in single precision; those not below a user's bound by more than their rounding
    error are formed again in double precision, so that lists are those of exact scores.
    """

    def __init__(self, users: pa.Table, keep: int):
        self.names, self.keep, self.x = users["user_id"].combine_chunks(), keep, _matrix(users["features"])
        seen = users["seen"].combine_chunks()
        self.seen, self.of = seen.flatten(), np.repeat(np.arange(len(users)), pc.list_value_length(seen).to_numpy(zero_copy_only=False))
        self.length, self.bound = np.linalg.norm(self.x, axis=1), np.full(len(users), -np.inf)
        self.parts, self.new, self.kept = [], 0, 0

    def add(self, items: pa.Table) -> None:
        names, y = items["item_id"].combine_chunks(), _matrix(items["features"])
        longest = float(np.linalg.norm(y, axis=1).max())
        kind = np.float32 if max(1.0, self.length.max()) * max(1.0, longest) < 1e30 else np.float64
        error = (y.shape[1] + 8) * 2.0**-23 * longest * self.length + 2e-9
        narrow, at = y.astype(kind), pc.index_in(self.seen, value_set=names)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        row, column = self.of[known], pc.drop_null(at).to_numpy()
        step = max(1, (1 << 23) // len(y))
        for low in range(0, len(self.x), step):
            part = self.x[low : low + step].astype(kind) @ narrow.T
            first, last = np.searchsorted(row, [low, low + step])
            part[row[first:last] - low, column[first:last]] = -np.inf
            own = slice(low, low + len(part))
            limit = self.bound[own] - error[own]
            open_ = np.flatnonzero(np.isneginf(limit))
            if len(open_) and self.keep < part.shape[1]:
                cut = part.shape[1] - self.keep
                limit[open_] = np.partition(part[open_], cut, axis=1)[:, cut] - 2 * error[own][open_]
            limit = np.nextafter(limit.astype(kind), kind(-np.inf))
            live = np.flatnonzero(part.max(axis=1) >= limit)
            r, c = np.nonzero(part[live] >= limit[live, None])
            r = live[r]
            good = np.isfinite(part[r, c])
            r, c = r[good] + low, c[good]
            if len(r):
                self.parts.append(pa.table({"r": r, "item_id": names.take(pa.array(c)), "score": np.einsum("ij,ij->i", self.x[r], y[c])}))
                self.new += len(r)
                if self.new > max(self.kept, 1 << 18):
                    self.settle()
        self.settle()

    def settle(self) -> None:
        """Keeps the best, and takes the worst of a full list as its user's bound."""
        if not self.new:
            return
        whole = pa.concat_tables(self.parts).combine_chunks()
        whole = whole.append_column("s", pa.array(np.round(whole["score"].to_numpy(), 9)))
        whole = whole.take(pc.sort_indices(whole, sort_keys=[("r", "ascending"), ("s", "descending"), ("item_id", "ascending")]))
        r = whole["r"].to_numpy()
        place = np.arange(len(r)) - np.searchsorted(r, r)
        full = place == self.keep - 1
        self.bound[r[full]] = whole["score"].to_numpy()[full]
        self.parts, self.new = [whole.filter(pa.array(place < self.keep)).drop_columns("s")], 0
        self.kept = len(self.parts[0])

    def result(self) -> list[pa.RecordBatch]:
        if not self.parts:
            return []
        whole = self.parts[0]
        return pa.table({"user_id": self.names.take(whole["r"].combine_chunks()), "item_id": whole["item_id"], "score": whole["score"]}).to_batches(max_chunksize=1 << 16)


def best_products(users: DataFrame, items: DataFrame, keep: int) -> DataFrame:
    """(user_id, item_id, score): the ``keep`` items outside ``seen`` with the greatest inner products for each user, ties by item.

    Each task holds a block of users and reads all items from storage as a stream, so nothing is
    shuffled or broadcast, and a user's list is formed in one place.
    """
    spark = users.sparkSession
    ship(spark)
    kinds = dict(users.dtypes) | dict(items.dtypes)
    columns = ["user_id", "item_id", "features", "seen", "n"]

    def stream(batches):
        held, waiting, lists, size = [], [], None, FIRST_ITEMS
        for batch in batches:
            is_item = pc.is_valid(batch.column("item_id"))
            if (some := batch.filter(pc.invert(is_item))).num_rows:
                held.append(some)
            if (some := batch.filter(is_item)).num_rows:
                waiting.append(some)
            if lists is None and held and sum(b.num_rows for b in held) == held[0].column("n")[0].as_py():
                lists, held = _Lists(pa.Table.from_batches(held), keep), []
            if lists is not None and sum(b.num_rows for b in waiting) >= size:
                lists.add(pa.Table.from_batches(waiting))
                waiting, size = [], STREAM_ITEMS
        if lists is None:
            raise RuntimeError("users of a block are missing")
        if waiting:
            lists.add(pa.Table.from_batches(waiting))
        yield from lists.result()

    n, cores = users.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / STREAM_USERS), min(cores, n // 256))
    blocks = blocks if blocks <= cores else cores * math.ceil(blocks / cores)
    dealt = users.withColumn("block", F.pmod(F.xxhash64("user_id"), F.lit(blocks))).repartition(blocks, "block").sortWithinPartitions("block")
    dealt = stored(dealt, "users")
    free_shuffles(spark)
    sized = {r["block"]: r["n"] for r in dealt.groupBy("block").agg(F.count("*").alias("n")).collect()}
    if not sized:
        return spark.createDataFrame([], f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double")
    every = items.select(F.lit(None).cast(kinds["user_id"]).alias("user_id"), "item_id", "features", F.lit(None).cast(kinds["seen"]).alias("seen"), F.lit(None).cast("long").alias("n"))
    streams = []
    for block, size in sorted(sized.items()):
        own = dealt.where(F.col("block") == block).withColumn("item_id", F.lit(None).cast(kinds["item_id"])).withColumn("n", F.lit(size).cast("long"))
        streams.append(own.select(columns).union(every).coalesce(1))
    # Spark would make one task of a union of single partitions, unless told not to
    before = spark.conf.get(_ONE_TASK, None)
    spark.conf.set(_ONE_TASK, "false")
    try:
        return stored(reduce(DataFrame.union, streams).mapInArrow(stream, f"user_id {kinds['user_id']}, item_id {kinds['item_id']}, score double"), "best")
    finally:
        spark.conf.unset(_ONE_TASK) if before is None else spark.conf.set(_ONE_TASK, before)


def summed_vectors(lists: DataFrame, items: DataFrame) -> DataFrame:
    """(user_id, n, length, features) of ``lists(user_id, item_id)``: how many listed items ``items`` holds, and the
    sum of their squared lengths and of their vectors. Ids meet the vectors in tiles, so that only sums are shuffled by user.
    """
    ship(lists.sparkSession)
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("features")), F.lit(1)).alias("width")).first()
    side = max(1, SIDE_BYTES // (8 * max(1, size.width)))
    kind = dict(lists.dtypes)["user_id"]
    u, i = _dealt(lists, items, lists.select("user_id").distinct().count(), side, size.n, side)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("user_id", left.schema.field("user_id").type), ("n", pa.int64()), ("length", pa.float64()), ("features", pa.list_(pa.float64()))])
        if not len(left) or not len(right):
            return schema.empty_table()
        at = pc.index_in(left["item_id"].combine_chunks(), value_set=right["item_id"].combine_chunks())
        left = left.filter(pc.is_valid(at))
        if not len(left):
            return schema.empty_table()
        y, at = _matrix(right["features"]), pc.drop_null(at).to_numpy()
        users = left["user_id"].combine_chunks().dictionary_encode()
        code = users.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(len(users.dictionary)))
        length = np.add.reduceat((y * y).sum(1)[at[order]], starts)
        total = np.column_stack([np.add.reduceat(y[:, j][at[order]], starts) for j in range(y.shape[1])])
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * y.shape[1]), pa.array(total.ravel()))
        return pa.table([users.dictionary, pa.array(np.bincount(code).astype(np.int64)), pa.array(length), flat], schema=schema)

    parts = u.groupBy("block", "tile").cogroup(i.groupBy("block", "tile")).applyInArrow(add, f"user_id {kind}, n long, length double, features array<double>")
    sums = parts.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.collect_list("features").alias("f"))
    # one vector a tile; the first is not added to an empty one
    total = F.reduce(F.slice("f", 2, size.n + 1), F.col("f")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return sums.select("user_id", "n", "length", total.alias("features"))

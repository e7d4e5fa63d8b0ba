"""N-gram Jaccard join: prefix filters find regions, pivots and the triangle inequality join them.

Jaccard distance is a metric, so a pivot's distances bound those between other documents.
Pivots alone do not help where nearly all documents are at distance 1 from each other, as
in a corpus. Regions therefore start as the connected parts of a graph that holds every
possible link (by an exact prefix filter, rarest shingles first). A region beyond a task's
size is cut by pivots into Voronoi cells with windows for boundary documents, in rounds of
distributed jobs; smaller ones are cut in the same way in memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import byte_slices, components, default_parts, discard, free_shuffles, released, sorted_join, stored
from cadenza.llm.shingles import mixed, shingle_sets

#: Links have 100 * intersection >= SHARE * union.
SHARE = 75
BATCH_BYTES = 1 << 20
#: Share of a set, in hundredths, that the first filter reads beyond the shortest prefix.
EXTRA = 10
#: Shingles of a region that one task joins in memory; larger regions are cut by pivots over many tasks.
REGION_SHINGLES = 1 << 15
#: Region size up to which documents are compared directly, and pivots of a larger one.
LEAF, PIVOTS = 64, 12
#: Pivots of a region in a distributed round, and the share of it beyond which a cell is not cut again.
ROUND_PIVOTS, DENSE = 8, 0.7
#: Shingles of a share or block of members that pivots don't cut; each share meets the blocks of fitting sizes.
DENSE_SHINGLES = 1 << 19
#: Bits of the filter of surviving sets: 16 a set, within these bounds (8 KB to 16 MB).
LEAST_FILTER, MOST_FILTER = 16, 27
_KEY = (1 << 40) - 1


def _least_shared(n):
    """Fewest shingles that a set of n shares with any partner: ceil(n * SHARE / 100)."""
    return -(-n * SHARE // 100)


def _extra(n):
    return n * EXTRA // 100 + 1


def _size_class(n: np.ndarray) -> np.ndarray:
    """Sizes on a scale of 2 %, so that they fit ten bits; see ``_classes_apart``."""
    return np.minimum(1000, np.floor(np.log(np.maximum(n, 1)) / np.log(1.02))).astype(np.int64)


def _classes_apart() -> int:
    return int(np.ceil(np.log(100 / SHARE) / np.log(1.02))) + 1


def _band(n):
    """Linked sets lie in the same or neighbouring bands of size: a little wider than the threshold, for rounding."""
    return F.floor(F.log(n) / float(np.log(100 / (SHARE - 1))))


def _key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k) of every row of ``docs(doc_id, text)``: set size, and the set's 63-bit hash."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k", pa.int64())])

    def run(batches):
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), "doc_id long, n long, k long")


def _shared(s: np.ndarray, v: np.ndarray, apart: int) -> np.ndarray:
    """Of entries sorted by (shingle, word): whether a neighbour has the same shingle and a fitting size."""
    near = (s[1:] == s[:-1]) & ((v[1:] >> 40) - (v[:-1] >> 40) <= apart)
    shared = np.zeros(len(s), bool)
    shared[1:] |= near
    shared[:-1] |= near
    return shared


def _survivor_keys(docs: DataFrame, parts: int) -> DataFrame:
    """(key40, c) of sets that may have a partner: at least so many shared prefix shingles.

    Order each set by hash. If two sets link, the first n - ceil(0.75 n) + t(n) of each,
    with t(n) = ``_extra(n)``, share at least t of the smaller set. So a set whose prefix
    has fewer than t(ceil(0.75 n)) shingles in common with any set of a fitting size has
    no partner. Only 64-bit hashes and 50-bit (size class, key) words are shuffled; equal
    sets of a task are sent once. A shortened key that two sets share keeps both.

    What a task can settle it settles before the shuffle: entries whose shingle another
    fitting set of the same batch has are counted there, and one entry for each size class
    goes on in their name (key 0), so a shingle of very many sets is no hot key. Counting
    an entry twice, here and after the shuffle, only keeps more sets; the join is exact.
    """
    apart = _classes_apart()

    def rows(s, v, c):
        return pa.record_batch([pa.array(s.view(np.int64)), pa.array(v), pa.array(c.astype(np.int32))], names=["s", "v", "c"])

    def emit(batches):
        seen: set[int] = set()
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            out, names = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for s in shingle_sets(batch.column("text")):
                n, k = len(s), _key(s)
                if n and k not in seen:
                    seen.add(k)
                    out.append(s[: n - _least_shared(n) + _extra(n)])
                    names.append(np.full(len(out[-1]), int(_size_class(np.array([n]))[0]) << 40 | max(k & _KEY, 1)))
            s, v = np.concatenate(out), np.concatenate(names)
            order = np.lexsort((v, s))
            s, v = s[order], v[order]
            shared = _shared(s, v, apart)
            keys, n = np.unique(v[shared], return_counts=True)
            yield rows(mixed(keys.view(np.uint64)), keys, n)
            v = np.where(shared, v & ~_KEY, v)
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
            yield rows(s[fresh], v[fresh], np.zeros(int(fresh.sum())))

    def count(batches):
        last, told = None, False
        for batch in batches:
            s, v, c = (batch.column(x).to_numpy() for x in ("s", "v", "c"))
            known = c > 0
            if known.any():
                yield pa.record_batch([pa.array(v[known]), pa.array(c[known])], names=["v", "c"])
            s, v = s[~known], v[~known]
            if not len(s):
                continue
            if last is not None:
                s, v = np.concatenate([[last[0]], s]), np.concatenate([[last[1]], v])
            fresh = np.ones(len(s), bool)
            fresh[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
            s, v = s[fresh], v[fresh]
            shared = _shared(s, v, apart)
            ending = shared[-1]
            if last is not None:
                ending = ending or (len(s) == 1 and told)
                shared[0] &= not told
            last, told = (s[-1], v[-1]), bool(ending)
            keys, n = np.unique(v[shared & (v & _KEY > 0)], return_counts=True)
            yield pa.record_batch([pa.array(keys), pa.array(n.astype(np.int32))], names=["v", "c"])

    entries = docs.select("text").mapInArrow(released(emit), "s long, v long, c int").repartition(parts, "s").sortWithinPartitions("s", "v")
    # a set's entries lie in different tasks, so there is nothing to combine before this shuffle
    counts = entries.mapInArrow(released(count), "v long, c int").repartition(parts, "v").groupBy("v").agg(F.sum("c").alias("c"))
    return counts.select(F.col("v").bitwiseAND(F.lit(_KEY)).alias("key40"), "c")


def surviving_sets(docs: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """(k, n, s binary): the sets, one of each, that ``_survivor_keys`` can't rule out.

    Only the document of least id in each surviving class is read as shingles again. A bitmap of
    those ids and of the survivors' keys, 16 MB at most, goes to all tasks to spare the other
    texts the work and the shuffle; it is only a filter, and the join after it is exact.
    """
    n = F.col("n")
    smaller = F.floor((n * SHARE + 99) / 100)
    counts = _survivor_keys(docs, parts)
    keyed = classes.select("k", "n", "least", F.greatest(F.col("k").bitwiseAND(F.lit(_KEY)), F.lit(1)).alias("key40")).join(sorted_join(counts), "key40")
    keep = keyed.groupBy("k", "n", "least").agg(F.sum("c").alias("c")).where(F.col("c") >= F.floor(smaller * EXTRA / 100) + 1)
    keep = stored(keep.select("k", "n", "least"), "jaccard-keep")
    del counts, keyed
    free_shuffles(docs.sparkSession)
    size = 1 << min(MOST_FILTER, max(LEAST_FILTER, (16 * keep.count()).bit_length()))

    def place(id_col):
        return F.pmod(F.xxhash64(id_col), F.lit(size).cast("long"))

    slots = keep.select(F.explode(F.array(place("least"), F.col("k") % size)).alias("slot")).select((F.col("slot") + 1).alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m"))
    packed = np.zeros(size // 8, np.uint8)
    for r in bits.toLocalIterator():  # 4 KB of the bitmap each
        packed[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(bytes(r.m), np.uint8)

    def chosen(batches):
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((packed[slot >> 3] >> (slot & 7) & 1).astype(bool)))

    def emit(batches):
        seen: set[int] = set()
        for batch in byte_slices(chosen(batches), "text", BATCH_BYTES):
            sets = [(_key(s), s) for s in shingle_sets(batch.column("text")) if len(s)]
            sets = {k: s for k, s in sets if packed[k % size >> 3] >> (k % size & 7) & 1 and k not in seen}
            seen.update(sets)
            yield pa.record_batch([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["k", "s"])

    sets = docs.select("text", place("doc_id").alias("slot")).mapInArrow(released(emit), "k long, s binary")
    return sets.join(sorted_join(keep.select("k", "n")), "k").groupBy("k").agg(F.first("n").alias("n"), F.first("s").alias("s"))


def candidate_edges(sets: DataFrame, parts: int) -> DataFrame:
    """(a, b): a graph whose connected parts hold every link between ``sets(k, n, s)``.

    Shingles are ordered by how many sets hold them, rarest first, then by hash. Linked
    sets share a shingle within their first n - ceil(0.75 n) + 1. Sets less than 75 % of
    whose shingles occur elsewhere have no link. Sets that share a prefix shingle and lie in
    the same or neighbouring bands of size are joined with the least of them: an edge a
    member, not all pairs, by sums that combine before the shuffle.
    """

    def explode(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                arrays = [np.frombuffer(s, np.int64) for s in part.column("s").to_pylist()]
                lens = [len(x) for x in arrays]
                flat = np.concatenate([np.empty(0, np.int64), *arrays])
                yield pa.record_batch([pa.array(flat), pa.array(np.repeat(part.column("n").to_numpy(), lens)), pa.array(np.repeat(part.column("k").to_numpy(), lens))], names=["s", "n", "k"])

    rows = sets.select("k", "n", "s").mapInArrow(released(explode), "s long, n long, k long")
    often = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    seen = rows.join(sorted_join(often), "s")
    order = Window.partitionBy("k").orderBy("df", "s")
    n, m = F.col("n"), F.col("m")
    ranked = seen.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy("k")))
    least = F.floor((n * SHARE + 99) / 100)
    prefix = ranked.where((m >= least) & (F.col("rank") <= (n - least + 1) - (n - m)))
    # written, so that the shuffles of all shingles are gone before those of the prefixes come
    prefix = stored(prefix.select("s", "k", _band(n).alias("band")), "jaccard-prefix")
    del rows, often, seen, ranked
    free_shuffles(sets.sparkSession)
    placed = prefix.select("s", "k", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    hubs = placed.groupBy("s", "band").agg(F.min("k").alias("b"))
    edges = stored(placed.join(sorted_join(hubs), ["s", "band"]).where("k <> b").select(F.col("k").alias("a"), "b").distinct(), "jaccard-edges")
    discard(prefix)
    return edges


class Region:
    """Sets of one region, joined in memory; ``label`` maps each to the least index that it is linked with."""

    def __init__(self, sets: list[np.ndarray], inside: np.ndarray | None = None):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.label = np.arange(len(sets))
        if inside is not None and inside.any():  # linked with one pivot, so with each other
            self.label[inside] = np.flatnonzero(inside)[0]
        self.mark = np.zeros(int(self.flat.max(initial=-1)) + 1, bool)

    def shared(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pivot's set with those of ``rows``."""
        self.mark[self.flat[self.starts[pivot] : self.ends[pivot]]] = True
        lens = self.sizes[rows]
        ends = np.cumsum(lens)
        at = np.repeat(self.starts[rows] - (ends - lens), lens) + np.arange(int(ends[-1]) if len(ends) else 0)
        sums = np.concatenate([[0], np.cumsum(self.mark[self.flat[at]])])
        self.mark[self.flat[self.starts[pivot] : self.ends[pivot]]] = False
        return sums[ends] - sums[ends - lens]

    def root(self, i: int) -> int:
        while self.label[i] != i:
            i = self.label[i]
        return i

    def roots(self, rows: np.ndarray) -> np.ndarray:
        while (self.label[self.label] != self.label).any():
            self.label = self.label[self.label]
        return self.label[rows]

    def link(self, pivot: int, rows: np.ndarray) -> np.ndarray:
        """Compare the pivot with ``rows``, note links, and return the distances."""
        shared = self.shared(pivot, rows)
        union = self.sizes[pivot] + self.sizes[rows] - shared
        for r in np.unique(self.roots(rows[100 * shared >= SHARE * union])).tolist():
            a, b = self.root(pivot), self.root(r)
            self.label[max(a, b)] = min(a, b)
        return 1 - shared / union

    def join(self, rows: np.ndarray) -> None:
        """Find all links among ``rows``, but for those within a known component.

        With pivots p and radius r, a pair within r whose first member is nearest to p
        has its second member x at d(p, x) <= d(nearest(x), x) + 2 r: the window in
        which x is copied to p's cell. Cells are joined recursively; where pivots don't
        part a region, its documents are compared one against the rest.
        """
        found = self.roots(rows)
        if len(rows) < 2 or (found == found[0]).all():
            return
        if len(rows) <= LEAF:
            self.directly(rows)
            return
        near, pivots, dist = np.full(len(rows), np.inf), [], []
        nxt = int(np.argmax(self.sizes[rows]))
        while len(pivots) < PIVOTS:
            pivots.append(nxt)
            dist.append(self.link(rows[nxt], rows))
            near = np.minimum(near, dist[-1])
            nxt = int(np.argmax(near))
            if near[nxt] <= 0:
                break
        d = np.array(dist)
        reach = d <= near + 2 * (1 - SHARE / 100) + 1e-9
        cells = [rows[reach[i] ] for i in range(len(pivots)) if (d[i] == near).any()]
        if max(map(len, cells)) > 0.7 * len(rows):
            self.directly(rows)
            return
        for cell in cells:
            self.join(cell)

    def directly(self, rows: np.ndarray) -> None:
        """One against the rest, leaving out partners in the same component or of unfit size."""
        rows = rows[np.argsort(self.sizes[rows], kind="stable")]
        for i in range(len(rows) - 1):
            upto = int(np.searchsorted(self.sizes[rows], self.sizes[rows[i]] * 100 // SHARE, "right"))
            rest = rows[i + 1 : upto]
            rest = rest[self.roots(rest) != self.root(rows[i])]
            if len(rest):
                self.link(rows[i], rest)


def _sets(table: pa.Table, column: str = "s") -> list[np.ndarray]:
    return [np.frombuffer(s, np.uint64) for s in table[column].to_pylist()]


def _split(pivots: pa.Table, members: pa.Table) -> pa.Table:
    """Members of one share of a region, once for each cell in whose window they are: (region, cell, p, k, n, inside).

    ``inside`` tells of a link with the cell's pivot p; the triangle inequality puts both ends of
    every other link into the cell that is nearest to one of them.
    """
    order = np.argsort(members["k"].to_numpy())
    members = members.take(pa.array(order))
    names = pivots["p"].to_numpy()
    by_name = np.argsort(names)
    region = Region(_sets(pivots.take(pa.array(by_name)), "t") + _sets(members))
    rows = np.arange(len(names), len(names) + len(members))
    shared = np.array([region.shared(i, rows) for i in range(len(names))])
    union = region.sizes[: len(names), None] + region.sizes[rows] - shared
    distance = 1 - shared / union
    cell, row = np.nonzero(distance <= distance.min(0) + 2 * (1 - SHARE / 100) + 1e-9)
    inside = 100 * shared[cell, row] >= SHARE * union[cell, row]
    out = members.select(["region", "k", "n"]).take(pa.array(row))
    return pa.table([out["region"], pivots["cell"].take(pa.array(by_name[cell])), pa.array(names[by_name[cell]]), out["k"], out["n"], pa.array(inside)], names=["region", "cell", "p", "k", "n", "inside"])


def _cut(regions: DataFrame, sizes: DataFrame) -> DataFrame:
    """(region, cell, p, k, n, inside): ``regions(region, k, n, s)`` cut by pivots; the sets themselves are not copied.

    Pivots are the members of least hash, for several hashes. A region is dealt to shares of
    ``REGION_SHINGLES`` by a hash of its members; its few pivots go to all its shares.
    """
    least = F.array(*[F.min(F.struct(F.xxhash64("region", "k", F.lit(j)), "k"))["k"] for j in range(ROUND_PIVOTS)])
    chosen = regions.groupBy("region").agg(F.array_distinct(least).alias("p")).select("region", F.explode("p").alias("k"))
    pivots = regions.select("region", "k", "s").join(chosen, ["region", "k"]).select("region", F.col("k").alias("p"), F.col("s").alias("t"), F.xxhash64("region", "k").alias("cell"))
    shares = sizes.select("region", F.ceil(F.col("shingles") / REGION_SHINGLES).cast("int").alias("shares"))
    dealt = regions.join(shares, "region").select("region", F.pmod(F.xxhash64("k"), "shares").cast("int").alias("share"), "k", "n", "s")
    everywhere = pivots.join(shares, "region").select(F.col("region").alias("of"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("at"), "cell", "p", "t")
    return everywhere.groupBy("of", "at").cogroup(dealt.groupBy("region", "share")).applyInArrow(_split, "region long, cell long, p long, k long, n long, inside boolean")


def _inside_links(table: pa.Table) -> pa.Table:
    """(a, b): a spanning forest of the links within a region that one task holds."""
    k = table["k"].to_numpy()
    order = np.argsort(k)
    table, k = table.take(pa.array(order)), k[order]
    region = Region(_sets(table), table["inside"].to_numpy().astype(bool))
    first = region.label.copy()
    region.join(np.arange(len(k)))
    return _forest(region, k, first)


def _forest(region: Region, k: np.ndarray, first: np.ndarray) -> pa.Table:
    """Edges (a, b) that ``region`` found since its labels were ``first``."""
    root = region.roots(np.arange(len(k)))
    new = root != first
    return pa.table({"a": k[new], "b": k[root[new]]})


def _dense_links(cells: DataFrame) -> DataFrame:
    """(a, b): the links within ``cells(region, k, n, s, inside)`` that pivots don't cut further.

    Members linked with the pivot are one component already, so only pairs with a member
    outside it are compared: members are dealt to shares, and outsiders, in blocks, meet those
    whose sizes fit. A group of near copies has few outsiders, however large it is, and a
    region of one share is sent once; beyond that it is dealt by bands of size.
    """
    rows = cells.select("region", "k", "n", "inside")
    whole = rows.groupBy("region").agg((F.sum("n") > DENSE_SHINGLES).alias("several"))
    band = F.when(F.col("several"), _band(F.col("n"))).otherwise(F.lit(0)).cast("long").alias("band")
    banded = rows.join(whole, "region").select("region", band, "n", "inside")
    parts = lambda c: F.ceil(F.sum(c) / DENSE_SHINGLES).cast("int")
    plan = stored(banded.groupBy("region", "band").agg(parts(F.col("n")).alias("shares"), parts(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("blocks")), "jaccard-plan")
    both = cells.join(whole, "region").select("region", band, "k", "s", "inside").join(plan, ["region", "band"])
    meets = plan.select("region", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.col("band").alias("other"), F.col("shares").alias("their_shares"), F.col("blocks").alias("their_blocks"))
    placed = both.select("region", "band", F.pmod(F.xxhash64("k"), "shares").cast("int").alias("i"), "k", "s", "inside").join(meets.where("their_blocks > 0").drop("their_shares"), ["region", "band"])
    left = placed.select("region", "band", "i", "other", F.explode(F.sequence(F.lit(0), F.col("their_blocks") - 1)).alias("j"), "k", "s", "inside")
    outside = both.where("not inside").select("region", "band", F.pmod(F.xxhash64("k"), "blocks").cast("int").alias("y"), F.col("k").alias("o"), F.col("s").alias("t")).join(meets.drop("their_blocks"), ["region", "band"])
    others = outside.select(F.col("region").alias("of"), F.col("other").alias("their"), F.explode(F.sequence(F.lit(0), F.col("their_shares") - 1)).alias("x"), F.col("band").alias("own"), "y", "o", "t")

    def compare(members: pa.Table, outsiders: pa.Table) -> pa.Table:
        if not len(members) or not len(outsiders):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        k = np.concatenate([members["k"].to_numpy(), outsiders["o"].to_numpy()])
        known = np.concatenate([members["inside"].to_numpy().astype(bool), np.zeros(len(outsiders), bool)])
        region = Region(_sets(members) + _sets(outsiders, "t"), known)
        first = region.label.copy()
        rows = np.argsort(region.sizes[: len(members)], kind="stable")
        sizes = region.sizes[rows]
        for i in range(len(members), len(k)):
            low, high = np.searchsorted(sizes, [_least_shared(int(region.sizes[i])), region.sizes[i] * 100 // SHARE + 1])
            rest = rows[low:high]
            rest = rest[(region.roots(rest) != region.root(i)) & (k[rest] != k[i])]
            if len(rest):
                region.link(i, rest)
        return _forest(region, k, first)

    return left.groupBy("region", "band", "i", "other", "j").cogroup(others.groupBy("of", "their", "x", "own", "y")).applyInArrow(compare, "a long, b long")


def _uncut(large: DataFrame, cells: DataFrame, dense: DataFrame) -> DataFrame:
    """(region, k, n, s, inside): the members of ``dense`` cells, once for each region that they were cut from.

    Where pivots don't part a region, each of its cells holds nearly all of it, so they are
    taken together; ``inside`` tells of a link with the pivot that is linked with most.
    """
    own = cells.join(dense.select(F.col("region").alias("cell")), "cell", "left_semi")
    tied = own.where("inside").groupBy("region", "cell").agg(F.sum("n").alias("tied"))
    best = tied.groupBy("region").agg(F.max(F.struct("tied", "cell"))["cell"].alias("best"))
    members = own.join(best, "region").groupBy("region", "k").agg(F.bool_or(F.col("inside") & (F.col("cell") == F.col("best"))).alias("inside"))
    return large.join(sorted_join(members), ["region", "k"]).select("region", "k", "n", "s", "inside")


def region_links(placed: DataFrame) -> DataFrame:
    """(a, b): edges whose components are those of all links within ``placed(region, k, n, s)``.

    Regions that a task can hold are joined in memory. Larger ones are cut by pivots, round
    by round; cells that keep most of their region are compared as one, outsiders of
    a pivot against all.
    """
    spark = placed.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    cur = placed.withColumn("inside", F.lit(False))
    while True:
        sizes = stored(cur.groupBy("region").agg(F.sum("n").alias("shingles"), F.bool_and("inside").alias("done")).where("not done").drop("done"), "jaccard-sizes")
        small, big = sizes.where(F.col("shingles") <= REGION_SHINGLES), sizes.where(F.col("shingles") > REGION_SHINGLES)
        own = cur.join(small.select("region"), "region", "left_semi")
        links = links.union(stored(own.groupBy("region").applyInArrow(_inside_links, "a long, b long"), "jaccard-found"))
        if big.isEmpty():
            return links
        large = cur.join(big.select("region"), "region", "left_semi").select("region", "k", "n", "s")
        above = large.select("region", F.col("k").alias("p")).join(big, "region").select(F.xxhash64("region", "p").alias("cell"), F.col("shingles").alias("whole"))
        cells = stored(_cut(large, big), "jaccard-cells")
        links = links.union(stored(cells.where("inside and k <> p").select(F.col("k").alias("a"), F.col("p").alias("b")), "jaccard-tied"))
        found = cells.groupBy(F.col("cell").alias("region")).agg(F.sum("n").alias("shingles"), F.bool_and("inside").alias("done")).where("not done")
        judged = stored(found.join(above.withColumnRenamed("cell", "region"), "region"), "jaccard-judged")
        dense = judged.where((F.col("shingles") > DENSE * F.col("whole")) & (F.col("shingles") > REGION_SHINGLES))
        uncut = stored(_uncut(large, cells, dense), "jaccard-uncut")
        links = links.union(stored(_dense_links(uncut), "jaccard-dense"))
        discard(uncut)
        again = cells.join(judged.join(dense, "region", "left_anti").select(F.col("region").alias("cell")), "cell", "left_semi")
        del cur
        cur = stored(again.select("region", "cell", "k", "inside").join(sorted_join(large), ["region", "k"]).select(F.col("cell").alias("region"), "k", "n", "s", "inside"), "jaccard-again")
        discard(cells)
        del large, above, cells, found, judged, dense, uncut, again, own
        free_shuffles(spark)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``.

    Two documents link when 100 * intersection >= 75 * union of their sets of distinct
    five-word shingles; a component is named by its smallest doc_id. Documents without
    words link with nothing. Equal sets are one class. A null text has no words; a row
    with a null id is returned with a null component and links nothing; repeated rows are
    linked copies; other columns are ignored; an empty table gives no rows. A very long text
    is one set. Shingles are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    parts = default_parts(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    light = stored(set_table(docs), "jaccard-light")
    classes = light.where("n > 0 and doc_id is not null").groupBy("k", "n").agg(F.min("doc_id").alias("least"))
    classes = stored(classes, "jaccard-classes")
    named = docs.where("doc_id is not null")
    sets = stored(surviving_sets(named, classes, parts), "jaccard-sets")
    free_shuffles(spark)
    edges = candidate_edges(sets, parts)
    free_shuffles(spark)
    regions = components(edges, "jaccard-regions").select(F.col("node").alias("k"), F.col("component").alias("region"))
    placed = stored(sets.join(sorted_join(regions), "k").select("region", "k", "n", "s"), "jaccard-placed")
    discard(sets)
    discard(edges)
    free_shuffles(spark)
    joined = components(region_links(placed), "jaccard-links")
    labelled = classes.join(sorted_join(joined), F.col("k") == F.col("node"), "left").select("k", "n", "least", F.coalesce("component", "k").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = stored(labelled.join(sorted_join(lowest), "root").select("k", "n", "component_id"), "jaccard-labels")
    discard(placed)
    out = light.join(sorted_join(by_class), ["k", "n"], "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id, then of the least hash of its text.

    Works on rows, so repeated and null ids are told apart; null ids come last, and of equal
    rows the first of the scan stays. Rows without words are kept. All columns, whatever
    their names, are returned as they are. ``docs`` must give the same rows in the same
    partitions when read twice, as a table scan does.
    """
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("row"))
    id_, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    found = jaccard_components(rows.select(F.col("row").alias("doc_id"), F.col(text).alias("text"))).select(F.col("doc_id").alias("row"), F.col("component_id").alias("of"))
    several = stored(found.join(found.groupBy("of").agg(F.count("*").alias("size")).where("size > 1").select("of"), "of"), "jaccard-groups")
    order = F.struct(F.col(id_).isNull(), F.col(id_).cast("long"), F.xxhash64(text), "row")
    first = rows.join(several, "row").groupBy("of").agg(F.min(order)["row"].alias("row"))
    dropped = stored(several.join(first, ["of", "row"], "left_anti").select("row"), "jaccard-dropped")
    return rows.join(dropped, "row", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at Jaccard 0.75 of five-word shingles."""
    from cadenza.llm.common import table

    return jaccard_components(table(spark, sf_dir, "documents"))

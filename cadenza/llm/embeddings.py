"""Embedding near-duplicates: PCA-ordered tiled comparison with suffix-norm bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import components, stored

#: Rows that PCA and the group bounds are fitted on, in hash order; any fit gives the same links.
FIT_ROWS = 4096
#: Vectors in a group, and in a tile of a task.
GROUP_ROWS, TILE = 8192, 1024
#: Slack of the bounds against rounding; links themselves are decided in double precision.
SLACK = 1e-6


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union the rows i and j in ``label`` (row -> smallest row of its set), in place."""
    while True:
        while (up := label[label] != label).any():
            label[up] = label[label[up]]
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def tile_links(rot_a, rot_b, raw_a, raw_b, tail_a, tail_b, steps, threshold, same):
    """Index pairs of two tiles with cosine of at least ``threshold``.

    Products of the leading dimensions are accumulated block by block. What the rest can
    add is at most the product of the suffix norms, so a pair is dropped as soon as that
    bound is below the threshold; survivors are decided on the raw vectors.
    """
    first = steps[0]
    part = rot_a[:, :first] @ rot_b[:, :first].T
    alive = part + np.outer(tail_a[0], tail_b[0]) >= threshold - SLACK
    if same:
        alive &= np.tri(len(rot_a), len(rot_b), -1, dtype=bool).T
    i, j = np.nonzero(alive)
    done, got = first, part[i, j]
    for k, upto in enumerate(steps[1:], 1):
        if not len(i):
            break
        got = got + np.einsum("ij,ij->i", rot_a[i, done:upto], rot_b[j, done:upto])
        alive = got + tail_a[k][i] * tail_b[k][j] >= threshold - SLACK
        i, j, got, done = i[alive], j[alive], got[alive], upto
    x, y = raw_a[i], raw_b[j]  # scaled by powers of two, which changes no cosine
    cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
    return i[cosine >= threshold], j[cosine >= threshold]


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows scaled by a power of two to components of at most 1, so that no product overflows."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(1, keepdims=True))[1])


def _same(v) -> F.Column:
    """128 bits that stand for a vector."""
    return F.struct(F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2"))


def _linkable(v) -> F.Column:
    """Whether a vector has finite components only, and one that is not 0."""
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0)


def embedding_links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, links, edges) of all vectors by cosine.

    Equal vectors are collapsed first: ``classes`` has (rep, same, least, w, v): a number, 128
    bits by which rows find their class, the least id and the number of copies. ``links`` has
    (rep, n), the vectors linked to a class outside it. ``edges`` has (a, b), a spanning
    forest of the links, so that a dense group gives as many rows as it has members and not
    all its pairs.

    Vectors are rotated to principal axes and dealt to groups by ranges of the leading
    coordinate. A pair of groups is one task of at most two groups' rows; pairs whose
    ranges are farther apart than the threshold allows are never formed. In a task,
    tiles are compared by ``tile_links``. Vectors that are null, zero or hold null or
    non-finite components, and rows without an id, are left out. Vectors of another
    length than the most frequent one link among their own length only.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    clean = clean.where(F.col("id").isNotNull() & _linkable(F.col("v")))
    once = clean.groupBy(_same(F.col("v")).alias("same")).agg(F.min("id").alias("least"), F.count("*").alias("w"), F.first("v").alias("v"))
    classes = stored(once.withColumn("rep", F.monotonically_increasing_id()).select("rep", "same", "least", "w", "v", F.size("v").alias("dim")), "vector-classes")
    by_dim = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    spark = vectors.sparkSession
    links = edges = None
    for dim, n in sorted(by_dim.items()):
        found = _links_of(classes.where(F.col("dim") == dim), dim, n, threshold, group_rows)
        counts = found.where("b is null").select("a", "n")
        pairs = found.where("b is not null").select("a", "b")
        links = counts if links is None else links.union(counts)
        edges = pairs if edges is None else edges.union(pairs)
    links = spark.createDataFrame([], "a long, n long") if links is None else links
    edges = spark.createDataFrame([], "a long, b long") if edges is None else edges
    return classes, links.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep"), edges


def _links_of(classes: DataFrame, dim: int, n: int, threshold: float, group_rows: int) -> DataFrame:
    fit = classes.orderBy("same").limit(FIT_ROWS).select("v").collect()
    unit = np.array([r.v for r in fit], float).reshape(len(fit), dim)
    unit = _scaled(unit)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    axes = np.linalg.eigh(unit.T @ unit - len(unit) * np.outer(unit.mean(0), unit.mean(0)))[1][:, ::-1]
    groups = max(1, -(-n // group_rows))
    bounds = np.quantile(unit @ axes[:, 0], np.arange(1, groups) / groups)
    lows, highs = np.concatenate([[-np.inf], bounds]), np.concatenate([bounds, [np.inf]])
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    partners = [[b for b in range(groups) if max(lows[b] - highs[a], lows[a] - highs[b]) <= reach] for a in range(groups)]
    steps = sorted({min(dim, s) for s in (max(1, 3 * dim // 8), max(1, dim // 2), max(1, 3 * dim // 4), dim)})

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            scaled = _scaled(raw)
            lead = scaled / np.linalg.norm(scaled, axis=1, keepdims=True) @ axes[:, 0]
            low, high = np.searchsorted(bounds, lead, "left"), np.searchsorted(bounds, lead, "right")
            rep = batch.column("rep").to_numpy()
            group = low + rep % (high - low + 1)  # equal coordinates are dealt to all groups that they bound
            near = [partners[g] for g in group.tolist()]
            row = np.repeat(np.arange(len(near)), [len(p) for p in near])
            other = np.concatenate(near)
            mine = group[row]
            pair = np.minimum(mine, other) * groups + np.maximum(mine, other)
            rows = batch.select(["rep", "w", "v"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(mine), *rows.columns], names=["pair", "grp", "rep", "w", "v"])

    def compare(rows: pa.Table) -> pa.Table:
        rep, w = rows["rep"].to_numpy(), rows["w"].to_numpy()
        group = rows["grp"].to_numpy()
        order = np.lexsort((rep, group))
        rep, w, group = rep[order], w[order], group[order]
        raw = _scaled(rows["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim)[order])
        rotated = raw / np.linalg.norm(raw, axis=1, keepdims=True) @ axes
        tails = [np.sqrt(np.maximum(0, (rotated[:, s:] ** 2).sum(1))) for s in steps]
        label, count = np.arange(len(rep)), np.zeros(len(rep), np.int64)
        cut = int(np.searchsorted(group, group[0], "right"))
        one = cut == len(rep)
        left = [(s, min(s + TILE, cut)) for s in range(0, cut, TILE)]
        right = left if one else [(s, min(s + TILE, len(rep))) for s in range(cut, len(rep), TILE)]
        for a0, a1 in left:
            for b0, b1 in right:
                if one and b0 < a0:
                    continue
                i, j = tile_links(rotated[a0:a1], rotated[b0:b1], raw[a0:a1], raw[b0:b1], [t[a0:a1] for t in tails], [t[b0:b1] for t in tails], steps, threshold, one and a0 == b0)
                i, j = i + a0, j + b0
                np.add.at(count, i, w[j])
                np.add.at(count, j, w[i])
                _merge(label, i, j)
        linked, joined = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(rep)))
        a = np.concatenate([rep[linked], rep[joined]])
        b = pa.array(np.concatenate([np.zeros(len(linked), np.int64), rep[label[joined]]]), mask=np.arange(len(a)) < len(linked))
        return pa.table({"a": a, "b": b, "n": np.concatenate([count[linked], np.zeros(len(joined), np.int64)])})

    dealt = classes.select("rep", "w", "v").mapInArrow(deal, "pair long, grp long, rep long, w long, v array<double>")
    single = dealt.where(F.col("pair") % (groups + 1) == 0) if groups == 1 else dealt
    found = single.groupBy("pair").applyInArrow(compare, "a long, b long, n long")
    return stored(found, "vector-links")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Rows are the nodes: rows that repeat an id with other vectors have links of their own,
    and equal vectors, repeated rows among them, link with each other. A component has the
    least id in it. Null, zero and non-finite vectors, and rows without an id, link with
    nothing; a null id stays null and is not kept. Other columns are ignored; an empty
    table gives no rows.
    """
    classes, links, edges = embedding_links(vectors, threshold, id_col, vector_col)
    comp = components(edges)
    labelled = classes.select("rep", "same", "least", "w").join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    labelled = stored(labelled.select("same", "least", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("of")), "vector-result")
    lowest = labelled.groupBy("of").agg(F.min("least").alias("component_id"))
    by_class = labelled.join(lowest, "of").select("same", "n_links", "component_id")
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(F.col(f"`{id_col}`").isNotNull() & _linkable(v), _same(v)).alias("same"))
    out = rows.join(by_class, "same", "left")
    comp_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(comp_id == F.col("vec_id"), F.lit(False)).alias("kept"))


def op8_embeddings(spark, sf_dir: str, threshold: float = 0.9) -> DataFrame:
    """Links, component and kept flag of every vector at cosine 0.9."""
    from cadenza.llm.common import table

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold)


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.component_id = c.vec_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""

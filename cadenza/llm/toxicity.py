"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import byte_slices, in_fold, release, released, stored

#: Lengths of the character n-grams, and the bits of their hash.
SIZES, BITS = (3, 4, 5), 22
#: An n-gram gives a feature for each of these numbers of times that it occurs at least.
LEVELS = (1, 2, 3)
#: Bound of the fit: labelled rows, in hash order of their ids.
MAX_ROWS = 20_000
#: Least log-likelihood ratio between a feature and the label: a chance of one in a million.
LEAST_G2 = 24.0
#: Features of the sample that the fit works on at once.
BLOCK = 1 << 20
#: Bytes of text whose n-grams are held at once; a worker's arrays are about fifty times that.
BATCH_BYTES = 512 << 10


def ngram_buckets(texts: list[str], sizes=SIZES, bits: int = BITS):
    """Yield (document index, bucket) arrays of all lower-cased character n-grams, size by size.

    Code points are hashed by Horner's rule over whole batches; n-grams do not cross
    documents. Memory is a few times the batch's text.
    """
    lowered = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(lens), dtype=np.int32), lens)
    points[points == 10] = 32
    h, n = points.copy(), 1
    for size in range(2, max(sizes) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + points[size - 1 :]
        n = size
        if n in sizes:
            inside = owner[: len(h)] == owner[n - 1 :]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
            yield owner[: len(h)][inside], (mixed[inside] >> np.uint64(64 - bits)).astype(np.int64)


def _levels(owner: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature) pairs, each once: bucket * levels + level for each level that is reached."""
    both, n = np.unique(owner.astype(np.int64) << BITS | bucket, return_counts=True)
    parts = [(both[n >= least], k) for k, least in enumerate(LEVELS)]
    return np.concatenate([p >> BITS for p, _ in parts]), np.concatenate([(p & ((1 << BITS) - 1)) * len(LEVELS) + k for p, k in parts])


@dataclass
class ToxicityModel:
    """Weights of the kept features; ``score`` is 1 / (1 + exp(-(bias + sum of weights of features present)))."""

    features: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    bias: float

    def present(self, texts: list[str], place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document index, place of the feature) of the kept features in each text, each pair once."""
        place = self.place() if place is None else place
        wide = place.reshape(-1, len(LEVELS))
        used = (wide >= 0).any(1)
        docs, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for owner, bucket in ngram_buckets(texts):
            hit = used[bucket]
            doc, feature = _levels(owner[hit], bucket[hit])
            at = place[feature]
            docs.append(doc[at >= 0])
            found.append(at[at >= 0].astype(np.int64))
        doc, feature = np.concatenate(docs), np.concatenate(found)
        order = np.lexsort((feature, doc))
        doc, feature = doc[order], feature[order]
        fresh = np.ones(len(doc), bool)  # n-grams of two sizes may share a bucket
        fresh[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
        return doc[fresh], feature[fresh]

    def place(self) -> np.ndarray:
        place = np.full(len(LEVELS) << BITS, -1, np.int16 if len(self.features) < 1 << 15 else np.int32)
        place[self.features] = np.arange(len(self.features), dtype=place.dtype)
        return place

    def scores(self, texts: list[str], place: np.ndarray | None = None) -> np.ndarray:
        doc, feature = self.present(texts, place)
        total = self.bias + np.bincount(doc, (self.weights * self.ratios)[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _logistic(feature: np.ndarray, ends: np.ndarray, ratios, y, l2: float = 1.0, rounds: int = 100, close: float = 1e-3) -> tuple[np.ndarray, float]:
    """Full-batch accelerated gradient descent on the ridge-penalised log loss.

    ``feature`` has the features of all rows in turn, ``ends`` where each row ends. Rows are
    passed through in blocks, so that besides ``feature`` little is held. Stops when the
    gradient has shrunk to ``close`` of its first size.
    """
    n, k = len(y), len(ratios)
    starts = np.concatenate([[0], ends[:-1]])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + BLOCK, BLOCK)).clip(0, n)) if n else np.zeros(1, np.int64)
    cuts = np.unique([0, *cuts.tolist(), n])
    blocks = [(a, b, feature[starts[a] : ends[b - 1]], ends[a:b] - starts[a], np.diff(np.append(starts[a:b], ends[b - 1]))) for a, b in zip(cuts, cuts[1:], strict=False)]

    def margins(w):
        out, weighted = np.empty(n), w * ratios
        for a, b, own, upto, _ in blocks:
            sums = np.concatenate([[0.0], np.cumsum(weighted[own])])
            out[a:b] = np.diff(sums[upto], prepend=0.0)
        return out

    def back(g):
        out = np.zeros(k)
        for a, b, own, _, sizes in blocks:
            out += np.bincount(own, np.repeat(g[a:b], sizes), k)
        return out * ratios

    w, bias = np.zeros(k), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    v, top = np.ones(k), 0.0
    for _ in range(20):  # largest eigenvalue, for the step
        v = back(margins(v))
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    step = 1 / (0.25 * (top + n) + l2)
    ahead_w, ahead_b, old_w, old_b, first = w, bias, w, bias, None
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(ahead_b + margins(ahead_w), -40, 40)))
        g = p - y
        slope = back(g) + l2 * ahead_w
        size = float(np.sqrt(slope @ slope + g.sum() ** 2))
        first = size if first is None else first
        w, bias = ahead_w - step * slope, ahead_b - step * g.sum()
        if size <= close * first:
            break
        m = t / (t + 3)
        ahead_w, ahead_b = w + m * (w - old_w), bias + m * (bias - old_b)
        old_w, old_b = w, bias
    return w, bias


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityModel:
    """Fit on ``docs(doc_id, text)`` joined with ``labels(doc_id, toxic)``.

    The fit is bounded by ``max_rows`` labelled documents, the first in hash order of their
    ids. A feature is an n-gram that occurs at least so many times in a document; all whose
    log-likelihood ratio with the label is significant are kept, however many there are.
    Counting runs on the executors; the driver gets the kept features' counts and the
    sample's indices of them. Of a document with several labels the greatest counts, of one
    id with several texts the least text; null labels and ids are ignored. With fewer than
    two classes the score is the smoothed share of toxic rows, (toxic + 1) / (rows + 10).
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    once = rows.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most max_rows (long, int) pairs
    sample = stored(once, "toxicity-sample")
    by_class = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = by_class.get(1, 0), by_class.get(0, 0)
    none = np.empty(0)
    if not toxic or not clean:
        share = (toxic + 1) / (toxic + clean + 10)
        return ToxicityModel(none.astype(np.int64), none, none, float(np.log(share / (1 - share))))

    def count(batches):
        held = np.zeros((2, len(LEVELS) << BITS), np.uint16 if max_rows < 1 << 16 else np.uint32)  # a row counts once
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            y = batch.column("y").to_numpy()
            for owner, bucket in ngram_buckets(batch.column("text").to_pylist()):
                doc, feature = _levels(owner, bucket)
                np.add.at(held, (y[doc], feature), 1)
        used = np.flatnonzero(held[0] | held[1])
        for at in range(0, len(used), 100_000):
            part = used[at : at + 100_000]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(held[1, part].astype(np.int32)), pa.array(held[0, part].astype(np.int32))], names=["feature", "a", "b"])

    counts = sample.mapInArrow(released(count), "feature int, a int, b int").groupBy("feature").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    n = toxic + clean

    def cell(seen, rows_in_class, feature_total):
        return F.when(seen > 0, seen * F.log(seen * n / (feature_total * rows_in_class))).otherwise(0.0)

    a, b, has = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    g2 = 2 * (cell(a, toxic, has) + cell(b, clean, has) + cell(toxic - a, toxic, n - has) + cell(clean - b, clean, n - has))
    kept = counts.withColumn("g2", g2).where(F.col("g2") >= LEAST_G2).orderBy("feature").collect()
    features = np.array([r.feature for r in kept], np.int64)
    seen = np.array([(r.a, r.b) for r in kept], float).reshape(-1, 2)
    ratios = np.log((seen[:, 0] + 1) / (toxic + 2)) - np.log((seen[:, 1] + 1) / (clean + 2))
    model = ToxicityModel(features, ratios, np.zeros(len(features)), 0.0)

    def index(batches):
        place = model.place()
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            doc, feature = model.present(batch.column("text").to_pylist(), place)
            lists = np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, batch.num_rows)))
            yield pa.record_batch([batch.column("y"), pa.array([x.tobytes() for x in lists], pa.binary())], names=["y", "features"])

    found = sample.select("doc_id", "text", "y").mapInArrow(released(index), "y int, features binary")
    lists = [(r.y, np.frombuffer(bytes(r.features), np.int32)) for r in found.toLocalIterator()]
    lists.sort(key=lambda r: (r[0], xxhash.xxh3_128_intdigest(r[1])))  # the sum's order, so that runs agree to the last bit
    ends = np.cumsum([len(x) for _, x in lists])
    model.weights, model.bias = _logistic(np.concatenate([np.empty(0, np.int32), *(x for _, x in lists)]), ends, ratios, np.array([y for y, _ in lists], float))
    return model


def toxicity_column(model: ToxicityModel, text):
    """The score of a text column, over whole texts; a null text counts as empty and gets the bias alone."""

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = model.place()
        for column in columns:
            texts = pa.array(column.fillna(""), pa.string())
            parts = [model.scores(b.column(0).to_pylist(), place) for b in byte_slices(iter([pa.record_batch([texts], names=["t"])]), "t", BATCH_BYTES)]
            yield pd.Series(np.concatenate([np.empty(0), *parts]))
            del column, texts, parts
            release()
        del place
        release()

    return score(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score), one for each row of ``docs``; a map without a shuffle.

    A null or empty text gets the bias alone; null ids and repeated rows pass through; a very
    long text is scored whole; other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias(id_col), toxicity_column(model, F.col(text_col)).alias("score"))


def training_part(docs: DataFrame) -> DataFrame:
    """Rows of documents or labels outside the held-out fold: crc32 of the id as text, mod 4, is not 2."""
    return docs.where(~in_fold(F.col("doc_id"), 4, 2))


def op7_toxicity(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Scores of all documents by a model of the training folds' labels."""
    from cadenza.llm.common import table

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(training_part(docs), training_part(table(spark, sf_dir, "labels")))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

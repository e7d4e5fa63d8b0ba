"""Suffix-array dedup: suffixes compared by prefix hashes, sorted by merging, verified byte by byte.

A global suffix array of every byte is not shuffled. A window of 200 bytes has a fixed
least 32-byte gram (its anchor), equal windows have equal anchors at equal offsets, and
an anchor serves a run of about 85 neighbouring windows. So one row for each run finds
what may repeat; runs whose whole stretch of text is the same wherever their anchor
occurs are settled by hashes, and only the stretches around edits and ends of copies go
to the suffix sort. A group with very many of those is sorted in shares, and windows that
are alone in theirs are compared across shares by two hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import byte_slices, default_parts, discard, released, stored

LENGTH, GRAM = 200, 32
#: Bytes that are searched for anchors at once; positions must fit 24 bits.
SEGMENT = 512 << 10
#: Stretches with one anchor that are sorted together; larger groups are sorted in several shares.
GROUP_ROWS = 4096
#: Stretches that a task sorts at once.
SORT_ROWS = 4_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = [np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) for seed in (11, 12)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


class PrefixHashes:
    """Polynomial hashes modulo 2^64 of all prefixes of ``data``; any stretch's hash takes two lookups."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data) + 1
        cls = PrefixHashes
        if len(cls._powers) < n:
            with np.errstate(over="ignore"):
                cls._powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _ODD, np.uint64)]), dtype=np.uint64)
                inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
                cls._inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[seed][data] * cls._powers[: n - 1], dtype=np.uint64)])

    def of(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * PrefixHashes._inverse[start]


def common_extension(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the stretches from a and b, up to ``limit``, by binary search."""
    low, high = np.zeros(len(a), np.int64), limit.astype(np.int64).copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        same = hashes.of(a, a + mid) == hashes.of(b, b + mid)
        low = np.where(open_ & same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def sort_suffixes(data: np.ndarray, hashes: PrefixHashes, starts: np.ndarray, buckets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes sorted within buckets by their first ``length`` bytes, and
    how far each agrees with its predecessor in the order (-1 at the start of a bucket).

    A bottom-up mergesort of all buckets at once. In a round, each suffix finds its place
    in the neighbouring run by binary search; a comparison finds the common extension by
    hashes and looks at one byte. Extensions of at least ``length`` are verified byte by
    byte; where a hash has lied, the true extension is put in its place.
    """
    order = np.argsort(buckets, kind="stable")
    n = len(order)
    first = np.concatenate([[True], buckets[order][1:] != buckets[order][:-1]]) if n else np.empty(0, bool)
    begin = np.flatnonzero(first)
    size = np.diff(np.append(begin, n))
    begin, size = np.repeat(begin, size), np.repeat(size, size)
    full = np.full(n, length)
    width = 1
    while n and width < size.max():
        at = np.flatnonzero(size > width)
        place = at - begin[at]
        run = place // width
        other = begin[at] + (run ^ 1) * width
        stop = np.minimum(other + width, begin[at] + size[at])
        low, high = np.minimum(other, stop), stop.copy()
        mine, left = starts[order[at]], run % 2 == 0
        while (open_ := low < high).any():
            i = np.flatnonzero(open_)
            mid = (low[i] + high[i]) // 2
            theirs = starts[order[mid]]
            common = common_extension(hashes, mine[i], theirs, full[i])
            end = common >= length
            step = np.where(end, 0, common)
            less = ~end & (data[theirs + step] < data[mine[i] + step])
            before = less | (end & ~left[i])  # ties keep the left run first
            low[i] = np.where(before, mid + 1, low[i])
            high[i] = np.where(before, high[i], mid)
        target = begin[at] + (run - run % 2) * width + (place - run * width) + (low - np.minimum(other, stop))
        moved = order[at]
        order[target] = moved
        width *= 2
    common = np.full(n, -1)
    after = np.flatnonzero(~first)
    a, b = starts[order[after]], starts[order[after - 1]]
    common[after] = common_extension(hashes, a, b, full[after])
    for i in range(0, len(after), 50_000):  # collision verification
        part = after[i : i + 50_000][common[after[i : i + 50_000]] >= length]
        x = data[starts[order[part]][:, None] + np.arange(length)]
        differ = x != data[starts[order[part - 1]][:, None] + np.arange(length)]
        common[part] = np.where(differ.any(1), differ.argmax(1), length)
    return order, common


def anchor_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows by their anchors: (text index, first window, windows, anchor offset, gram hash, stretch hash).

    ``gram`` is a power of two. The anchor of a window is its gram of the least mixed
    hash, the leftmost of equals; a run's windows have one anchor, so they all differ.
    """
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return (empty,) * 4 + (empty.astype(np.uint64),) * 2
    h, power, size = _BYTES[0][data], int(_ODD), 1
    while size < gram:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), 2 * size
    h = _mix(h)
    mask = np.uint64((1 << 24) - 1)
    best, span = (h & ~mask) | np.arange(len(h), dtype=np.uint64), 1
    width = length - gram + 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    anchor = (best & mask).astype(np.int64)
    count = np.maximum(0, ends - starts - length + 1)
    text = np.repeat(np.arange(len(starts)), count)
    window = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(len(text))
    anchor = anchor[window]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, len(text)))
    begin, anchor = window[at], anchor[at]
    hashes = PrefixHashes(data)
    stretch = _mix(hashes.of(begin, begin + runs - 1 + length) + _mix(runs.astype(np.uint64) << np.uint64(20) | (anchor - begin).astype(np.uint64)))
    return text[at], begin, runs, anchor - begin, h[anchor], stretch


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    """(h, c, uid, p, m, d): anchor hash, stretch hash, document, first window, windows, anchor offset."""

    def emit(batches):
        for batch in byte_slices(batches, "text", SEGMENT):
            uid = batch.column("uid").to_numpy()
            data, offsets = _flat(batch.column("text"))
            if len(data) <= 4 * SEGMENT:
                cuts = [(0, len(data), None)]
            else:  # long texts, row by row: stretches that overlap by a window less one
                cuts = [(s, min(s + SEGMENT + length - 1, offsets[row + 1]), row) for row in range(len(uid)) for s in range(offsets[row], offsets[row + 1], SEGMENT)]
            for low, high, row in cuts:
                starts, ends = (offsets[:-1], offsets[1:]) if row is None else (np.array([0]), np.array([high - low]))
                text, begin, runs, offset, h, c = anchor_runs(data[low:high], starts, ends, length)
                text = text if row is None else text + row
                yield pa.record_batch(
                    [pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(uid[text]), pa.array(begin + low - offsets[text]), pa.array(runs.astype(np.int16)), pa.array(offset.astype(np.int16))],
                    names=["h", "c", "uid", "p", "m", "d"],
                )

    return docs.select("uid", "text").mapInArrow(released(emit), "h long, c long, uid long, p long, m short, d short")


def _stretches(dealt: DataFrame, length: int) -> DataFrame:
    """(key, hot, uid, p, d, body): the stretches of text of open runs.

    ``key`` is the anchor's hash, or, where the anchor's group is dealt to several shares
    by document and position, a hash of the anchor and the share; such rows are ``hot``.
    """

    def emit(batches):
        for batch in byte_slices(batches, "text", SEGMENT):
            for row in range(batch.num_rows):
                raw = _flat(batch.column("text").slice(row, 1))[0].tobytes()
                uid = batch.column("uid")[row].as_py()
                marks = batch.column("marks")[row].values
                h, p, m, d, shares = (marks.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
                share = _mix(_mix(np.full(len(h), uid, np.int64).view(np.uint64)) + p.view(np.uint64)) % shares.astype(np.uint64)
                key = np.where(shares > 1, _mix(h.view(np.uint64) + _mix(share + np.uint64(1))).view(np.int64), h)
                ends = p + m - 1 + length
                held = np.cumsum(ends - p) // SEGMENT  # a long document's stretches go out in several batches
                cuts = [0, *(np.flatnonzero(np.diff(held)) + 1).tolist(), len(h)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    bodies = [raw[a:b] for a, b in zip(p[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                    columns = [key, shares > 1, np.full(len(h), uid), p, d.astype(np.int16)]
                    yield pa.record_batch([*(pa.array(c[low:high]) for c in columns), pa.array(bodies, pa.binary())], names=["key", "hot", "uid", "p", "d", "body"])

    return dealt.select("uid", "text", "marks").mapInArrow(released(emit), "key long, hot boolean, uid long, p long, d short, body binary")


def _sorted_spans(rows: DataFrame, parts: int, length: int) -> DataFrame:
    """(state, uid, a, b, key, key2) of the stretches (key, hot, uid, p, d, body), by suffix sort.

    State 0 is a span of repeated bytes. A hot group's share settles what repeats in it;
    of a hot group there also are, with two hashes of the window, state 1 for a window
    from a that is alone in its share, and state 2 for one that repeats there.
    """

    def settle(key, hot, uid, p, d, bodies):
        """Equal stretches of an anchor are one class; classes' windows are sorted against each other."""
        named: dict = {}
        member = np.fromiter((named.setdefault((k, o, b), len(named)) for k, o, b in zip(key.tolist(), d.tolist(), bodies, strict=True)), np.int64, len(bodies))
        classes = list(named)
        size = np.bincount(member, minlength=len(classes))
        lens = np.array([len(b) for _, _, b in classes], np.int64)
        data = np.frombuffer(b"".join(b for _, _, b in classes), np.uint8)
        hashes = PrefixHashes(data)
        begin = np.cumsum(lens) - lens
        windows = lens - length + 1
        owner = np.repeat(np.arange(len(classes)), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = begin[owner] + place
        offset = np.array([o for _, o, _ in classes], np.int64)[owner] - place  # to the anchor; equal windows have equal ones
        anchor = np.unique(np.array([k for k, _, _ in classes], np.int64), return_inverse=True)[1][owner]
        # a window whose hash is alone is no candidate; the others are sorted as suffixes
        whole = hashes.of(start, start + length)
        by_hash = np.argsort(whole, kind="stable")
        equal = whole[by_hash][1:] == whole[by_hash][:-1]
        candidate = np.zeros(len(owner), bool)
        candidate[by_hash[1:][equal]] = candidate[by_hash[:-1][equal]] = True
        candidate = np.flatnonzero(candidate)
        bucket = anchor[candidate] * 65536 + offset[candidate] + 32768
        order, common = sort_suffixes(data, hashes, start[candidate], bucket, length)
        twin = common >= length
        twin[:-1] |= common[1:] >= length
        repeated = size[owner] > 1
        repeated[candidate[order[twin]]] = True
        rows_of = np.argsort(member, kind="stable")
        first_row = np.searchsorted(member[rows_of], np.arange(len(classes)))
        of_hot = np.flatnonzero(hot[rows_of[first_row]][owner])
        if len(of_hot):
            keys = np.stack([_mix(x.of(start[of_hot], start[of_hot] + length)) for x in (hashes, PrefixHashes(data, 1))]).view(np.int64)
            alone = ~repeated[of_hot]
            row = rows_of[first_row[owner[of_hot[alone]]]]
            yield _settled(1, uid[row], p[row] + place[of_hot[alone]], None, keys[:, alone])
            yield _settled(2, None, None, None, np.unique(keys[:, ~alone], axis=1))
        # neighbouring repeated windows of a class form a span
        edge = np.flatnonzero(repeated)
        if not len(edge):
            return
        fresh = np.ones(len(edge), bool)
        fresh[1:] = (np.diff(edge) != 1) | (owner[edge[1:]] != owner[edge[:-1]])
        low = edge[fresh]
        high = edge[np.append(np.flatnonzero(fresh)[1:], len(edge)) - 1]
        a, b, of = place[low], place[high] + length, owner[low]
        times = size[of]
        span = np.repeat(np.arange(len(of)), times)
        row = rows_of[np.repeat(first_row[of], times) + np.arange(len(span)) - np.repeat(np.cumsum(times) - times, times)]
        yield _settled(0, uid[row], p[row] + a[span], p[row] + b[span], None)

    def _settled(state, uid, a, b, keys):
        n = len(uid) if uid is not None else keys.shape[1]
        columns = [uid, a, b, *(keys if keys is not None else (None, None))]
        return pa.record_batch([pa.array(np.full(n, state, np.int16)), *(pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in columns)], names=["state", "uid", "a", "b", "key", "key2"])

    def run(batches):
        held: list = []
        count = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SORT_ROWS):
                part = batch.slice(at, SORT_ROWS)
                if not part.num_rows:
                    continue
                held.append(part)
                count += part.num_rows
                if count < SORT_ROWS:
                    continue
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield from solve(table.slice(0, cut))
                    held, count = table.slice(cut).to_batches(), len(table) - cut
        if held:
            yield from solve(pa.Table.from_batches(held))

    def solve(table):
        hot = table["hot"].to_numpy().astype(bool)
        return settle(table["key"].to_numpy(), hot, *(table[c].to_numpy() for c in ("uid", "p", "d")), table["body"].to_pylist())

    dealt = rows.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(released(run), "state short, uid long, a long, b long, key long, key2 long")


def _across_shares(settled: DataFrame, length: int) -> DataFrame:
    """(uid, a, b) of windows that are alone in their share of a hot group but occur in another one.

    A window that repeats in a share is counted there once, so a hot window has as many
    rows as there are shares, and only windows alone in theirs are joined back.
    """
    open_ = settled.where("state > 0").select("state", "uid", "a", "key", "key2")
    repeated = open_.groupBy("key", "key2").agg(F.count("*").alias("n")).where("n > 1").select("key", "key2")
    return open_.where("state = 1").join(repeated, ["key", "key2"]).select("uid", "a", (F.col("a") + length).alias("b"))


def _numbered(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with its columns named __0, __1, ... so that no name can clash, the text as __text, and a row number."""
    columns = [F.col(f"`{c}`").alias("__text" if c == text_col else f"__{i}") for i, c in enumerate(docs.columns)]
    return docs.select(*columns, F.monotonically_increasing_id().alias("__uid"))


def _without_repeats(rows: DataFrame, length: int, kept: str | None) -> DataFrame:
    """The numbered columns of ``rows`` with n_bytes, n_removed, n_spans, kept_sha256 and kept."""
    if length < 64:
        raise ValueError("strings of fewer than 64 bytes need a shorter gram")
    parts = default_parts(rows.sparkSession)
    texts = rows.select(F.col("__uid").alias("uid"), F.col("__text").alias("text"))
    anchors = _anchors(texts, length)
    groups = anchors.groupBy("h").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("n > 1")
    shares = F.when(F.col("low") == F.col("high"), 0).otherwise(F.ceil(F.col("n") / GROUP_ROWS))  # 0: all stretches are equal
    kinds = stored(groups.select("h", shares.cast("long").alias("shares")), "repeat-anchors")
    marks = stored(anchors.select("h", "uid", "p", "m", "d").join(kinds, "h"), "repeat-marks")
    discard(kinds)
    open_ = marks.where("shares > 0").groupBy("uid").agg(F.collect_list(F.struct("h", "p", "m", "d", "shares")).alias("marks"))
    stretches = _stretches(texts.repartition(parts, "uid").join(open_, "uid"), length)
    settled = stored(_sorted_spans(stretches, parts, length), "repeat-sorted")
    equal = marks.where("shares = 0").select("uid", F.col("p").alias("a"), (F.col("p") + F.col("m") - 1 + length).alias("b"))
    spans = equal.union(settled.where("state = 0").select("uid", "a", "b")).union(_across_shares(settled, length))
    by_doc = spans.groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("__spans"))
    whole = rows.repartition(parts, "__uid").join(by_doc, F.col("__uid") == F.col("uid"), "left")
    others = [c for c in rows.columns if c not in ("__text", "__uid")]
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.string() if kept == "string" else pa.binary())] * bool(kept)

    def cut(batches):
        for batch in byte_slices(batches, "__text", 2 << 20):
            out: list[list] = [[] for _ in fields]
            for text, marks_ in zip(batch.column("__text").cast(pa.binary()).to_pylist(), batch.column("__spans").to_pylist(), strict=True):
                text = text or b""
                merged: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in marks_ or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                pieces, at = [], 0
                for a, b in merged:
                    pieces.append(text[at:a])
                    at = b
                left = b"".join([*pieces, text[at:]])
                values = [len(text), len(text) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left.decode(errors="ignore") if kept == "string" else left]
                for column, value in zip(out, values, strict=False):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *(pa.array(v, t) for v, (_, t) in zip(out, fields, strict=True))], names=[*others, *(n for n, _ in fields)])

    types = dict(rows.dtypes)
    spec = ", ".join([f"{c} {types[c]}" for c in others] + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + [f"kept {kept}"] * bool(kept))
    return whole.select(*others, "__text", "__spans").mapInArrow(released(cut), spec)


def remove_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", kept: str | None = "binary") -> DataFrame:
    """``docs`` with (n_bytes, n_removed, n_spans, kept_sha256, kept) in place of the text column.

    Every byte covered by a ``length``-byte string that also starts elsewhere, in the same
    or another row, is removed; strings are judged on the input. Each row is a document,
    so repeated rows remove each other; a null text is empty; texts shorter than
    ``length`` stay whole; null ids are returned as they are; an empty table gives no rows.
    A very long text is searched in segments. An input column that has the name of a result
    gives way to it; all others are returned as they are. ``docs`` must give the same rows in
    the same partitions when read twice, as a table scan does. A span may begin or end inside
    a character: ``kept`` as binary has all remaining bytes, as string it has the whole
    characters among them, and with None it is left out.
    """
    done = _without_repeats(_numbered(docs, text_col), length, kept)
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * bool(kept)
    own = [F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns) if c != text_col and c not in results]
    return done.select(*own, *results)


def strip_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns and rows, its texts without what ``remove_repeats`` removes.

    Whole characters remain; a null text becomes empty. No column's name can clash.
    """
    done = _without_repeats(_numbered(docs, text_col), length, "string")
    return done.select(*[F.col("kept" if c == text_col else f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def op1_suffixes(spark, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings removed from all documents, as digests."""
    from cadenza.llm.common import table

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs, kept=None)

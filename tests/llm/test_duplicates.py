import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import embeddings, fingerprints, jaccard, suffixes
from cadenza.llm.common import components


def roots(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 450)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(500, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert found == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Suffix-array dedup


def repeats(docs, length=200):
    raw = [(t or "").encode() for _, t in docs]
    count: dict = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for (doc, _), b in zip(docs, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int)])) == 1
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((doc, len(b), int(gone.sum()), int(edges.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)

    def text(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    shared = [text(n) for n in (150, 199, 200, 201, 260, 500, 1500)]
    docs = [(i, " ".join(rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(0, 300)) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    docs += [(500, "a" * 1000), (501, "ab" * 300), (502, None), (503, ""), (504, shared[5]), (504, shared[5]), (505, "xyz " * 100 + "q"), (506, text(199)), (None, "line that repeats\n" * 30)]
    return docs


@pytest.mark.parametrize(("group_rows", "segment"), [(4096, 3 << 20), (2, 3 << 20), (4096, 300)])
def test_repeats(spark, tmp_path, passages, monkeypatch, group_rows, segment):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(suffixes, "SEGMENT", segment)
    spark.createDataFrame([(*d, "x") for d in passages], "doc_id long, text string, kept string").repartition(4, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    got = suffixes.op1_suffixes(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == repeats(passages)


def test_repeats_of_tables(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, suffixes.op1_suffixes(spark, small).collect()), key=str) == repeats(docs)


def test_suffix_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[:400]
    data[2000:2300] = 97
    starts, buckets = np.arange(0, 2600, 3), np.arange(0, 2600, 3) % 4
    order, common = suffixes.sort_suffixes(data, suffixes.PrefixHashes(data), starts, buckets, 200)
    raw = data.tobytes()
    key = [(buckets[i], raw[starts[i] : starts[i] + 200]) for i in order]
    assert key == sorted(key) and sorted(order) == list(range(len(starts)))
    for j in range(1, len(order)):
        a, b = key[j - 1], key[j]
        want = -1 if a[0] != b[0] else next((n for n in range(200) if a[1][n] != b[1][n]), 200)
        assert common[j] == want


def test_collision_is_caught(monkeypatch):
    data = np.frombuffer(b"a" * 300 + b"b" * 300, np.uint8)
    hashes = suffixes.PrefixHashes(data)
    monkeypatch.setattr(suffixes.PrefixHashes, "of", lambda self, a, b: np.zeros(len(np.asarray(a)), np.uint64))
    _, common = suffixes.sort_suffixes(data, hashes, np.array([0, 300]), np.array([0, 0]), 200)
    assert common.tolist() == [-1, 0]


def test_kept_text(spark, tmp_path):
    spark.createDataFrame([(1, "é" * 150, 5), (2, "x" + "é" * 150, 6)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "d"))
    rows = suffixes.remove_repeats(spark.read.parquet(str(tmp_path / "d")), kept="string").collect()
    assert {r.kept for r in rows} == {"", "x"} and {r.n_chars for r in rows} == {5, 6}


# N-gram Jaccard join


def jaccard_brute(docs):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in docs:
        w = word.findall((t or "").encode().lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    links = [(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if a & b and 100 * len(a & b) >= 75 * len(a | b)]
    root, low = roots(len(docs), links), {}
    for i, (d, _) in enumerate(docs):
        low[root[i]] = min(low.get(root[i], d), d)
    return sorted((d, len(sets[i]), low[root[i]]) for i, (d, _) in enumerate(docs))


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(3)
    words = [f"W{i}" for i in range(40)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 30, 120]))]
        for _ in range(rng.choice([1, 5, 60])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w = w[: max(1, int(len(w) * rng.uniform(0.7, 1)))]
            docs.append((len(docs) * 3 + 1, " ".join(w).lower() if rng.random() < 0.5 else "\t".join(w)))
    return [*docs, (0, ""), (2, None), (5, "A  b\tC"), (8, "a b c"), (8, "a b c")]


@pytest.mark.parametrize(("size", "dense", "leaf"), [(1 << 15, 0.7, 64), (300, 0.7, 8), (300, 0.0, 8), (60, 0.95, 3)])
def test_jaccard(spark, near_copies, monkeypatch, size, dense, leaf):
    monkeypatch.setattr(jaccard, "REGION_SHINGLES", size)
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    docs = spark.createDataFrame([(*d, 1) for d in near_copies] + [(None, "a b c", 1)], "doc_id long, text string, n long").repartition(4)
    rows = jaccard.jaccard_components(docs).collect()
    assert sorted(tuple(r) for r in rows if r.doc_id is not None) == jaccard_brute(near_copies)
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_regions_that_pivots_do_not_cut(spark, near_copies, monkeypatch):
    """They are compared once, not once for each cell, and in shares of fitting sizes give the same links."""
    for name, value in (("REGION_SHINGLES", 64), ("DENSE", 0.1), ("DENSE_SHINGLES", 256)):
        monkeypatch.setattr(jaccard, name, value)
    docs = spark.createDataFrame(near_copies, "doc_id long, text string")
    rows = jaccard.jaccard_components(docs)
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in rows.collect() if r.doc_id is not None) == jaccard_brute(near_copies)
    apart = [(1, i, 50, np.arange(100 * i, 100 * i + 50, dtype=np.uint64).tobytes()) for i in range(1, 41)]
    large = spark.createDataFrame(apart, "region long, k long, n long, s binary")
    cells = jaccard._cut(large, spark.createDataFrame([(1, 2000)], "region long, shingles long")).cache()
    members = jaccard._uncut(large, cells, cells.select(F.col("cell").alias("region")).distinct()).collect()
    assert cells.count() > 100 and sorted(r.k for r in members) == list(range(1, 41))


def test_jaccard_of_tables(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, jaccard.op3_jaccard(spark, small).collect())) == jaccard_brute(docs)


def test_regions_with_pivots():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        for _ in range(12):
            keep = base[rng.random(60) > rng.choice([0.05, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 40, 3).astype(np.uint64)])))
    region = jaccard.Region(sets)
    region.join(np.arange(len(sets)))
    links = []
    for j, b in enumerate(sets):
        for i in range(j):
            both = len(np.intersect1d(sets[i], b))
            if 100 * both >= 75 * (len(sets[i]) + len(b) - both):
                links.append((i, j))
    assert region.roots(np.arange(len(sets))).tolist() == roots(len(sets), links)


def test_keep_first(spark, tmp_path):
    rows = [(1, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (None, "a b c d e f g", "en"), (4, None, "en"), (5, None, "de"), (1, "a b c d e f g", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(str(tmp_path / "d"))
    kept = jaccard.keep_first(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == 3


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert jaccard.jaccard_components(none).count() == suffixes.op1_suffixes(spark, str(tmp_path)).count() == 0
    assert fingerprints.fingerprint_documents(none).count() == 0


# Fingerprints


def test_fingerprints(spark, small):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    rows = {r.doc_id: r for r in fingerprints.op2_fingerprints(spark, small).collect()}
    assert len(rows) == len(docs)
    by_text: dict = {}
    for k, (i, t) in enumerate(docs):
        m, following = len(t) // 4, docs[(k + 1) % len(docs)]
        edited = t[: len(t) - m] + following[1][:m]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        bits = [int(x, 16) for x in (r.fingerprint, r.edited_fingerprint, rows[following[0]].fingerprint)]
        assert r.near_edited == 1 - bin(bits[0] ^ bits[1]).count("1") / 64 and r.near_next == 1 - bin(bits[0] ^ bits[2]).count("1") / 64
    assert np.mean([r.near_edited for r in rows.values()]) > 0.2 + np.mean([r.near_next for r in rows.values()])


def simhash_brute(text):
    """The fingerprint bit by bit, with the XXH64 library."""
    words = re.split(r"[ \t\n\x0b\f\r]+", text.lower())
    votes = [0] * 64
    for w, after in zip(words, [*words[1:], None], strict=True):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        h = h if after is None else xxhash.xxh64_intdigest(after.encode(), h)
        for b in range(64):
            votes[b] += (1 if h >> b & 1 else -1) * (len(w) + len(after or ""))
    return f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"


def test_fingerprints_against_brute_force(spark, small):
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    texts += ["", " lead and trail ", "one", "Two\twords\n", "x " * 5000, None]
    rows = [(i, t) for i, t in enumerate(texts)]
    found = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: simhash_brute(t or "") for i, t in rows} == found


def test_near_counts(spark, small):
    rows = fingerprints.op2_fingerprints(spark, small).collect()
    prints = {int(r.fingerprint, 16) for r in rows}
    for r in rows:
        mine = int(r.fingerprint, 16)
        assert r.n_near == (None if r.doc_id % 50 else sum(bin(mine ^ p).count("1") <= 3 for p in prints) - 1)


def test_order_with_an_outlier(spark):
    ids = [*range(500), 1 << 50, -5]
    rows = fingerprints.next_in_order(spark.createDataFrame([(i,) for i in ids], "id long"), ["id"], 8).collect()
    ordered = sorted(ids)
    assert {(r.id, r.before.id) for r in rows} == set(zip(ordered, [ordered[-1], *ordered[:-1]], strict=True))


def test_fingerprint_cases(spark):
    rows = [(3, "a b c"), (3, "a b c"), (None, "x y"), (None, "x y"), (5, None), (9, ""), (9, "zz 1 "), (1, "hello wörld and more text")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, copies string")
    found = fingerprints.fingerprint_documents(docs).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)  # a row for each row
    one = fingerprints.fingerprint_documents(docs.where("doc_id = 1")).first()
    assert one.near_next == 1.0


def test_block_tables(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(150)]
    prints += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for f in prints]
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    frame = spark.createDataFrame([(f,) for f in signed] + [(None,)], "fingerprint long")
    ordered = sorted(set(signed))
    for radius, blocks in ((3, None), (2, 4)):
        want = {(a, b, bin((a ^ b) & (2**64 - 1)).count("1")) for k, a in enumerate(ordered) for b in ordered[k + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= radius}
        assert {tuple(r) for r in fingerprints.near_fingerprints(frame, radius, blocks).collect()} == want and want


# Embeddings


def test_embeddings(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    vectors = [(base[rng.integers(30)] + rng.normal(size=16) * 0.25).round(3).tolist() for _ in range(400)]
    rows = list(enumerate(vectors + vectors[:30])) + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None] * 8), (2004, [float("inf")] * 16)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n string")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(embeddings.OP8_SQL).fetchall())
    assert sorted(map(tuple, embeddings.op8_embeddings(spark, str(tmp_path)).collect())) == want
    _, whole, _ = embeddings.embedding_links(frame)
    _, parted, _ = embeddings.embedding_links(frame, group_rows=60)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parted.collect()))
    assert embeddings.embedding_links(frame.limit(0))[1].count() == 0


def test_embedding_cases(spark, tmp_path):
    """Rows of one id with other vectors, huge components, repeated rows, clashing names."""
    e = np.eye(4).tolist()
    rows = [(1, e[0]), (1, e[1]), (2, e[0]), (3, [0.0, 0.0, 0.0, 1e200]), (4, [0.0, 0.0, 1e190, 2e200]), (5, e[2]), (5, e[2]), (None, e[2]), (6, [5e-320, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 7, 8) for r in rows], "vec_id long, embedding array<double>, rep long, same long")
    got = sorted((tuple(r) for r in embeddings.near_duplicate_vectors(frame).collect()), key=str)
    want = [(1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True), (None, 0, None, False), (6, 2, 1, False)]
    assert got == sorted(want, key=str)


def test_clashing_columns(spark, tmp_path):
    """Columns named like those that the operators use inside come back as they were."""
    row = (1, "word " * 60, 70, 5, "k", [1, 2], "r")
    spark.createDataFrame([row, (2, *row[1:])], "doc_id long, text string, uid long, n_bytes long, kept string, spans array<int>, __row string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    done = suffixes.remove_repeats(docs, kept=None)
    assert done.columns == ["doc_id", "uid", "kept", "spans", "__row", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and {(r.uid, r.n_bytes, r.n_removed) for r in done.collect()} == {(70, 300, 300)}
    left = suffixes.strip_repeats(docs)
    assert left.columns == docs.columns and [tuple(r)[1:] for r in left.collect()] == [("", *row[2:])] * 2
    first = jaccard.keep_first(docs).collect()
    assert [tuple(r) for r in first] == [row]

import math
import zlib
from collections import Counter

import numpy as np

from cadenza.llm import brown, toxicity


def test_exchange_finds_classes():
    rng = np.random.default_rng(3)
    kind = np.repeat([0, 1, 2, 3], 10)
    nxt = {0: 1, 1: 0, 2: 3, 3: 2}
    counts = np.zeros((40, 40))
    for _ in range(20_000):
        a = rng.integers(40)
        counts[a, rng.choice(np.flatnonzero(kind == nxt[kind[a]]))] += 1
    of = brown.exchange(counts, 4)
    assert all(len(set(of[kind == k])) == 1 for k in range(4))

    def likelihood(of):
        table = np.zeros((4, 4))
        np.add.at(table, (of[:, None].repeat(40, 1), of[None].repeat(40, 0)), counts)
        seen = table[table > 0]
        return (seen * np.log(seen)).sum() - sum((t * np.log(t)).sum() for t in (table.sum(0)[table.sum(0) > 0], table.sum(1)[table.sum(1) > 0]))

    # single words are moved, so the end is a local best: better than any start it is given
    order = np.argsort(-(counts.sum(0) + counts.sum(1)), kind="stable")
    start = np.empty(40, int)
    start[order] = np.arange(40) % 4
    assert likelihood(of) > likelihood(start) + 1000


def test_scores(spark, small):
    rows = {r.doc_id: r for r in brown.op6_brown(spark, small).collect()}
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    count = Counter()
    for i, w in words.items():
        if not held[i]:
            count.update([*w, b""])
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        r = rows[i]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in [*w, b""])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(count[x] > 0 for x in [*w, b""]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)


def test_score_cases(spark):
    rows = [(1, "a b a", True, "x"), (None, "a", False, None), (2, None, False, "y"), (2, "a zz\tB", False, "z"), (2, "a zz\tB", False, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, c string")
    found = brown.score_documents(docs).collect()
    assert len(found) == 5 and {r.train_tokens for r in found} == {11} and all(math.isfinite(r.score) for r in found)
    assert brown.score_documents(docs.limit(0)).collect() == []
    assert brown.perplexity(brown.score_documents(docs)).count() == 2


def brown_brute(rows, seeds, classes):
    """log10 probabilities of (id, text, held_out) rows by counting bigrams one by one."""
    texts = [[*(t or "").encode().lower().split(), b""] for _, t, _ in rows]
    train = [t for t, (_, _, h) in zip(texts, rows, strict=True) if not h]
    count = Counter(w for t in train for w in t)
    bits = min(brown.MOST_BITS, max(brown.LEAST_BITS, (4 * len(count)).bit_length()))
    slot = {w: brown._hash(w) % (1 << bits) for w in count if w}
    bigrams = Counter(p for t in train for p in zip([b"", *t], t, strict=False))
    head = sorted({slot[w] for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[:seeds] if w})
    table = np.zeros((len(head), len(head)))
    for (a, b), n in bigrams.items():
        if a and b and slot[a] in head and slot[b] in head:
            table[head.index(slot[a]), head.index(slot[b])] += n
    of = dict(zip(head, brown.exchange(table, classes).tolist(), strict=True))

    def state(w):
        return classes if not w else of.get(slot[w], classes + 1) if w in slot else classes + 1

    def seen():
        out = np.zeros((classes + 2, classes + 2))
        for (a, b), n in bigrams.items():
            out[state(a), state(b)] += n
        return out

    for share in (None, *range(brown.SHARES)):
        t = seen()[: classes + 1, : classes + 1] + brown.TRANSITION
        moved = {}
        for s in sorted(set(slot.values())):
            if (s in of) if share is None else ((s >> 4) % brown.SHARES != share):
                continue
            gain, any_ = np.zeros(classes), False
            for (a, b), n in bigrams.items():
                if b and slot[b] == s and state(a) <= classes:
                    gain, any_ = gain + n * np.log(t[state(a), :classes] / t.sum(0)[:classes]), True
                if a and slot[a] == s and state(b) <= classes:
                    gain, any_ = gain + n * np.log(t[:classes, state(b)] / t.sum(1)[:classes]), True
            if any_:
                moved[s] = int(np.round(gain, 6).argmax())
        of |= moved
    pairs = seen()
    home = np.bincount([state(w) for w in count], minlength=classes + 2)
    follow = np.log10((pairs + brown.TRANSITION) / (pairs.sum(1, keepdims=True) + brown.TRANSITION * (classes + 2)))
    scores = []
    for t in texts:
        last, total = classes, 0.0
        for w in t:
            s = state(w)
            total += follow[last, s] + math.log10((count[w] + brown.EMISSION) / (pairs.sum(0)[s] + brown.EMISSION * (home[s] + 1)))
            last = s
        scores.append(total)
    return scores


def test_scores_against_brute_force(spark, small):
    """The same scores for two layouts of the rows and for counting one by one."""
    words = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows = [(i, (t or "")[:600], i % 5 == 1) for i, t in enumerate(words)] + [(70, "", False), (71, None, True), (72, "p r q s p s q r", False), (73, "new words only", True)]
    want = brown_brute(rows, 20, 4)
    whole = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id long, text string, held_out boolean")
    spread = spark.createDataFrame(spark.sparkContext.parallelize(rows[::-1], 5), whole.schema)
    for docs, size in ((whole, 8 << 20), (spread, 2000)):
        found = {r.doc_id: r.score for r in brown.score_documents(docs, seeds=20, classes=4, block_bytes=size).collect()}
        assert len(found) == len(rows) and all(math.isclose(found[i], w, rel_tol=1e-9) for (i, _, _), w in zip(rows, want, strict=True))


def test_very_long_text_is_scored_whole(spark):
    rows = [(1, "a b c d " * 20_000, False), (2, "a b", True), (3, "x" * 100_000, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    found = {r.doc_id: r for r in brown.score_documents(docs, block_bytes=1000).collect()}
    assert (found[1].n_tokens, found[2].n_known, found[3].n_tokens) == (80_001, 3, 2) and all(math.isfinite(r.score) for r in found.values())


def test_toxicity(spark, small):
    small = small.replace("sf0.001", "sf0.1")
    rows = toxicity.op7_toxicity(spark, small).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    known = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in known if y], [s for s, y in known if not y]
    assert np.mean([a > b for a in bad for b in good]) > 0.97
    assert np.mean(np.array(bad) >= 0.3) > 0.9 and np.mean(np.array(good) >= 0.3) < 0.02


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, "you idiot", "x"), (2, None, "x"), (None, "fine", "y"), (3, "", "z"), (3, "", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)  # one class only
    found = toxicity.score_toxicity(docs, model).collect()
    assert len(found) == 5 and all(0 < r.score < 1 for r in found)
    both = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, both)  # both classes, but no n-gram tells them apart
    assert len(model.features) == 0 and len({r.score for r in toxicity.score_toxicity(docs, model).collect()}) == 1
    model = toxicity.fit_toxicity(docs, labels.limit(0))
    assert toxicity.score_toxicity(docs, model).agg({"score": "max"}).first()[0] < 0.3
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []


def test_ngrams_stay_inside():
    texts = ["ab", "Abc\nd", ""]
    for n, (owner, bucket) in zip(toxicity.SIZES, toxicity.ngram_buckets(texts), strict=True):
        want = [max(0, len(t) + 2 - n + 1) for t in texts]
        assert np.bincount(owner, minlength=3).tolist() == want and bucket.max(initial=0) < 1 << toxicity.BITS

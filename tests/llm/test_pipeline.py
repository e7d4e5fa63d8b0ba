import re
from pathlib import Path

import corpus_pipeline
import numpy as np
from test_duplicates import jaccard_brute, repeats

from cadenza.llm.common import stored
from cadenza.llm.toxicity import fit_toxicity, training_part


def test_stages(spark, small):
    """Each stage against a plain version on its own input."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    model = fit_toxicity(training_part(docs), training_part(spark.read.parquet(f"{small}/labels.parquet")))
    rows = docs.collect()
    kept = [r for r in rows if model.scores([r.text])[0] < corpus_pipeline.TOXIC]
    one = stored(corpus_pipeline.toxicity(spark, docs, small), "t")
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in kept}

    two = stored(corpus_pipeline.near_duplicates(spark, one, small), "t")
    groups = {d: c for d, _, c in jaccard_brute([(r.doc_id, r.text) for r in kept])}
    left = [r.doc_id for r in two.collect()]
    assert set(left) == set(groups.values())  # the smallest id of each group
    assert two.columns == columns and len(left) == len(set(groups.values())) and {groups[d] for d in left} == set(groups.values())

    three = stored(corpus_pipeline.repeated_passages(spark, two, small), "t")
    assert three.columns == columns and three.count() == len(left)
    texts = {r.doc_id: r.text for r in three.collect()}
    sizes = {d: n - gone for d, n, gone, _, _ in repeats([(r.doc_id, r.text) for r in two.collect()])}
    assert all(0 <= sizes[d] - len(t.encode()) <= 6 * (t != "") or sizes[d] == len(t.encode()) for d, t in texts.items())  # less at most cut characters
    assert all(r.n_chars == len(r.text) for r in three.collect())

    packed = corpus_pipeline.packing(spark, three, small).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc: dict = {}
    for r in sorted(packed, key=lambda r: r.start):
        by_doc.setdefault(r.doc_id, []).extend(r.ids)
    assert by_doc == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    assert corpus_pipeline.run(spark, small).count() == len(packed)


def test_stage_cases(spark, small, tmp_path):
    """Nulls, empty and very long texts, repeated rows, an empty table and names that the stages use inside."""
    fields = "doc_id long, text string, lang string, source string, n_chars long, row long, uid string, kept int, score double, c0 int, __text int"
    rest = ("en", "s", 5, 1, "u", 2, 0.5, 3, 4)
    rows = [(1, "some words that stand here once and again", *rest), (1, "some words that stand here once and again", *rest), (None, None, *[None] * 9), (None, "", *rest), (3, "long word " * 40_000, *rest), (4, None, *rest)]
    spark.createDataFrame(rows, fields).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, small), "case")
        assert out.dtypes == docs.dtypes, name
        assert out.count() == (5 if name == "near_duplicates" else 6), name
        assert {r.uid for r in out.collect()} == {"u", None} and stage(spark, docs.limit(0), small).count() == 0
        if name == "repeated_passages":
            assert all(r.n_chars == len(r.text) for r in out.collect())
    assert corpus_pipeline.packing(spark, docs, small).where("start = 0").count() == 6 and corpus_pipeline.packing(spark, docs.limit(0), small).count() == 0


def test_released():
    """What a worker has freed goes back to the system at the end of its task."""
    from cadenza.llm.common import released

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def run(batches):
        pinned.extend([np.zeros(1000, np.uint8) for _ in range(200_000)][::1000])  # freed but for these
        sizes.append(held())
        yield from batches

    pinned, sizes = [], []
    assert list(released(run)(iter([1, 2]))) == [1, 2]
    assert held() < sizes[0] - 100

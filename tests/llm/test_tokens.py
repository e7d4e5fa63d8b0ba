import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cadenza.llm import packing, pieces, token_counts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  a", "a  b", "a \n b", "\n", "x ", "x  ", "a  b", "a<|endoftext|>b c <|endoftext|> d", "don't  stop 's we'll", "é ü 你好 世界 ▁x ▁ y",
    "\x1c a\x1f b", "🙂 👩‍👩‍👧 x", "tab\t tab", "<s> </s> <unk> x", "\x00a b\x00", "word " * 4000, "w" * 5000, "A b c   d",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (3, "again", "y"), (3, "again", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def texts_of(docs):
    return sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)


def test_counts(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    want = [(i, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in texts_of(docs)]
    for limit in (12 << 20, 50):
        assert sorted(map(tuple, token_counts.token_counts(docs, BPE, batch_bytes=limit).collect()), key=str) == sorted(want, key=str)


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    one = docs.where("doc_id is null or doc_id <> 3")
    rows = packing.pack_power_of_two(one, BPE, 64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in texts_of(one):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        for r in own:
            assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and r.doc_tokens == len(ids) and 1 << r.bucket == r.length
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *r.ids))
    assert packing.binary_lengths(2500, 1024) == [1024, 1024, 256, 128, 64, 4]
    with pytest.raises(ValueError):
        packing.pack_power_of_two(docs, BPE, 100)


def test_buckets(docs, spark, tmp_path):
    rows = packing.pack_power_of_two(docs, BPE)
    packing.write_buckets(rows, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == rows.count()


def test_pieces(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def digest(t):
        ids = model.encode(t, add_bos=True, add_eos=True)
        return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()

    want = sorted([(i, *digest(t)) for i, t in texts_of(docs)], key=str)
    assert sorted(map(tuple, pieces.round_trip_digests(docs, PIECES).collect()), key=str) == want
    encoded = pieces.encode_pieces(docs, PIECES)
    back = {(r.doc_id, r.text) for r in pieces.decode_pieces(encoded, PIECES).collect()}
    assert back == {(i, model.decode(model.encode(t, add_bos=True, add_eos=True))) for i, t in texts_of(docs)}


def test_pieces_of_short_strings(spark):
    """All strings of up to five characters over blank, newline, tab, a letter and the marker, and random ones."""
    import itertools
    import random

    import pyarrow as pa
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    _, words = pieces._model(PIECES)
    texts = ["".join(x) for n in range(6) for x in itertools.product("a \n\t▁", repeat=n)]
    rng = random.Random(4)
    texts += ["".join(chr(rng.choice([32, 32, 10, 13, 0xA0, 0x2028, 0x3000, 97, 98, 233, 0x4E2D, 0x1F600, rng.randrange(1, 0xD7FF)])) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    sizes, flat = words.ids(pa.array(texts))
    ends = sizes.cumsum()
    got = [flat[e - n : e].tolist() for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    assert got == model.encode(texts, num_threads=1)


def test_long_texts_without_blanks(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    text = "中文字" * 30_000
    docs = spark.createDataFrame([(1, text), (2, text + " x")], "doc_id long, text string")
    model, tokenizer = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BPE)
    assert {r.doc_id: r.n_tokens for r in pieces.round_trip_digests(docs, PIECES).collect()} == {i: len(model.encode(t)) + 2 for i, t in ((1, text), (2, text + " x"))}
    counts = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in ((1, text), (2, text + " x"))}
    assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, BPE).collect()} == counts
    packed = packing.pack_power_of_two(docs, BPE).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id: (r["sum(length)"], r["max(doc_tokens)"]) for r in packed} == {i: (n + 1, n + 1) for i, n in counts.items()}


def test_empty(docs):
    none = docs.limit(0)
    assert token_counts.token_counts(none, BPE).collect() == packing.pack_power_of_two(none, BPE).collect() == pieces.round_trip_digests(none, PIECES).collect() == []


def test_joined_chunks():
    """Chunks encoded as one text give the ids of whole texts, white space and special strings included."""
    from tokenizers import Tokenizer

    from cadenza.llm.chunktable import byte_level_table

    odd = ["", " ", "a  b", " a b ", "x <|endoftext|> y<|endoftext|>z", "a\n b c\t d", "it 's 's don't", "日本 語 a　b　c", "\x1c a \x85b c", "é ́x", "end ", "1 22 333  4444"]
    texts = odd + [" ".join(odd), "".join(odd), "\n".join(odd), " x" * 100_000]
    sizes, flat = byte_level_table(BPE).ids(pa.array([*texts, None]))
    whole = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [*map(len, whole), 0]
    assert flat.tolist() == [i for ids in whole for i in ids]


def test_remembered_chunks():
    """A second batch of 200,000 chunks that are known is not encoded again."""
    from cadenza.llm.chunktable import byte_level_table

    table = byte_level_table(BPE)
    texts = pa.array([" ".join(f"w{i:x}" for i in range(200_000))])
    first = table.ids(texts)
    table.encode = table.joined = lambda chunks: pytest.fail(f"{len(chunks)} chunks are encoded again")
    assert all(map(np.array_equal, first, table.ids(texts)))

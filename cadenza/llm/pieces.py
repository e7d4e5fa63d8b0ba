"""SentencePiece encoding and decoding through a distinct-chunk table."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import byte_slices

#: Bytes of text encoded at once in a worker.
BATCH_BYTES = 8 << 20
_MODELS: dict = {}


def _model(path: str):
    if path not in _MODELS:
        import sentencepiece

        from cadenza.llm.chunktable import sentencepiece_table

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _MODELS[path] = model, sentencepiece_table(model)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>) with begin and end ids, as the library encodes whole texts.

    Where no piece crosses a white-space marker, a text's ids are those of its marked
    words in turn: each distinct marked word of a batch is segmented once, and ids are
    joined back by position. A null text counts as empty; null ids and repeated rows
    pass through; other columns are ignored.
    """
    schema = pa.schema([("id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        model, words = _model(model_path)
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            ids, ends = _whole_ids(model, words, batch.column("text"))
            lists = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids.astype(np.int32))
            yield pa.record_batch([batch.column("id"), lists], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>").withColumnRenamed("id", id_col)


def _whole_ids(model, words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat uint16 ids with begin and end ids, and where each text ends."""
    sizes, flat = words.ids(texts)
    ends = np.cumsum(sizes + 2)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint16)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = inner[ends - sizes - 2] = False
    out[inner] = flat
    out[ends - 1], out[ends - sizes - 2] = model.eos_id(), model.bos_id()
    return out, ends


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, text) by the library's decode; null ids decode as an empty list."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string())])

    def run(batches):
        model, _ = _model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [model.decode(ids or []) for ids in part.column("ids").to_pylist()]
                yield pa.record_batch([part.column("id"), pa.array(texts, pa.string())], schema=schema)

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: (id, n_tokens, ids_sha256, decoded_sha256), without a shuffle."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        model, words = _model(model_path)
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            ids, ends = _whole_ids(model, words, batch.column("text"))
            at, n, raw, back = 0, [], [], []
            for end in ends.tolist():
                own = ids[at:end]
                n.append(end - at)
                raw.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(model.decode(own.tolist()).encode()).hexdigest())
                at = end
            yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(raw), pa.array(back)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    """Round trip of all documents by piece_bpe_32k.model, as digests."""
    import public_tokenizers

    from cadenza.llm.common import table

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))

"""Packing by power-of-two decomposition: no sequence crosses documents, none is padded."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import byte_slices, release
from cadenza.llm.token_counts import _table

#: Bytes of text whose ids and pieces are held at once.
BATCH_BYTES = 3 << 20


def binary_lengths(n: int, longest: int) -> list[int]:
    """Decreasing powers of two up to ``longest`` that sum to ``n``."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_power_of_two(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: (id, start, length, ids, ids_crc32, doc_tokens, bucket, sequence_id, offset).

    A document's ids, with ``end_id`` after them, are cut into pieces whose lengths are
    powers of two, the longest first. A piece is a whole sequence, so it starts at offset
    0 and needs no padding. ``bucket`` is the exponent: a trainer draws each batch from
    one bucket, in which all sequences are equally long. ``write_buckets`` lays them out
    by bucket.

    ``sequence_id`` comes from the scan's partition and row, so a recomputed partition
    gives the same ids and no ordering of the whole corpus is needed. A null or empty
    text has its end id only; null ids and repeated rows are packed like others.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    fields = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        table = _table(tokenizer_path)
        for batch in byte_slices(batches, "text", BATCH_BYTES):
            sizes, flat = table.ids(batch.column("text"))
            out: list[list] = [[] for _ in fields]
            at = 0
            for doc, n in zip(batch.column("id").to_pylist(), sizes.tolist(), strict=True):
                ids = np.append(flat[at : at + n].astype("<u4"), np.uint32(end_id))
                at += n
                raw, start = memoryview(ids.tobytes()), 0
                for size in binary_lengths(n + 1, length):
                    values = [doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n + 1]
                    if with_ids:
                        values.append(ids[start : start + size].astype(np.int32))
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    start += size
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            del sizes, flat, ids, raw, out, values
            release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spec = "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = rows.mapInArrow(run, spec)
    return pieces.select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids,
        F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write sequences as Parquet with a folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids of byte_bpe_50k.json."""
    import public_tokenizers

    from cadenza.llm.common import table

    return pack_power_of_two(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)



"""Token counts: batch encoding in an Arrow function that returns lengths only."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import byte_slices, released

#: Bytes of text encoded at once in a worker.
BATCH_BYTES = 12 << 20
_TABLES: dict = {}


def _table(path: str):
    if path not in _TABLES:
        from cadenza.llm.chunktable import byte_level_table

        _TABLES[path] = byte_level_table(path)
    return _TABLES[path]


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rows (id, n_bytes, n_tokens) for each row of ``docs``; a map without a shuffle.

    Batches are balanced by bytes, not rows. Texts are cut at single spaces between two
    characters that are not white space, where no token of a byte-level BPE can span, so
    a long text costs no more at once than its distinct chunks. Each distinct chunk of a
    batch is encoded once and its length is joined back by position.

    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows pass
    through; other columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        table = _table(tokenizer_path)
        for batch in byte_slices(batches, "text", batch_bytes):
            text = pc.fill_null(batch.column("text"), "")
            yield pa.record_batch([batch.column("id"), pc.binary_length(text).cast(pa.int64()), pa.array(table.lengths(text))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op5_token_counts(spark, sf_dir: str, limit: int = 512) -> DataFrame:
    """Counts by byte_bpe_50k.json for all documents, with a flag for those over ``limit``."""
    import public_tokenizers

    from cadenza.llm.common import table

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)

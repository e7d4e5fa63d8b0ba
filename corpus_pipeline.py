"""A corpus pipeline: toxic documents go, near-duplicates and repeated passages go, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import stored, table
from cadenza.llm.jaccard import keep_first
from cadenza.llm.packing import pack_power_of_two
from cadenza.llm.suffixes import strip_repeats
from cadenza.llm.toxicity import fit_toxicity, toxicity_column, training_part
from cadenza.session import ship

#: Documents scored at this or more are rejected.
TOXIC = 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the n-gram classifier, fitted on the labels' training folds, rejects.

    A null or empty text has the bias as its score; null ids and repeated rows are judged by
    their texts; a very long text is judged whole; other columns pass through.
    """
    model = fit_toxicity(training_part(docs), training_part(table(spark, sf_dir, "labels")))
    return docs.where(toxicity_column(model, F.col("text")) < TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component at Jaccard 0.75 of five-word shingles, the one of the smallest id.

    Null and empty texts are kept; null ids and repeated rows are documents like others; other
    columns pass through.
    """
    ship(spark)
    return keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes strings of 200 bytes that occur more than once; all documents stay, n_chars is counted anew.

    Characters that a removed span cut through are removed with it. A null text becomes empty;
    null ids and repeated rows are documents like others; other columns pass through.
    """
    ship(spark)
    done = strip_repeats(docs)
    counted = {"n_chars": F.char_length("text").cast("long")}
    return done.select(*[counted[c].alias(c) if c in counted else F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the ids of all documents into sequences of a power of two up to 1024.

    A null or empty text has its end id only; null ids and repeated rows are packed like others.
    """
    import public_tokenizers

    ship(spark)
    return pack_power_of_two(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packing)]

#: No SQL: a fitted classifier and a tokenizer decide. Tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents`` of ``sf_dir``; each stage's result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

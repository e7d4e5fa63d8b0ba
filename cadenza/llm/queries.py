"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from cadenza.llm.brown import op6_brown
from cadenza.llm.embeddings import OP8_SQL, op8_embeddings
from cadenza.llm.fingerprints import op2_fingerprints
from cadenza.llm.jaccard import op3_jaccard
from cadenza.llm.packing import op4_packing
from cadenza.llm.pieces import op9_pieces
from cadenza.llm.suffixes import op1_suffixes
from cadenza.llm.token_counts import op5_token_counts
from cadenza.llm.toxicity import op7_toxicity
from cadenza.llm.warc import OP10_SQL, op10_warc

QUERIES = {f.__name__: f for f in (op1_suffixes, op2_fingerprints, op3_jaccard, op4_packing, op5_token_counts, op6_brown, op7_toxicity, op8_embeddings, op9_pieces, op10_warc)}
ORACLE_SQL: dict[str, str] = {"op8_embeddings": OP8_SQL, "op10_warc": OP10_SQL}

"""Names, functions and DuckDB oracles of the training-data queries."""

from __future__ import annotations

from auditframe.llm import bpe, fingerprints, linededup, lm, media, neardup, packing, pii, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_bpe": bpe.op2_bpe,
    "op3_packing": packing.op3_packing,
    "op4_near_duplicates": neardup.op4_near_duplicates,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_lm": lm.op7_lm,
    "op8_media": media.op8_media,
    "op9_pii": pii.op9_pii,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLES = {"op1_warc": warc.OP1_SQL}

"""A corpus pipeline: from ``documents`` to packed training windows.

Each stage takes the session, the rows that its predecessor kept, and the folder of the
tables. ``run`` writes each stage's result as Parquet below the shared folder and reads it
again for the next one, so no stage recomputes another and a lost executor costs its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe.llm import linededup, neardup, packing, pii, toxicity
from auditframe.llm.common import shared_dir, table


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their ids and windows."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", toxicity.reject),
    ("line dedup", linededup.strip_lines),
    ("near duplicates", neardup.keep_one),
    ("pii", pii.mask),
    ("packing", pack),
]

#: SQL expresses none of the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    path = shared_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{path}/stage-{i}")
        docs = spark.read.parquet(f"{path}/stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to a training mix: language, lines, near-duplicates, contamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. In between, documents are written
as Parquet to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontam, langid, linededup, mixing, simhash
from quillspark.llm.common import materialize, table

STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", linededup.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontam.stage),
    ("mixing", mixing.stage),
]

#: Language prototypes, similarity links and components have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs

"""The corpus pipeline: documents in, packed token sequences out.

Each stage works on what the one before kept. All but the last return the
columns of documents; between stages the rows are written and read again, so a
lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orthant.llm import op1_language, op2_toxicity, op7_minhash, op9_secrets, op10_packing
from orthant.llm.common import Scratch, table

#: Toxic documents go; those without a known language go; one document of each group of near duplicates stays (five-word shingles, similarity 0.8); secrets are masked; all that is left is packed.
STAGES = [
    ("toxicity", op2_toxicity.stage),
    ("language_id", op1_language.stage),
    ("minhash_near_dedup", op7_minhash.stage),
    ("secret_scan", op9_secrets.stage),
    ("packing", op10_packing.stage),
]

#: The stages learn models and compare signatures, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, over the whole documents table; the pieces of packing.pack.

    Rows with a null doc_id are never copies of others. Of rows with equal ids
    all stay or go as copies. Null and empty texts, and those without a letter,
    go in the language stage. Without labels no document is toxic; without
    labelled languages every text with a letter stays. Columns beside those of
    documents are carried along whatever their names, and left out at last. An
    empty table gives no rows.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs

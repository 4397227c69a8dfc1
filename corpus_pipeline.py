"""Document pipeline over the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet to the shared folder and reads again for the next one. All
stages but the last return the columns of ``documents``.

1. toxicity: rows that score 0.3 or more go;
2. exact dedup: of equal texts the row with the least doc_id stays;
3. near dedup: one document of each group stays (shingles of five words,
   similarity 0.8 or more);
4. secret scans: found spans are replaced by a mark, all documents stay;
5. best-fit packing: what is left becomes token sequences; one row per piece.

A null text passes stages 1 to 4 as an empty one and stays null; an empty table
passes all of them. Columns beyond those of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopmetrics.llm.common import written
from shopmetrics.llm.exact_dedup import drop_exact_copies
from shopmetrics.llm.near_dedup import drop_near_copies
from shopmetrics.llm.packing import pack_documents
from shopmetrics.llm.secret_scans import redact_secrets
from shopmetrics.llm.toxicity import drop_toxic

STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_documents),
]

#: SQL cannot express the CRF, the tokenizer or the packer; tests hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

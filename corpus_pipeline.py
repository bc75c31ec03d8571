"""From raw documents to token ids: five stages, each over all that the one before it has kept.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns the documents for the next stage, with
the same columns (the last stage: ids and their digest). Each stage's result is written as Parquet to the folder that the
cluster shares and read back, so a lost executor costs no more than the stage that runs; it goes once the next is written.

Null texts are empty texts: quality scores them, secrets make them empty, all documents of equal text are one class, of which the
one of smallest id stays, once where its row is repeated. A row without an id is never a copy. Columns of the documents that bear
names of the stages' own are carried along. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkstream.llm._common import discard, stored, table
from inkstream.llm.bpe import encode_stage
from inkstream.llm.decontaminate import keep_uncontaminated
from inkstream.llm.near_dup import keep_first
from inkstream.llm.quality import keep_good
from inkstream.llm.secrets import redact

STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first),
    ("decontamination", keep_uncontaminated),
    ("secrets", redact),
    ("encoding", encode_stage),
]

#: No SQL: three of the stages cannot be expressed in it; tests/llm compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs

"""A training corpus from documents: toxic texts go, exact and near copies go, sources are mixed, texts are tokenised.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. `run` writes each stage's
result as Parquet into a folder that all executors share and reads it again, so nothing is computed twice and a lost
executor costs no more than its part of one stage. What a stage has read is deleted; the last result stays.

Cases, stage by stage. toxicity: a null or empty text isn't toxic; without usable labels nothing is. exact_dedup: null
texts stay, of empty ones one stays; repeated rows go but for one. minhash_dedup: texts without a word and rows without
identifier stay; rows that repeat an identifier stay or go together. mixing: a null source is a source; a source whose
budget is more than its tokens repeats its documents, so that rows of the result may repeat. bpe: a null text has null
tokens, an empty one none. Texts of any length are read whole, ties go by identifier, an empty table runs through to an
empty result, and all but the last stage keep further columns, whatever their names. Identifiers are whole numbers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tesselar.llm import bpe, exact, minhash, mixing, toxicity
from tesselar.llm.shared import remove, shared_folder

STAGES = [
    ("toxicity", toxicity.stage),
    ("exact_dedup", exact.stage),
    ("minhash_dedup", minhash.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: The fitted model of the first stage and the estimates of the third have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if k:
            remove(spark, f"{at}/{STAGES[k - 1][0]}")
    return docs

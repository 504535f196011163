"""A corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import documents, stored
from skein.llm.decontamination import drop_contaminated
from skein.llm.mixing import take_mix
from skein.llm.quality import keep_good
from skein.llm.simhash import keep_one
from skein.llm.tokens import encode_documents
from skein.sources.folders import shared_folder


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: what is read back from the token files of all documents.  The files
    stay, in the folder that the column ``files`` names."""
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    return encode_documents(docs, keep=folder).withColumn("files", F.lit(folder))


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", take_mix),
    ("token_ids", token_ids),
]

#: Learned rules, fingerprints and files have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

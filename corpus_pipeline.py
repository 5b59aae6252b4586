"""Training-data pipeline: ``documents`` to token files, in five stages.

Every stage reads all rows its predecessor kept, written as Parquet in between, so a lost executor
costs a stage's own work at most:

1. quality: documents that the quality classifier rejects go;
2. near_duplicates: of each SimHash group one document stays;
3. decontamination: documents that hold a benchmark region go;
4. mixing: sources are mixed to their target weights; a row is a run of words that a pass takes of a
   document, so a document can come twice, once or in parts;
5. token_files: the mixed texts are encoded in ascending doc_id order into Arrow token files; returns
   one row for each text, read back from the files.

All but the last return the columns of ``documents``.  Tables without rows give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tradelake.llm import quality
from tradelake.llm.common import pinned
from tradelake.llm.decontaminate import decontaminated
from tradelake.llm.mixing import mixed_documents
from tradelake.llm.simhash import drop_near_duplicates
from tradelake.llm.token_files import token_files

#: No SQL: learned scores, bit fingerprints with components, edit alignment and random draws.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, network)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

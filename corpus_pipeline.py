"""The corpus pipeline: documents that pass the quality rules, one of each group of near copies,
without secrets, mixed to the sources' weights, as BPE tokens.

Defined cases, as its stages define them: null and empty texts fail the quality rules; rows that share
an id are judged each, and one stays; rows with a null id are documents each; a null source is a
source of its own; very long texts pass every stage whole; of tied copies the least id stays; an empty
table gives an empty result; extra columns pass by, but ids and n_tokens, which the last stage makes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, mixing, neardup, quality, secrets
from quarry.llm.common import removed, scratch, shared_folder, written
from quarry.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least id."""
    return neardup.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return secrets.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return mixing.mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the text decoded from the tokens, with the token ids and their number."""
    return bpe.encoded(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("near dedup", near_dedup), ("secret scans", secret_scans), ("source mixing", source_mixing), ("bpe tokens", bpe_tokens)]
#: No SQL for perplexity, MinHash classes or BPE; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written as Parquet into the shared folder and read again by the next; they go when the next are written."""
    docs, to, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"{to}/{k}")
        if before:
            removed(spark, before)
        before = f"{to}/{k}"
    return docs

"""The corpus pipeline: quality, near duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame; all but the last return the columns of ``documents``.  ``run`` writes
each stage's rows below the shared checkpoint folder and reads them as the next one's docs.

Defined results, besides those of the operators: documents whose score is under 0.7 go; of a
group of near duplicates the smallest id stays (of its rows with those words, the first by
text), and rows without an id or a text are groups of their own; secrets are masked in the texts; a
mixed document appears once for each whole copy and once more for its extra blocks, and one
without words is not in a mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgrid.llm import catalogue, mixing, neardup, packing, quality, secrets
from roomgrid.session import scratch_path
from roomgrid.sources.tables import read_table

KEEP_SCORE = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").filter(catalogue.crc_mod("doc_id", 4) != 2)
    model = quality.fit(docs, labels, label_col="quality")
    return docs.filter(quality.score(F.col("text"), model) >= KEEP_SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, catalogue.tokenizer_path())


def _batched(fn: Callable[[SparkSession, DataFrame, str], DataFrame]):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        catalogue.settings(spark)
        return fn(spark, docs, sf_dir)
    run_stage.__name__ = fn.__name__
    return run_stage


STAGES = [("quality", _batched(quality_stage)), ("near_duplicates", _batched(near_duplicate_stage)),
          ("secrets", _batched(secret_stage)), ("mix", _batched(mix_stage)), ("pack", _batched(pack_stage))]

# Signatures, a trained model, a forest and BPE ids are beyond SQL: the tests hold the
# stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{name}")
            docs = spark.read.parquet(f"{base}/{name}")
    return docs

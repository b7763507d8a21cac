"""Readers for the driver tables (explicit schemas, never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roomgrid.schemas import DRIVER


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` with the declared schema; Catalyst prunes columns and
    pushes filters into this scan."""
    return spark.read.schema(DRIVER[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count of a driver table.  For parquet this is answered from file footers."""
    return read_table(spark, sf_dir, name).count()


def read_split(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row: a table of fewer files than the cluster has
    cores (such as one big row group) is dealt over them; more files are read as they are."""
    df = read_table(spark, sf_dir, name)
    cores = int(spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism)
    return df.repartition(cores) if len(df.inputFiles()) < cores else df

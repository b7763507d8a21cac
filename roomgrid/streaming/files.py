"""File sources of streams: a folder of table files read in micro-batches, and the splitting
of a table into files that arrive in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roomgrid.functions.text import normalize_user_key
from roomgrid.schemas import MESSAGE_IN


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.parquet",
                max_files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(folder))


def message_stream(spark: SparkSession, source: dict) -> DataFrame:
    """Inbound form messages as a stream, by configuration: ``format`` (json unless told; any file
    format of Spark's stream readers), ``path``, and ``options`` for the reader.  The rows have the
    declared message columns; a field of another type or a missing one is null, as is every field
    of a line that is not JSON."""
    reader = spark.readStream.schema(MESSAGE_IN).format(source.get("format", "json"))
    return reader.options(**source.get("options", {})).load(source["path"])


def addressed(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with their user key, messages that have no id or text, with a reason)."""
    reason = (F.when(F.col("message_id").isNull(), F.lit("missing message_id"))
              .when(F.col("text").isNull(), F.lit("missing text")))
    rows = messages.withColumn("reject_reason", reason)
    good = rows.filter(F.col("reject_reason").isNull()).drop("reject_reason") \
        .withColumn("user_key", normalize_user_key(F.col("from_raw")))
    return good, rows.filter(F.col("reject_reason").isNotNull())


def write_in_order(df: DataFrame, column: str, parts: int, folder: str) -> str:
    """Write a table as ``parts`` files, one after another, by ranges of a numeric column, so
    that a file stream reads them in that order.  Returns the folder."""
    cuts = sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.01)))
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = df if lo is None else df.filter(F.col(column) >= lo)
        part = part if hi is None else part.filter(F.col(column) < hi)
        # all cores read and filter; only the rows of the part come to the one that writes its file
        part.repartition(1).sortWithinPartitions(column).write.mode("append").parquet(folder)
    return folder


def run_to_end(writer, checkpoint: str) -> None:
    """Start a stream writer on everything that is there, resume from ``checkpoint``, and wait."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

"""Message streams: inbound turns -> chats, favorites, inquiries; trace log; de-duplication.

``foreachBatch`` applies the batch operators to each micro-batch and writes every sink under
``batch_id=<n>`` with overwrite, so a retried batch replaces its own output instead of
duplicating it (exactly-once per sink).  Outputs and checkpoints are the caller's paths: a
second run continues where the first one ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roomgrid.streaming.files import run_to_end

PAYLOAD = "id string, payload string, created_at timestamp"


def run_sinks(spark: SparkSession, stream: DataFrame, outputs_of: Callable[[DataFrame], dict[str, DataFrame]],
              output: str, checkpoint: str, shared: Callable[[DataFrame], DataFrame] = lambda b: b) -> dict[str, DataFrame]:
    """``shared(batch)`` is computed once per micro-batch and kept for its sinks,
    ``outputs_of(shared)`` names them.  Returns the sinks read back (with ``batch_id``)."""
    names: dict[str, object] = {}

    def sink(batch: DataFrame, batch_id: int) -> None:
        kept = shared(batch).persist()
        try:
            for name, df in outputs_of(kept).items():
                names[name] = df.schema
                df.write.mode("overwrite").parquet(f"{output}/{name}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    run_to_end(stream.writeStream.foreachBatch(sink), checkpoint)
    if not names:      # nothing new in this run: the sinks of the earlier ones
        names = {n: df.schema for n, df in outputs_of(shared(spark.createDataFrame([], stream.schema))).items()}
    return {n: spark.read.schema(schema).parquet(f"{output}/{n}") for n, schema in names.items()}


def run_trace_log(spark: SparkSession, stream: DataFrame, to_chats, output: str, checkpoint: str) -> DataFrame:
    """Streaming trace log: every micro-batch of turns becomes chats (``to_chats``), one
    trace per chat is built and appended as JSON lines (one object per line)."""
    from roomgrid.operators.history import build_traces, trace_payload

    def sink(batch: DataFrame, batch_id: int) -> None:
        payload = trace_payload(build_traces(to_chats(batch)))
        payload.write.mode("overwrite").json(f"{output}/batch_id={batch_id}")

    run_to_end(stream.writeStream.foreachBatch(sink), checkpoint)
    return spark.read.schema(PAYLOAD).json(output)


def dedupe_stream(chats: DataFrame, within_seconds: float) -> DataFrame:
    """Streaming de-duplication of chats: a repetition by the same user within the window is
    dropped; the state holds the chats of the window only."""
    return chats.withWatermark("created_at", f"{int(within_seconds * 1000)} milliseconds") \
        .dropDuplicatesWithinWatermark(["user_id", "user_message", "bot_response"])


def run_dedupe(spark: SparkSession, chats: DataFrame, within_seconds: float, output: str, checkpoint: str) -> DataFrame:
    stream = dedupe_stream(chats, within_seconds)
    run_to_end(stream.writeStream.format("parquet").option("path", output).outputMode("append"), checkpoint)
    return spark.read.schema(stream.schema).parquet(output)

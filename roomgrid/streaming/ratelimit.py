"""Streaming rate limiter: per-user state (last request time, requests in the current
session) kept by ``applyInPandasWithState``.

Within a micro-batch a user's rows are sorted by (ts, event_id) and processed with vectorised
numpy.  A user's group per micro-batch is bounded by the trigger size (maxFilesPerTrigger /
maxBytesPerTrigger), not by the user's history, which lives in the state store.  A user's
state expires when the watermark has passed the end of the session, as the counter of the
reference does, so the state holds the users of the last ``gap`` only.  Users may have ids of
any type.  For time-ordered input the output equals the batch operator
``operators.ratelimit`` (without the session's number, which nobody keeps for ever).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from roomgrid.streaming.files import run_to_end

STATE_SCHEMA = "last_us long, n long"


def _limiter(gap_us: int, max_requests: int):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs), ignore_index=True)
        if pdf.empty:
            return
        pdf = pdf.sort_values(["t", "event_id"], kind="mergesort").reset_index(drop=True)
        t = pdf["t"].to_numpy(np.int64)
        if state.exists:
            last_us, n0 = state.get
        else:
            last_us, n0 = None, 0
        prev = np.empty_like(t)
        prev[1:] = t[:-1]
        start = np.zeros(len(t), dtype=bool)
        start[1:] = t[1:] >= prev[1:] + gap_us
        start[0] = last_us is None or t[0] >= last_us + gap_us
        idx = np.arange(len(t))
        last_start = np.maximum.accumulate(np.where(start, idx, -1))
        ordinal = np.where(last_start >= 0, idx - last_start + 1, n0 + idx + 1)
        state.update((int(t[-1]), int(ordinal[-1])))
        # the session ends at last + gap; a timeout must lie after the watermark
        state.setTimeoutTimestamp(max((int(t[-1]) + gap_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": pdf["event_id"], "user_id": key[0],
                            "ordinal": ordinal.astype("int64"), "allowed": ordinal <= max_requests})
    return fn


def limiter_stream(events: DataFrame, gap_seconds: float, max_requests: int) -> DataFrame:
    """(event_id, user_id, ordinal, allowed) of a stream of (event_id, user_id, ts)."""
    gap_us = int(round(gap_seconds * 1_000_000))
    src = events.withWatermark("ts", f"{int(gap_seconds * 1000)} milliseconds") \
        .select("event_id", "user_id", "ts", F.unix_micros("ts").alias("t"))
    kinds = dict(src.dtypes)
    out = f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, ordinal long, allowed boolean"
    return src.groupBy("user_id").applyInPandasWithState(
        _limiter(gap_us, max_requests), out, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def run_limiter(spark: SparkSession, events: DataFrame, gap_seconds: float, max_requests: int,
                output: str, checkpoint: str) -> DataFrame:
    """Run the limiter over all events that a stream has by now, appending to the parquet table
    ``output`` and resuming from ``checkpoint``; returns the table."""
    stream = limiter_stream(events, gap_seconds, max_requests)
    run_to_end(stream.writeStream.format("parquet").option("path", output).outputMode("append"), checkpoint)
    return spark.read.schema(stream.schema).parquet(output)

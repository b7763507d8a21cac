"""Keyed request limiter as a batch job (gaps and islands).

Reference semantics: every request increments a per-user counter and re-arms its expiry
(denied requests too); a request is allowed while the counter is <= max.  The counter
therefore lives for an *inactivity session*: a request at least ``gap`` after the previous
one (of the same user, allowed or not) starts a new session.  At exactly ``gap`` the key
has expired, so the boundary is ``ts >= prev + gap`` (Spark's session_window would merge
that case, so it is not used).

Skew: a user may own a large share of all requests, so the ordered work is split by
(user, time chunk).  Each chunk is ordered on its own; a small per-chunk summary table
carries session numbers and in-session counts across chunk borders with running sums.
No task ever holds more than one (user, chunk) group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The reference's defaults (6 requests, 15 s).
DEFAULT_MAX = 6
DEFAULT_WINDOW_SECONDS = 15


def _us(ts: Column) -> Column:
    return F.unix_micros(ts)


def sessions(events: DataFrame, gap_seconds: float = DEFAULT_WINDOW_SECONDS,
             max_requests: int = DEFAULT_MAX, user: str = "user_id", ts: str = "ts",
             order: str = "event_id", chunk_seconds: int = 3600) -> DataFrame:
    """-> events + session_no (1-based per user), ordinal (position in the session) and
    allowed (ordinal <= max_requests)."""
    gap = int(round(gap_seconds * 1_000_000))
    ck = int(chunk_seconds) * 1_000_000
    ev = events.withColumn("_t", _us(F.col(ts))).withColumn("_chunk", F.floor(F.col("_t") / F.lit(ck)))
    w_in = Window.partitionBy(user, "_chunk").orderBy("_t", order)
    ev = (ev.withColumn("_rn", F.row_number().over(w_in))
            .withColumn("_prev", F.lag("_t").over(w_in)))
    ev = ev.withColumn("_inner_start", F.col("_prev").isNotNull()
                       & (F.col("_t") >= F.col("_prev") + F.lit(gap)))

    # per-chunk summary (one row per user and chunk)
    ch = ev.groupBy(user, "_chunk").agg(
        F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("_inner_start").cast("long")).alias("_starts_in"),
        F.max(F.when(F.col("_inner_start"), F.col("_rn"))).alias("_last_in_rn"))
    wc = Window.partitionBy(user).orderBy("_chunk")
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    upto = wc.rowsBetween(Window.unboundedPreceding, 0)
    ch = ch.withColumn("_first_start", F.lag("_last").over(wc).isNull()
                       | (F.col("_first") >= F.lag("_last").over(wc) + F.lit(gap)))
    ch = (ch.withColumn("_cstarts", F.col("_starts_in") + F.col("_first_start").cast("long"))
            .withColumn("_offset", F.coalesce(F.sum("_cstarts").over(before), F.lit(0)))
            .withColumn("_S", F.sum("_n").over(upto))
            .withColumn("_last_start_rn", F.coalesce(F.col("_last_in_rn"),
                                                     F.when(F.col("_first_start"), F.lit(1))))
            .withColumn("_tail", F.when(F.col("_cstarts") > 0,
                                        F.col("_n") - F.col("_last_start_rn") + 1))
            .withColumn("_S_at_start", F.when(F.col("_cstarts") > 0, F.col("_S"))))
    ch = ch.withColumn("_carry_in",
                       F.last("_tail", ignorenulls=True).over(before)
                       + (F.col("_S") - F.col("_n")) - F.last("_S_at_start", ignorenulls=True).over(before))
    ch = ch.select(user, "_chunk", "_first_start", "_offset", "_carry_in")

    j = ev.join(ch, [user, "_chunk"])
    j = j.withColumn("_is_start", F.col("_inner_start") | ((F.col("_rn") == 1) & F.col("_first_start")))
    run = w_in.rowsBetween(Window.unboundedPreceding, 0)
    j = (j.withColumn("_starts_so_far", F.sum(F.col("_is_start").cast("long")).over(run))
          .withColumn("_ls", F.max(F.when(F.col("_is_start"), F.col("_rn"))).over(run)))
    ordinal = F.when(F.col("_ls").isNull(), F.col("_carry_in") + F.col("_rn")) \
        .otherwise(F.col("_rn") - F.col("_ls") + 1)
    out = (j.withColumn("session_no", F.col("_offset") + F.col("_starts_so_far"))
            .withColumn("ordinal", ordinal.cast("long"))
            .withColumn("allowed", F.col("ordinal") <= F.lit(max_requests)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def denied_per_user(sess: DataFrame, user: str = "user_id") -> DataFrame:
    return sess.groupBy(user).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.sum((~F.col("allowed")).cast("long")).alias("n_denied"),
        F.max("session_no").alias("n_sessions"))


def time_until_reset(events: DataFrame, as_of_us: int,
                     gap_seconds: float = DEFAULT_WINDOW_SECONDS, user: str = "user_id",
                     ts: str = "ts") -> DataFrame:
    """Seconds until each user's counter expires at ``as_of`` (0 when already expired)."""
    gap = int(round(gap_seconds * 1_000_000))
    last = events.groupBy(user).agg(F.max(_us(F.col(ts))).alias("_last"))
    return last.select(user, F.greatest(F.lit(0.0), (F.col("_last") + F.lit(gap) - F.lit(as_of_us))
                                        .cast("double") / F.lit(1e6)).alias("reset_in_seconds"))

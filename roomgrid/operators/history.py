"""Chat log: store, de-duplicate, recent history, role/content expansion, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomgrid.functions.text import ANON
from roomgrid.operators.dialogue import critique

TRACE_TASK = "answer a renter's message"   # default of ``build_traces(task=...)``
TRACE_TOOL = "route_message"
SUBSTEPS = ["read the message", "choose a route", "compose the reply"]
TRADEOFF_STOP = "the reply stands; another round would only cost time"
TRADEOFF_REVISE = "another round costs time but the reply does not help yet"


def save_chats(rows: DataFrame) -> DataFrame:
    """Chat rows to store: anonymous senders are skipped (keyed by message id, so a
    re-run writes the same rows)."""
    return rows.filter(F.col("user_key") != F.lit(ANON))


def dedupe_chats(chats: DataFrame, within_seconds: float = 5.0) -> DataFrame:
    """Drop a chat when the same user stored the same (message, reply) at most
    ``within_seconds`` earlier.  The window is keyed by (user, message, reply), so even
    a user holding a large share of all chats is split across many partitions."""
    w = Window.partitionBy("user_id", "user_message", "bot_response").orderBy("created_at", "id")
    prev = F.lag("created_at").over(w)
    dup = prev.isNotNull() & ((F.unix_micros("created_at") - F.unix_micros(prev))
                              <= F.lit(int(within_seconds * 1_000_000)))
    return chats.withColumn("_dup", dup).filter(~F.col("_dup")).drop("_dup")


def recent_chats(chats: DataFrame, n: int = 10, newest: bool = True) -> DataFrame:
    """N chats per user (newest N by default, oldest N for the reference's behaviour),
    numbered in chronological order; Spark plans a per-partition WindowGroupLimit, so
    a hot user is trimmed before the shuffle."""
    order = [F.col("created_at").desc(), F.col("id").desc()] if newest else \
        [F.col("created_at").asc(), F.col("id").asc()]
    w = Window.partitionBy("user_id").orderBy(*order)
    top = chats.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    wc = Window.partitionBy("user_id").orderBy("created_at", "id")
    return top.withColumn("pos", F.row_number().over(wc).cast("long")).drop("_r")


def chat_history(recent: DataFrame) -> DataFrame:
    """Each chat becomes two messages (user, assistant) in order."""
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("user_message").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("bot_response").alias("content")))
    e = recent.select("user_id", "pos", F.posexplode(msgs).alias("k", "m"))
    return e.select("user_id", ((F.col("pos") - 1) * 2 + F.col("k") + 1).cast("long").alias("seq"),
                    F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def build_traces(chats: DataFrame, task: str = TRACE_TASK) -> DataFrame:
    """One trace per chat: deterministic id, epoch ms, session id, task and goal, the four
    ordered steps (plan, act, critique, decision) as an array of structs with JSON content, result.
    The plan has its substeps, the act the tool and its arguments, the decision the tradeoff."""
    ok, decision, note = critique(F.col("bot_response"))
    msg = F.coalesce(F.col("user_message"), F.lit(""))
    reply = F.coalesce(F.col("bot_response"), F.lit(""))
    excerpt = F.substring(msg, 1, 120)

    def step(no: int, kind: str, content: list[Column], success: Column) -> Column:
        return F.struct(F.lit(no).alias("step_no"), F.lit(kind).alias("step_type"),
                        F.to_json(F.struct(*content)).alias("content"), success.alias("success"))

    steps = F.array(
        step(1, "plan", [msg.alias("restated_goal"), F.array(*[F.lit(s) for s in SUBSTEPS]).alias("substeps")], F.lit(True)),
        step(2, "act", [F.lit(TRACE_TOOL).alias("tool"), F.struct(excerpt.alias("message_excerpt"),
                                                                  F.length(msg).alias("len")).alias("args")], F.lit(True)),
        step(3, "critique", [F.substring(reply, 1, 200).alias("observation"), ok.alias("meets_goal"), note.alias("note")], ok),
        step(4, "decision", [decision.alias("decision"),
                             F.when(ok, F.lit(TRADEOFF_STOP)).otherwise(F.lit(TRADEOFF_REVISE)).alias("tradeoff")], F.lit(True)))
    ts_ms = F.unix_millis("created_at")
    return chats.select(
        F.concat(F.lit("t-"), F.sha2(F.col("id").cast("string"), 256)).alias("trace_id"),
        F.col("id").alias("chat_id"), "user_id", ts_ms.alias("ts_ms"),
        F.concat(F.col("user_id"), F.lit("-"), F.floor(ts_ms / 1000).cast("string")).alias("session_id"),
        F.lit(task).alias("task"), excerpt.alias("goal"), F.length(msg).cast("long").alias("msg_len"),
        ok.alias("meets_goal"), decision.alias("decision"),
        F.substring(reply, 1, 200).alias("reply_preview"), steps.alias("steps"))


def trace_payload(traces: DataFrame) -> DataFrame:
    """agent_traces rows: (id, payload JSON, created_at)."""
    return traces.select(F.col("trace_id").alias("id"),
                         F.to_json(F.struct(*[c for c in traces.columns])).alias("payload"),
                         F.timestamp_millis("ts_ms").alias("created_at"))


def steps_log(traces: DataFrame) -> DataFrame:
    """Traces as an event log of steps (one row per step)."""
    return traces.select("trace_id", F.explode("steps").alias("s")).select("trace_id", "s.*")


def collect_steps(log: DataFrame) -> DataFrame:
    """Step log back to one row per trace, steps in step order (a trace has a handful of
    steps, so the per-group collect is bounded)."""
    g = log.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "step_type",
                                                                         "success"))).alias("st"))
    return g.select("trace_id", F.size("st").cast("long").alias("n_steps"),
                    F.array_join(F.transform("st", lambda s: s["step_type"]), ",").alias("step_types"),
                    F.aggregate("st", F.lit(True), lambda a, s: a & s["success"]).alias("all_success"))

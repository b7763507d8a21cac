"""Registered streaming queries; their oracles are the batch ones (batch = stream).  The tables
arrive as several files, so every stream runs over more than one micro-batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomgrid.functions.text import ANON
from roomgrid.operators import language as LANG
from roomgrid.plans import q_dialogue as QD
from roomgrid.plans import q_history as QH
from roomgrid.plans import q_limits
from roomgrid.plans.q_text import intent_model
from roomgrid.plans.registry import REGISTRY, register
from roomgrid.session import scratch_path
from roomgrid.sources import views as V
from roomgrid.sources.tables import read_split, read_table, row_count
from roomgrid.streaming.files import addressed, file_stream, message_stream, run_to_end, write_in_order
from roomgrid.streaming.ratelimit import run_limiter
from roomgrid.streaming.route import run_dedupe, run_sinks

FILES = 3


@register("stream_rate_limit")
def stream_rate_limit(spark, d):
    """The limiter as a stateful stream over the events, in files by time."""
    base = scratch_path(spark, "limiter")
    events = read_table(spark, d, "events").select("event_id", "user_id", "ts")
    folder = write_in_order(events.withColumn("t", F.unix_micros("ts").cast("double")), "t", FILES, f"{base}/in")
    out = run_limiter(spark, file_stream(spark, folder, events.schema), q_limits.GAP_SECONDS, q_limits.MAX_REQUESTS,
                      f"{base}/out", f"{base}/checkpoint")
    return out.select("event_id", "user_id", "ordinal", "allowed")


REGISTRY["stream_rate_limit"] = (stream_rate_limit, "SELECT event_id, user_id, ordinal, allowed FROM ("
                                 + REGISTRY["rate_limit_sessions"][1] + ")")


@register("stream_route", views=("messages_v", "users_v"), sql=f"""
WITH {QD.ROUTED_SQL}, {QD.USERS_SQL}, {QD.COMMAND_USERS_SQL},
bot AS (SELECT conv_id * 1000 + turn - 1 AS id, {QD.REPLY_SQL} AS bot_response FROM conversations WHERE role = 'assistant')
SELECT 'routed' AS sink, message_id, user_key AS user_id, route AS a, lang AS b FROM routed
UNION ALL SELECT 'chats', message_id, ups.id, r.text, bot.bot_response
  FROM routed r JOIN ups ON ups.phone_number = r.user_key LEFT JOIN bot ON bot.id = r.message_id WHERE r.user_key <> 'anon'
UNION ALL SELECT 'favorites', message_id, cups.id, listing_ref, NULL
  FROM routed r JOIN cups ON cups.phone_number = r.user_key WHERE route = 'save' AND listing_ref IS NOT NULL
UNION ALL SELECT 'inquiries', message_id, cups.id, listing_ref,
  coalesce(nullif({QD.strip_sql("substring(r.text, instr(r.text, r.listing_ref) + length(r.listing_ref))")}, ''),
           '{QD.DLG.DEFAULT_INQUIRY}')
  FROM routed r JOIN cups ON cups.phone_number = r.user_key WHERE route = 'inquiry' AND listing_ref IS NOT NULL
""")
def stream_route(spark, d):
    """Inbound turns as a stream: each micro-batch is routed once with the batch operators (the
    models are trained once) and written to its four sinks, with user ids."""
    base = scratch_path(spark, "route")
    turns = read_table(spark, d, "conversations")
    folder = write_in_order(turns, "conv_id", FILES, f"{base}/in")
    model = LANG.train_profile(read_split(spark, d, "documents"), path=f"{base}/language")
    intents = intent_model(V.messages(spark, d), f"{base}/intents")
    n_part, users = row_count(spark, d, "part"), V.users(spark, d)

    def shared(batch):
        rows = QD.routed_messages(spark, d, V.messages_from(batch, n_part), model, intents)
        return QD.with_user_ids(users, rows.join(QH.bot_replies(batch), "message_id", "left"))

    def sinks(rows):
        save, ask = (QD.commands(rows).filter(F.col("route") == r) for r in ("save", "inquiry"))
        return {"routed": rows.select("message_id", F.col("user_key").alias("user_id"), F.col("route").alias("a"), F.col("lang").alias("b")),
                "chats": rows.filter(F.col("user_key") != ANON).select(
                    "message_id", "user_id", F.col("text").alias("a"), F.col("bot_response").alias("b")),
                "favorites": QD.favorites(save).select("message_id", "user_id", F.col("listing_ref").alias("a"),
                                                       F.lit(None).cast("string").alias("b")),
                "inquiries": QD.inquiries(ask).select("message_id", "user_id", F.col("listing_ref").alias("a"),
                                                      F.col("message").alias("b"))}

    got = run_sinks(spark, file_stream(spark, folder, turns.schema), sinks, f"{base}/out", f"{base}/checkpoint", shared)
    out = None
    for name, df in got.items():
        part = df.select(F.lit(name).alias("sink"), "message_id", "user_id", "a", "b")
        out = part if out is None else out.unionByName(part)
    return out


@register("stream_dedupe_chats", views=("chats_raw_v",), sql=f"""
SELECT user_id, user_message, bot_response FROM (
  SELECT *, lag(created_at) OVER (PARTITION BY user_id, user_message, bot_response ORDER BY created_at, id) AS prev
  FROM chats_raw_v)
WHERE prev IS NULL OR epoch_us(created_at) - epoch_us(prev) > {QH.DEDUPE_SECONDS * 1_000_000}
""")
def stream_dedupe_chats(spark, d):
    """Chat de-duplication as a stream with a watermark."""
    base = scratch_path(spark, "dedupe")
    chats = V.chats_raw(spark, d).withColumn("t", F.unix_micros("created_at").cast("double"))
    folder = write_in_order(chats, "t", FILES, f"{base}/in")
    out = run_dedupe(spark, file_stream(spark, folder, chats.schema), QH.DEDUPE_SECONDS, f"{base}/out", f"{base}/checkpoint")
    return out.select("user_id", "user_message", "bot_response")


@register("stream_messages", views=("messages_v",), sql=f"""
SELECT message_id, {QD.user_key_sql('from_raw')} AS user_key, text, ts FROM messages_v
""")
def stream_messages(spark, d):
    """Form messages as a stream named by configuration: files of JSON lines, some to a trigger,
    appended with their user keys to a table that a second start adds nothing to."""
    base = scratch_path(spark, "messages")
    V.messages(spark, d).select("message_id", "from_raw", "text", "ts").write.json(f"{base}/in")
    source = {"format": "json", "path": f"{base}/in", "options": {"maxFilesPerTrigger": "2"}}
    for _ in range(2):
        good, _rejected = addressed(message_stream(spark, source))
        run_to_end(good.select("message_id", "user_key", "text", "ts").writeStream.format("parquet")
                   .option("path", f"{base}/out"), f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")

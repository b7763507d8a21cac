"""Registered chat-history and trace queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from roomgrid.operators import history as H
from roomgrid.operators.dialogue import DEGRADED_PHRASES
from roomgrid.plans.q_dialogue import PARSED_SQL, REPLY_SQL, USERS_SQL, parsed_messages, replies_of, with_user_ids
from roomgrid.plans.registry import register
from roomgrid.sources import views as V
from roomgrid.sources.tables import read_table

DEDUPE_SECONDS = 5
RECENT_N = 3


@register("save_chats", views=("messages_v", "users_v"), sql=f"""
WITH {PARSED_SQL}, {USERS_SQL},
bot AS (SELECT conv_id * 1000 + turn - 1 AS id, {REPLY_SQL} AS bot_response FROM conversations WHERE role = 'assistant')
SELECT r.message_id AS id, u.id AS user_id, r.text AS user_message, bot.bot_response, r.route, r.ts AS created_at
FROM routed r JOIN ups u ON u.phone_number = r.user_key LEFT JOIN bot ON bot.id = r.message_id
WHERE r.user_key <> 'anon'
""")
def save_chats(spark, d):
    """Chat rows written by the message path (anonymous senders skipped): the sender resolved
    to a user id after one upsert for the whole batch, the reply, and the time."""
    r = H.save_chats(parsed_messages(spark, d))
    return chat_rows(with_user_ids(V.users(spark, d), r), bot_replies(read_table(spark, d, "conversations")))


def bot_replies(cv):
    """The assistant's reply to each user message, by message id."""
    return replies_of(cv.filter(F.col("role") == "assistant")).select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("message_id"), F.col("text").alias("bot_response"))


def chat_rows(rows, replies):
    return rows.join(replies, "message_id", "left").select(
        F.col("message_id").alias("id"), "user_id", F.col("text").alias("user_message"), "bot_response", "route",
        F.col("ts").alias("created_at"))


@register("dedupe_chats", views=("chats_raw_v",), sql=f"""
SELECT id, user_id FROM (
  SELECT *, lag(created_at) OVER (PARTITION BY user_id, user_message, bot_response
                                  ORDER BY created_at, id) AS prev
  FROM chats_raw_v)
WHERE prev IS NULL OR epoch_us(created_at) - epoch_us(prev) > {DEDUPE_SECONDS * 1_000_000}
""")
def dedupe_chats(spark, d):
    return H.dedupe_chats(V.chats_raw(spark, d), DEDUPE_SECONDS).select("id", "user_id")


@register("recent_chats", views=("chats_v",), sql=f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r
           FROM chats_v)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS pos,
       id, user_message, bot_response
FROM t WHERE r <= {RECENT_N}
""")
def recent_chats(spark, d):
    """Newest N chats per user in chronological order (only the columns the history
    needs are read)."""
    c = V.chats(spark, d).select("id", "user_id", "user_message", "bot_response", "created_at")
    return H.recent_chats(c, RECENT_N).select("user_id", "pos", "id", "user_message", "bot_response")


@register("chat_history", views=("chats_v",), sql=f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS r
           FROM chats_v),
p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) AS pos,
             user_message, bot_response FROM t WHERE r <= {RECENT_N})
SELECT user_id, (pos - 1) * 2 + 1 AS seq, 'user' AS role, user_message AS content FROM p
UNION ALL
SELECT user_id, (pos - 1) * 2 + 2 AS seq, 'assistant' AS role, bot_response AS content FROM p
""")
def chat_history(spark, d):
    c = V.chats(spark, d).select("id", "user_id", "user_message", "bot_response", "created_at")
    return H.chat_history(H.recent_chats(c, RECENT_N))


# Chats whose replies have every outcome: the table's replies, changed as ``replies_of`` does.
TOLD_SQL = f"""
told AS (SELECT c.id, c.user_id, c.user_message, c.created_at, b.bot_response
         FROM chats_v c LEFT JOIN (SELECT conv_id * 1000 + turn - 1 AS id, {REPLY_SQL} AS bot_response
                                   FROM conversations WHERE role = 'assistant') b USING (id)),
crit AS (SELECT *, NOT ({" OR ".join("contains(lower(coalesce(bot_response, '')), '{}')".format(p.replace("'", "''"))
                                     for p in DEGRADED_PHRASES)}) AS ok FROM told)"""


def told_chats(spark, d):
    return V.chats(spark, d).drop("bot_response").join(
        bot_replies(read_table(spark, d, "conversations")).withColumnRenamed("message_id", "id"), "id", "left")


def step_contents(traces):
    """The steps of a trace as text: type, success and the parsed content fields."""
    field = lambda s, f: F.coalesce(F.get_json_object(s["content"], f), F.lit("-"))
    return F.array_join(F.transform("steps", lambda s: F.concat_ws(
        "|", s["step_no"].cast("string"), s["step_type"], s["success"].cast("string"), field(s, "$.restated_goal"),
        field(s, "$.substeps[1]"), field(s, "$.tool"), field(s, "$.args.len"), field(s, "$.observation"), field(s, "$.meets_goal"),
        field(s, "$.decision"), field(s, "$.tradeoff"))), chr(10))


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


@register("build_traces", views=("chats_v",), sql=f"""
WITH {TOLD_SQL}
SELECT 't-' || sha256(CAST(id AS VARCHAR)) AS trace_id, id AS chat_id, user_id,
       epoch_ms(created_at) AS ts_ms,
       user_id || '-' || CAST(epoch_ms(created_at) // 1000 AS VARCHAR) AS session_id,
       {_quoted(H.TRACE_TASK)} AS task,
       substring(coalesce(user_message, ''), 1, 120) AS goal,
       length(coalesce(user_message, '')) AS msg_len,
       ok AS meets_goal,
       CASE WHEN ok THEN 'stop' ELSE 'revise' END AS decision,
       substring(coalesce(bot_response, ''), 1, 200) AS reply_preview,
       '1|plan|true|' || coalesce(user_message, '') || '|{H.SUBSTEPS[1]}|-|-|-|-|-|-' || chr(10)
       || '2|act|true|-|-|{H.TRACE_TOOL}|' || CAST(length(coalesce(user_message, '')) AS VARCHAR) || '|-|-|-|-' || chr(10)
       || '3|critique|' || CAST(ok AS VARCHAR) || '|-|-|-|-|' || substring(coalesce(bot_response, ''), 1, 200) || '|'
       || CAST(ok AS VARCHAR) || '|-|-' || chr(10)
       || '4|decision|true|-|-|-|-|-|-|' || CASE WHEN ok THEN 'stop|{H.TRADEOFF_STOP}' ELSE 'revise|{H.TRADEOFF_REVISE}' END AS steps
FROM crit
""")
def build_traces(spark, d):
    t = H.build_traces(told_chats(spark, d))
    return t.withColumn("steps", step_contents(t))


@register("trace_steps_collect", views=("chats_v",), sql=f"""
WITH {TOLD_SQL},
steps AS (SELECT id, unnest(['plan', 'act', 'critique', 'decision']) AS step_type, unnest([1, 2, 3, 4]) AS step_no, ok FROM crit)
SELECT 't-' || sha256(CAST(id AS VARCHAR)) AS trace_id, count(*) AS n_steps,
       string_agg(step_type, ',' ORDER BY step_no) AS step_types,
       bool_and(CASE WHEN step_type = 'critique' THEN ok ELSE true END) AS all_success
FROM steps GROUP BY id
""")
def trace_steps_collect(spark, d):
    """Traces flattened to a step log and collected back in step order."""
    log = H.steps_log(H.build_traces(told_chats(spark, d)))
    return H.collect_steps(log)

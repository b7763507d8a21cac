"""Registered message-understanding queries: user keys, routing, command parsing,
favorites, inquiries, replies, critique, label normalisation, user upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from roomgrid.functions.text import ANON, SPACE, normalize_user_key
from roomgrid.operators import dialogue as DLG
from roomgrid.operators import language as LANG
from roomgrid.operators.load import hashed_id
from roomgrid.operators.load import upsert_users as upsert
from roomgrid.plans.oracle_views import (blank_sql, keyword_stage_sql, map_code_sql, nb_intent_ctes,
                                         nb_lang_ctes, strip_sql)
from roomgrid.plans.q_text import INTENT_CUTOFF, intent_model, with_intent
from roomgrid.plans.registry import register
from roomgrid.session import scratch_path
from roomgrid.sources import snapshots as SNAP
from roomgrid.sources import views as V
from roomgrid.sources.tables import read_split, read_table

def user_key_sql(x: str) -> str:
    return (f"CASE WHEN {blank_sql(x)} THEN 'anon' ELSE 'whatsapp:' || "
            f"regexp_replace(replace({strip_sql(x)}, 'whatsapp:', ''), '^\\++', '') END")


def route_sql(x: str, intent: str = "coalesce(i.intent, 'fallback')") -> str:
    low = f"lower({x})"
    return (f"CASE WHEN {blank_sql(x)} THEN 'blank' "
            f"WHEN {intent} = 'search_listings' OR ({intent} = 'fallback' AND (contains({low}, 'rent') "
            f"OR contains({low}, 'bedsitter') OR contains({low}, 'room'))) THEN 'search' "
            f"WHEN {intent} = 'save_listing' OR starts_with({low}, 'save ') THEN 'save' "
            f"WHEN {intent} = 'create_inquiry' OR starts_with({low}, 'inquire') "
            f"OR contains({low}, 'book viewing') THEN 'inquiry' "
            f"WHEN {intent} = 'greeting' THEN 'greeting' ELSE 'fallback' END")


def listing_ref_sql(x: str) -> str:
    return f"nullif(regexp_extract({x}, '([0-9a-fA-F\\-]{{8,}})', 1), '')"


PARSED_SQL = f"""
{nb_intent_ctes(INTENT_CUTOFF)},
routed AS (
  SELECT m.message_id, m.text, m.ts, {user_key_sql('m.from_raw')} AS user_key,
         {route_sql('m.text')} AS route, {listing_ref_sql('m.text')} AS listing_ref
  FROM messages_v m LEFT JOIN intents i ON i.k = m.message_id)"""

ROUTED_SQL = f"""
{nb_lang_ctes('p', 'messages_v', 'message_id', 'text')},
{nb_intent_ctes(INTENT_CUTOFF)},
routed AS (
  SELECT m.message_id, m.text, m.ts, {user_key_sql('m.from_raw')} AS user_key,
         coalesce({keyword_stage_sql('m.text')}, {map_code_sql('b.label')}) AS lang,
         {route_sql('m.text')} AS route, {listing_ref_sql('m.text')} AS listing_ref
  FROM messages_v m LEFT JOIN p_best b ON b.k = m.message_id LEFT JOIN intents i ON i.k = m.message_id)"""


def parsed_messages(spark, d, msgs=None, intents=None):
    """messages -> user key, intent, route and parsed command fields (no language)."""
    msgs = V.messages(spark, d) if msgs is None else msgs
    intents = intents or intent_model(V.messages(spark, d))
    m = with_intent(msgs, intents)
    m = m.withColumn("user_key", normalize_user_key(F.col("from_raw"))) \
         .withColumn("route", DLG.route(F.col("text"), F.col("intent")))
    return DLG.parse_commands(m)


def routed_messages(spark, d, msgs=None, model=None, intents=None):
    """``parsed_messages`` with the language of each message."""
    model = model or LANG.train_profile(read_split(spark, d, "documents"))
    return LANG.detect(model, parsed_messages(spark, d, msgs, intents), "message_id")


@register("normalize_user_keys", views=("messages_v",), sql=f"""
SELECT message_id, from_raw, {user_key_sql('from_raw')} AS user_key FROM messages_v
""")
def normalize_user_keys(spark, d):
    m = V.messages(spark, d)
    return m.select("message_id", "from_raw", normalize_user_key(F.col("from_raw")).alias("user_key"))


@register("route_messages", views=("messages_v",), sql=f"""
WITH {ROUTED_SQL}
SELECT message_id, user_key, lang, route FROM routed
""")
def route_messages(spark, d):
    return routed_messages(spark, d).select("message_id", "user_key", "lang", "route")


# Free-text model answers and replies, derived from the turns so that every outcome occurs.
ANSWERS = {0: "search_listings. ", 1: "greeting! ", 3: "save_listing ", 5: "fallback,"}
ANSWER_SQL = ("CASE (conv_id * 1000 + turn) % 7 " + " ".join(f"WHEN {k} THEN '{v}' || text" for k, v in ANSWERS.items())
              + " WHEN 2 THEN chr(160) WHEN 6 THEN '_greeting_ ' || text ELSE text END")
REPLY_SQL = ("CASE (conv_id * 1000 + turn) % 5 WHEN 0 THEN 'SORRY, ' || text WHEN 1 THEN text || ' Please try later.' "
             "WHEN 2 THEN 'We couldn''t find it: ' || text ELSE text END")


def answers(cv):
    k = (F.col("conv_id") * 1000 + F.col("turn")) % 7
    out = F.when(k == 2, F.lit("\u00a0")).when(k == 6, F.concat(F.lit("_greeting_ "), "text")).otherwise(F.col("text"))
    for i, v in ANSWERS.items():
        out = F.when(k == i, F.concat(F.lit(v), "text")).otherwise(out)
    return cv.withColumn("text", out)


def replies_of(cv):
    k = (F.col("conv_id") * 1000 + F.col("turn")) % 5
    return cv.withColumn("text", F.when(k == 0, F.concat(F.lit("SORRY, "), "text"))
                         .when(k == 1, F.concat("text", F.lit(" Please try later.")))
                         .when(k == 2, F.concat(F.lit("We couldn't find it: "), "text")).otherwise(F.col("text")))


_LABELS = "(" + ", ".join(f"'{x}'" for x in DLG.INTENTS) + ")"


@register("label_normalize", sql=f"""
WITH a AS (SELECT conv_id, turn, {ANSWER_SQL} AS text FROM conversations),
t AS (SELECT *, string_split_regex({strip_sql('text')}, '{SPACE}+')[1] AS tok FROM a),
c AS (SELECT *, regexp_replace(tok, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS cleaned,
             regexp_replace(tok, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS strict_cleaned FROM t)
SELECT conv_id, turn,
       CASE WHEN NOT {blank_sql('text')} AND cleaned IN {_LABELS} THEN cleaned ELSE 'fallback' END AS label,
       CASE WHEN {blank_sql('text')} THEN 0.0 WHEN cleaned IN {_LABELS} THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence,
       CASE WHEN NOT {blank_sql('text')} AND strict_cleaned IN {_LABELS} THEN strict_cleaned ELSE 'fallback' END AS strict_label
FROM c
""")
def label_normalize(spark, d):
    """Normalise free-text model answers (one for each conversation turn) to a label."""
    cv = answers(read_table(spark, d, "conversations"))
    label, conf = DLG.normalize_label(F.col("text"))
    strict, _ = DLG.normalize_label(F.col("text"), strict=True)
    return cv.select("conv_id", "turn", label.alias("label"), conf.alias("confidence"),
                     strict.alias("strict_label"))


_BAD = " OR ".join("contains(lower(text), '{}')".format(p.replace("'", "''")) for p in DLG.DEGRADED_PHRASES)


@register("critique_replies", sql=f"""
WITH r AS (SELECT conv_id, turn, {REPLY_SQL} AS text FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, NOT ({_BAD}) AS ok, CASE WHEN {_BAD} THEN 'revise' ELSE 'stop' END AS decision,
       substring(text, 1, 200) AS observation
FROM r
""")
def critique_replies(spark, d):
    cv = replies_of(read_table(spark, d, "conversations").filter(F.col("role") == "assistant"))
    ok, decision, _ = DLG.critique(F.col("text"))
    return cv.select("conv_id", "turn", ok.alias("ok"), decision.alias("decision"),
                     DLG.excerpt(F.col("text"), 200).alias("observation"))


TEMPLATES_SQL = "tpl(tkey, lang_group, text) AS (VALUES " + ", ".join(
    "('{}', '{}', '{}')".format(k, g, t.replace("'", "''")) for k, g, t in DLG.TEMPLATES) + ")"


@register("canned_replies", views=("messages_v",), sql=f"""
WITH {TEMPLATES_SQL}, {ROUTED_SQL},
k AS (SELECT r.*,
             CASE WHEN lang IN ('sw', 'sheng') THEN 'sw' ELSE 'en' END AS grp,
             CASE WHEN route = 'blank' THEN 'blank'
                  WHEN route = 'save' AND listing_ref IS NULL THEN 'save_missing_id'
                  WHEN route = 'inquiry' AND listing_ref IS NULL THEN 'inquiry_missing_id'
                  WHEN route = 'greeting' THEN 'greeting'
                  WHEN route = 'fallback' THEN 'fallback' END AS tkey
      FROM routed r WHERE route <> 'search')
SELECT k.message_id, k.route, k.lang,
       CASE WHEN route = 'save' AND listing_ref IS NOT NULL
            THEN '{DLG.SAVED_PREFIX}' || listing_ref || '{DLG.SAVED_SUFFIX}'
            WHEN route = 'inquiry' AND listing_ref IS NOT NULL
            THEN '{DLG.INQUIRY_DONE_PREFIX}' || listing_ref || '{DLG.INQUIRY_DONE_SUFFIX}'
            ELSE coalesce(t1.text, t2.text) END AS reply
FROM k LEFT JOIN tpl t1 ON t1.tkey = k.tkey AND t1.lang_group = k.grp
       LEFT JOIN tpl t2 ON t2.tkey = k.tkey AND t2.lang_group = 'en'
""")
def canned_replies(spark, d):
    """Replies of the non-search routes: template by (route, language group) with
    English fallback, and the confirmation texts of saves and inquiries."""
    r = routed_messages(spark, d).filter(F.col("route") != "search")
    out = DLG.command_replies(spark, r)
    return out.select("message_id", "route", "lang", "reply")


def _keys(rows):
    return rows.select(F.col("user_key").alias("phone_number"))


def users_sql(name: str = "ups", where: str = "user_key <> 'anon'") -> str:
    return f"""
{name} AS (SELECT coalesce(u.id, 'u-' || sha256(i.phone_number)) AS id,
               coalesce(u.phone_number, i.phone_number) AS phone_number, u.full_name,
               u.id IS NULL AS is_new
        FROM users_v u FULL OUTER JOIN (SELECT DISTINCT user_key AS phone_number FROM routed WHERE {where}) i
          ON i.phone_number = u.phone_number)"""


USERS_SQL = users_sql()
COMMAND = "route IN ('save', 'inquiry') AND listing_ref IS NOT NULL"
COMMAND_USERS_SQL = users_sql("cups", COMMAND)


@register("upsert_users", views=("messages_v", "users_v"), sql=f"""
WITH routed AS (SELECT {user_key_sql('from_raw')} AS user_key FROM messages_v), {USERS_SQL}
SELECT id, phone_number, full_name, is_new FROM ups
""")
def upsert_users(spark, d):
    """Keyed upsert of message senders into users (existing ids and attributes kept)."""
    rows = V.messages(spark, d).select(normalize_user_key(F.col("from_raw")).alias("user_key"))
    return upsert(V.users(spark, d), _keys(rows.filter(F.col("user_key") != ANON))) \
        .select("id", "phone_number", "full_name", "is_new")


def snapshot_sql(name: str, base: str, batch: str) -> str:
    """The users ``base`` after the senders that satisfy ``batch``."""
    return f"""
{name} AS (SELECT coalesce(u.id, 'u-' || sha256(i.phone_number)) AS id,
               coalesce(u.phone_number, i.phone_number) AS phone_number, u.full_name
        FROM {base} u FULL OUTER JOIN
             (SELECT DISTINCT user_key AS phone_number FROM keyed WHERE user_key <> 'anon' AND {batch}) i
          ON i.phone_number = u.phone_number)"""


@register("user_snapshots", views=("messages_v", "users_v"), sql=f"""
WITH none AS (SELECT id, phone_number, full_name FROM users_v WHERE false),
keyed AS (SELECT message_id, {user_key_sql('from_raw')} AS user_key FROM messages_v),
{snapshot_sql('one', 'none', 'message_id % 3 = 0')},
{snapshot_sql('two', 'one', 'message_id % 3 <> 0')}
SELECT 2 AS version, id, phone_number, full_name FROM one
UNION ALL SELECT 3, id, phone_number, full_name FROM two
UNION ALL SELECT 4, coalesce(two.id, u.id), coalesce(two.phone_number, u.phone_number), coalesce(u.full_name, two.full_name)
          FROM two FULL OUTER JOIN users_v u ON u.phone_number = two.phone_number
""")
def user_snapshots(spark, d):
    """Upserts that stick: an empty table, two batches of senders, then the known users, whose
    names go to the rows of their keys; each is committed as a version of its own, and the first
    batch once more changes nothing.  All versions are read by number."""
    keyed = V.messages(spark, d).select("message_id", normalize_user_key(F.col("from_raw")).alias("user_key")) \
        .filter(F.col("user_key") != ANON)
    path = f"{scratch_path(spark, 'users')}/table"

    def batch(name, where):
        SNAP.commit(spark, path, name, lambda users: upsert(users, _keys(keyed.filter(where)))
                    .select("id", "phone_number", "full_name"))

    def named(users):
        u = V.users(spark, d).select(F.col("id").alias("_id"), "phone_number", F.col("full_name").alias("_name"))
        return users.join(u, "phone_number", "full_outer").select(
            F.coalesce("id", "_id").alias("id"), "phone_number", F.coalesce("_name", "full_name").alias("full_name"))

    third = F.col("message_id") % 3 == 0
    SNAP.commit(spark, path, "empty", lambda _: V.users(spark, d).limit(0))
    batch("first", third)
    batch("second", ~third)
    SNAP.commit(spark, path, "names", named)
    batch("first", third)
    out = [SNAP.read(spark, path, v.number).withColumn("version", F.lit(v.number))
           for v in SNAP.versions(spark, path)]
    return reduce(lambda a, b: a.unionByName(b), out).select("version", "id", "phone_number", "full_name")


def commands(parsed):
    return parsed.filter(F.col("route").isin("save", "inquiry") & F.col("listing_ref").isNotNull())


@register("upsert_command_users", views=("messages_v", "users_v"), sql=f"""
WITH {PARSED_SQL}, {COMMAND_USERS_SQL}
SELECT id, phone_number, full_name, is_new FROM cups
""")
def upsert_command_users(spark, d):
    """The users that favorites and inquiries point to: the anonymous sender included, as
    that path does not exclude it."""
    return upsert(V.users(spark, d), _keys(commands(parsed_messages(spark, d)))) \
        .select("id", "phone_number", "full_name", "is_new")


def with_user_ids(users, rows):
    """Resolve user keys to the ids that the upsert gives them, once per batch.  The anonymous
    key may hold a large share of the rows: its id is known and does not go through the join."""
    ids = users.select(F.col("id").alias("_id"), F.col("phone_number").alias("user_key"))
    named = rows.filter(F.col("user_key") != ANON).join(ids, "user_key", "left") \
        .withColumn("user_id", F.coalesce("_id", hashed_id("u-", F.col("user_key")))).drop("_id")
    anon = rows.filter(F.col("user_key") == ANON).withColumn("user_id", hashed_id("u-", F.col("user_key")))
    return named.unionByName(anon)


@register("favorites_from_messages", views=("messages_v", "users_v"), sql=f"""
WITH {PARSED_SQL}, {COMMAND_USERS_SQL}
SELECT r.message_id, u.id AS user_id, r.listing_ref, TRY_CAST(r.listing_ref AS BIGINT) AS listing_id, r.ts AS created_at
FROM routed r LEFT JOIN cups u ON u.phone_number = r.user_key
WHERE r.route = 'save' AND r.listing_ref IS NOT NULL
""")
def favorites_from_messages(spark, d):
    r = commands(parsed_messages(spark, d)).filter(F.col("route") == "save")
    return favorites(with_user_ids(V.users(spark, d), r))


def favorites(rows):
    return rows.select("message_id", "user_id", "listing_ref",
                       F.expr("try_cast(listing_ref AS BIGINT)").alias("listing_id"), F.col("ts").alias("created_at"))


@register("inquiries_from_messages", views=("messages_v", "users_v"), sql=f"""
WITH {PARSED_SQL}, {COMMAND_USERS_SQL}
SELECT r.message_id, u.id AS user_id, r.listing_ref, TRY_CAST(r.listing_ref AS BIGINT) AS listing_id,
       coalesce(nullif({strip_sql("substring(r.text, instr(r.text, r.listing_ref) + length(r.listing_ref))")}, ''),
                '{DLG.DEFAULT_INQUIRY}') AS message, r.ts AS created_at
FROM routed r LEFT JOIN cups u ON u.phone_number = r.user_key
WHERE r.route = 'inquiry' AND r.listing_ref IS NOT NULL
""")
def inquiries_from_messages(spark, d):
    r = commands(parsed_messages(spark, d)).filter(F.col("route") == "inquiry")
    return inquiries(with_user_ids(V.users(spark, d), r))


def inquiries(rows):
    return rows.select("message_id", "user_id", "listing_ref",
                       F.expr("try_cast(listing_ref AS BIGINT)").alias("listing_id"),
                       F.col("inquiry_message").alias("message"), F.col("ts").alias("created_at"))

"""The listing-model views of ``roomgrid.sources.views`` stated in DuckDB SQL.

Used only to build the SQL oracles; ``with_views`` prepends the CTEs a statement needs
(dependencies first).
"""

from __future__ import annotations

from roomgrid.functions.text import SPACE
from roomgrid.operators.language import SHENG_KEYWORDS

NSUP = "(SELECT count(*) FROM supplier)"
NPART = "(SELECT count(*) FROM part)"


def pad8(x: str) -> str:
    return f"printf('%08d', CAST({x} AS BIGINT))"


def ts_of(seconds: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_seconds({seconds}))"


VIEWS: dict[str, tuple[list[str], str]] = {
    "landlords_v": ([], f"""
        SELECT s_suppkey AS id, s_suppkey - CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END AS user_id, s_name AS name,
               '+2547' || {pad8('s_suppkey')} AS contact_number,
               'landlord' || CAST(s_suppkey AS VARCHAR) || '@mail.test' AS email,
               s_acctbal > 0 AS is_verified, s_nationkey
        FROM supplier"""),
    "complexes_v": ([], """
        SELECT s_suppkey AS id,
               'Complex ' || CAST(s_suppkey - CASE WHEN s_suppkey % 20 = 18 THEN 2 ELSE 0 END AS VARCHAR) AS name,
               n_name AS location, s_suppkey AS landlord_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        WHERE s_suppkey % 2 = 0"""),
    "listings_v": ([], f"""
        SELECT p_partkey AS id, CASE WHEN p_partkey % 89 <> 3 THEN p_name END AS title, p_brand AS description,
               p_type AS property_type, n_name AS location, p_retailprice AS price,
               false AS is_bargainable, CAST(p_size AS DOUBLE) AS size_sqm,
               CASE p_partkey % 3 WHEN 0 THEN 'Furnished' WHEN 1 THEN 'Unfurnished' END AS furnishing,
               list_slice(['wifi', 'water', 'parking'], 1, CAST(p_partkey % 4 AS INTEGER)) AS amenities,
               CAST(NULL AS VARCHAR) AS utilities, CAST(NULL AS VARCHAR) AS renovations,
               CAST(p_partkey % 51 AS DOUBLE) / 10.0 AS neighborhood_rating,
               lid AS landlord_id, CASE WHEN lid % 2 = 0 THEN lid END AS complex_id,
               {ts_of('p_partkey')} AS created_at
        FROM (SELECT *, CASE WHEN p_partkey % 97 <> 5 THEN p_partkey % ({NSUP} + 1) END AS lid FROM part)
             LEFT JOIN supplier ON s_suppkey = lid LEFT JOIN nation ON s_nationkey = n_nationkey"""),
    "ingest_v": (["listings_v"], """
        SELECT * FROM listings_v
        UNION ALL SELECT * REPLACE (CAST(NULL AS BIGINT) AS id) FROM listings_v WHERE id % 101 = 7
        UNION ALL SELECT -id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, landlord_id, NULL, NULL
        FROM listings_v WHERE id % 103 = 11"""),
    "users_v": ([], f"""
        SELECT CAST(c_custkey AS VARCHAR) AS id, 'whatsapp:2547' || {pad8('c_custkey')} AS phone_number,
               c_name AS full_name
        FROM customer"""),
    "reviews_v": ([], f"""
        SELECT event_id AS id, event_id % {NPART} AS listing_id, user_id,
               CAST(1 + event_id % 6 AS INTEGER) AS rating, ts AS created_at
        FROM events WHERE event_type = 'purchase'"""),
    "messages_v": ([], f"""
        SELECT * FROM (
          SELECT conv_id * 1000 + turn AS message_id, conv_id,
               CASE conv_id % 5
                    WHEN 0 THEN 'whatsapp:+2547' || {pad8('conv_id')}
                    WHEN 1 THEN '+2547' || {pad8('conv_id')}
                    WHEN 2 THEN '  whatsapp:2547' || {pad8('conv_id')} || chr(9)
                    WHEN 3 THEN '2547' || {pad8('conv_id')}
                    ELSE '' END AS from_raw,
               CASE WHEN (conv_id * 1000 + turn) % 7 = 0 THEN 'save ' || {pad8(f'(conv_id * 1000 + turn) % {NPART}')} || ' ' || text
                    WHEN (conv_id * 1000 + turn) % 7 = 1 THEN 'inquire ' || {pad8(f'(conv_id * 1000 + turn) % {NPART}')} || ' ' || text
                    WHEN (conv_id * 1000 + turn) % 7 = 2 THEN 'book viewing ' || text
                    WHEN (conv_id * 1000 + turn) % 7 = 4 THEN 'hello there ' || text
                    WHEN (conv_id * 1000 + turn) % 7 = 5 THEN 'looking for a room to rent ' || text
                    WHEN (conv_id * 1000 + turn) % 11 = 0 THEN 'niko ' || text
                    ELSE text END AS text,
               {ts_of('conv_id * 1000 + turn')} AS ts,
               CASE (conv_id * 1000 + turn) % 7 WHEN 0 THEN 'save_listing' WHEN 1 THEN 'create_inquiry'
                    WHEN 2 THEN 'create_inquiry' WHEN 4 THEN 'greeting' WHEN 5 THEN 'search_listings'
                    ELSE 'fallback' END AS told_intent
          FROM conversations WHERE role = 'user'
          UNION ALL
          SELECT conv_id * 1000 + turn + 500, conv_id,
               CASE conv_id % 5
                    WHEN 0 THEN 'whatsapp:+2547' || {pad8('conv_id')}
                    WHEN 1 THEN '+2547' || {pad8('conv_id')}
                    WHEN 2 THEN '  whatsapp:2547' || {pad8('conv_id')} || chr(9)
                    WHEN 3 THEN '2547' || {pad8('conv_id')}
                    ELSE '' END,
               chr(160) || chr(10), {ts_of('conv_id * 1000 + turn + 500')}, 'fallback'
          FROM conversations WHERE role = 'user' AND (conv_id * 1000 + turn) % 7 = 3)"""),
    "chats_v": ([], f"""
        SELECT u.conv_id * 1000 + u.turn AS id, CAST(u.conv_id AS VARCHAR) AS user_id,
               u.text AS user_message, a.text AS bot_response,
               {ts_of('u.conv_id * 1000 + u.turn')} AS created_at
        FROM (SELECT * FROM conversations WHERE role = 'user') u
        LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') a
          ON a.conv_id = u.conv_id AND a.turn - 1 = u.turn"""),
    "chats_raw_v": (["chats_v"], """
        SELECT * FROM chats_v
        UNION ALL
        SELECT id + 500, user_id, user_message, bot_response, created_at + INTERVAL 1 SECOND
        FROM chats_v WHERE id % 3 = 0"""),
}


def with_views(body: str, *names: str) -> str:
    order: list[str] = []

    def add(n):
        for d in VIEWS[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


# ---- text helpers in SQL ----
SHENG_SQL_LIST = "[" + ", ".join(f"'{k}'" for k in SHENG_KEYWORDS) + "]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def blank_sql(x: str) -> str:
    return f"coalesce({strip_sql(x)}, '') = ''"


def keyword_stage_sql(x: str) -> str:
    return (f"CASE WHEN {blank_sql(x)} THEN 'other' "
            f"WHEN list_has_any(string_split_regex(lower({strip_sql(x)}), '{SPACE}+'), {SHENG_SQL_LIST}) "
            f"THEN 'sheng' END")


def letters_sql(x: str) -> str:
    t = f"trim(regexp_replace(lower({x}), '[^\\p{{L}}]+', ' ', 'g'))"
    return f"CASE WHEN coalesce({t}, '') = '' THEN '' ELSE ' ' || {t} || ' ' END"


def nb_lang_ctes(prefix: str, src: str, key: str, text: str, n: int = 3) -> str:
    """CTEs ending in {prefix}_best(k, label): char n-gram NB trained on documents.lang; texts
    without letters are not in it."""
    p = prefix
    return f"""
{p}_dt AS (SELECT lang AS label, {letters_sql('text')} AS t FROM documents WHERE lang IS NOT NULL),
{p}_tg AS (SELECT label, substring(t, i, {n}) AS token
           FROM (SELECT label, t, unnest(generate_series(1, length(t) - {n - 1})) AS i FROM {p}_dt)),
{p}_counts AS (SELECT label, token, count(*) AS n FROM {p}_tg GROUP BY label, token),
{p}_cls AS (SELECT label, count(*) AS n_docs,
                   sum(CASE WHEN length(t) >= {n} THEN length(t) - {n - 1} ELSE 0 END) AS total
            FROM {p}_dt GROUP BY label),
{p}_voc AS (SELECT count(DISTINCT token) AS v FROM {p}_counts),
{p}_tot AS (SELECT sum(n_docs) AS nd FROM {p}_cls),
{p}_pt AS (SELECT {key} AS k, {letters_sql(text)} AS t FROM {src}),
{p}_pg AS (SELECT k, substring(t, i, {n}) AS token
           FROM (SELECT k, t, unnest(generate_series(1, length(t) - {n - 1})) AS i FROM {p}_pt)),
{p}_tf AS (SELECT k, token, count(*) AS tf FROM {p}_pg GROUP BY k, token),
{p}_pn AS (SELECT k, length(t) - {n - 1} AS n_tok FROM {p}_pt WHERE t <> ''),
{p}_part AS (SELECT k, label, sum(tf * ln(n + 1.0)) AS s
             FROM {p}_tf JOIN {p}_counts USING (token) GROUP BY k, label),
{p}_score AS (SELECT pn.k, c.label,
                     ln(c.n_docs / tot.nd) - pn.n_tok * ln(c.total + voc.v) + coalesce(pp.s, 0) AS score
              FROM {p}_pn pn CROSS JOIN {p}_cls c CROSS JOIN {p}_voc voc CROSS JOIN {p}_tot tot
              LEFT JOIN {p}_part pp ON pp.k = pn.k AND pp.label = c.label),
{p}_best AS (SELECT k, label FROM (
               SELECT k, label, row_number() OVER (PARTITION BY k ORDER BY score DESC, label) AS rn
               FROM {p}_score) WHERE rn = 1)"""


WORDS_SQL = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def words_sql(x: str) -> str:
    return WORDS_SQL.format(x=x)


def nb_intent_ctes(cutoff: float, src: str = "messages_v") -> str:
    """CTEs ending in intents(k, predicted, intent): word NB of the messages' told intents."""
    return f"""
i_tr AS (SELECT message_id AS k, told_intent AS label, {words_sql('text')} AS toks FROM {src}),
i_cnt AS (SELECT label, token, count(*) AS n FROM (SELECT label, unnest(toks) AS token FROM i_tr) GROUP BY label, token),
i_cls AS (SELECT label, count(*) AS n_docs, sum(len(toks)) AS total FROM i_tr GROUP BY label),
i_voc AS (SELECT count(DISTINCT token) AS v FROM i_cnt),
i_tot AS (SELECT sum(n_docs) AS nd FROM i_cls),
i_tf AS (SELECT k, token, count(*) AS tf FROM (SELECT k, unnest(toks) AS token FROM i_tr) GROUP BY k, token),
i_part AS (SELECT k, label, sum(tf * ln(n + 1.0)) AS s FROM i_tf JOIN i_cnt USING (token) GROUP BY k, label),
i_sc AS (SELECT i_tr.k, c.label,
                ln(c.n_docs / i_tot.nd) - len(i_tr.toks) * ln(c.total + i_voc.v) + coalesce(i_part.s, 0) AS score
         FROM i_tr CROSS JOIN i_cls c CROSS JOIN i_voc CROSS JOIN i_tot
         LEFT JOIN i_part ON i_part.k = i_tr.k AND i_part.label = c.label),
i_best AS (SELECT k, label, score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, label) rn
                                        FROM i_sc) WHERE rn = 1),
i_post AS (SELECT i_sc.k, 1.0 / sum(exp(i_sc.score - b.score)) AS p FROM i_sc JOIN i_best b USING (k) GROUP BY i_sc.k),
intents AS (SELECT b.k, b.label AS predicted, CASE WHEN p.p >= {cutoff} THEN b.label ELSE 'fallback' END AS intent
            FROM i_best b JOIN i_post p USING (k))"""


def map_code_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN 'other' WHEN {x} = 'sw' THEN 'sw' "
            f"WHEN starts_with({x}, 'en') THEN 'en' ELSE {x} END")

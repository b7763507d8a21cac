"""Registered integrity, delete-propagation and row-policy queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomgrid import schemas as SC
from roomgrid.operators import integrity as I
from roomgrid.plans.registry import register
from roomgrid.sources import views as V
from roomgrid.sources.tables import read_table

EXPECTED_DIM = 64  # dimension of the driver's vectors (the DDL declares 1536)


def key_tables(spark, d):
    """The model's tables as far as keys and declared rules go, from their base tables."""
    return {"users": V.users(spark, d), "landlords": V.landlords(spark, d), "complexes": V.complexes(spark, d),
            "listings": V.listing_keys(spark, d), "reviews": V.reviews(spark, d), "chats": V.chat_keys(spark, d),
            "listings_embeddings": V.listing_embeddings(spark, d)}


VIEW_OF = {t: f"{t}_v" for t in SC.PRIMARY_KEYS} | {
    "listings_embeddings": "(SELECT vec_id AS listing_id FROM embeddings)"}


@register("check_constraints", views=("reviews_v", "landlords_v", "complexes_v", "listings_v", "chats_v"),
          sql="SELECT 'reviews' AS table_name, 'check:rating' AS rule, CAST(id AS VARCHAR) AS row_key FROM reviews_v "
              "WHERE rating IS NOT NULL AND (rating < 1 OR rating > 5)" + "".join(
                  f" UNION ALL SELECT '{t}', 'not_null:{c}', CAST(id AS VARCHAR) FROM {t}_v WHERE {c} IS NULL"
                  for t, cols in SC.NOT_NULL.items() for c in cols))
def check_constraints(spark, d):
    """CHECK and the declared NOT NULL columns."""
    tables = key_tables(spark, d)
    parts = [I.check_range(tables["reviews"], "reviews", "rating", 1, 5)]
    parts += [I.not_null(tables[t], t, cols) for t, cols in SC.NOT_NULL.items()]
    return reduce(DataFrame.unionByName, parts)


_UNIQUE = [(t, c) for t, cols in SC.UNIQUE_KEYS.items() for c in cols] + list(SC.PRIMARY_KEYS.items())


@register("unique_violations", views=("users_v", "landlords_v", "complexes_v", "listings_v", "reviews_v", "chats_v"),
          sql=" UNION ALL ".join(
              f"SELECT '{t}' AS table_name, '{c}' AS key_cols, CAST({c} AS VARCHAR) AS key_value, count(*) AS n "
              f"FROM {VIEW_OF[t]} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1" for t, c in _UNIQUE))
def unique_violations(spark, d):
    """The declared UNIQUE and PRIMARY KEY columns."""
    tables = key_tables(spark, d)
    return reduce(DataFrame.unionByName, [I.duplicates(tables[t], t, [c]) for t, c in _UNIQUE])


@register("fk_orphans", views=("users_v", "landlords_v", "complexes_v", "listings_v", "reviews_v", "chats_v"),
          sql=" UNION ALL ".join(
              f"SELECT '{t}' AS child_table, '{c}' AS fk_column, CAST(x.{SC.PRIMARY_KEYS[t]} AS VARCHAR) AS child_key "
              f"FROM {VIEW_OF[t]} x WHERE x.{c} IS NOT NULL AND NOT EXISTS "
              f"(SELECT 1 FROM {VIEW_OF[p]} y WHERE CAST(y.{SC.PRIMARY_KEYS[p]} AS VARCHAR) = CAST(x.{c} AS VARCHAR))"
              for t, c, p, _ in SC.FOREIGN_KEYS))
def fk_orphans(spark, d):
    """All declared foreign keys."""
    return I.orphans(key_tables(spark, d), SC.PRIMARY_KEYS, SC.FOREIGN_KEYS)


@register("check_vector_dim", sql=f"""
SELECT len(embedding) AS dim, count(*) AS n, len(embedding) = {EXPECTED_DIM} AS ok
FROM embeddings GROUP BY len(embedding)
""")
def check_vector_dim(spark, d):
    return I.vector_dims(read_table(spark, d, "embeddings"), EXPECTED_DIM)


@register("cascade_delete", views=("users_v", "landlords_v", "complexes_v", "listings_v", "reviews_v", "chats_v"), sql="""
WITH du AS (SELECT id FROM users_v WHERE CAST(id AS BIGINT) % 7 = 3),
dl AS (SELECT id FROM landlords_v WHERE CAST(user_id AS VARCHAR) IN (SELECT id FROM du)),
dc AS (SELECT id FROM complexes_v WHERE landlord_id IN (SELECT id FROM dl)),
dli AS (SELECT id FROM listings_v WHERE landlord_id IN (SELECT id FROM dl))
SELECT 'users' AS table_name, id AS row_key, CAST(NULL AS VARCHAR) AS complex_id FROM users_v WHERE id NOT IN (SELECT id FROM du)
UNION ALL SELECT 'landlords', CAST(id AS VARCHAR), NULL FROM landlords_v WHERE id NOT IN (SELECT id FROM dl)
UNION ALL SELECT 'complexes', CAST(id AS VARCHAR), NULL FROM complexes_v WHERE id NOT IN (SELECT id FROM dc)
UNION ALL SELECT 'listings', CAST(id AS VARCHAR),
  CASE WHEN complex_id IN (SELECT id FROM dc) THEN NULL ELSE CAST(complex_id AS VARCHAR) END
  FROM listings_v WHERE id NOT IN (SELECT id FROM dli)
UNION ALL SELECT 'listings_embeddings', CAST(vec_id AS VARCHAR), NULL FROM embeddings WHERE vec_id NOT IN (SELECT id FROM dli)
UNION ALL SELECT 'reviews', CAST(id AS VARCHAR), NULL FROM reviews_v
  WHERE listing_id NOT IN (SELECT id FROM dli) AND CAST(user_id AS VARCHAR) NOT IN (SELECT id FROM du)
UNION ALL SELECT 'chats', CAST(id AS VARCHAR), NULL FROM chats_v WHERE user_id NOT IN (SELECT id FROM du)
""")
def cascade_delete(spark, d):
    """Delete some users and follow the declared foreign keys down to reviews, chats and
    embeddings; the remaining rows of all tables are the result."""
    users = V.users(spark, d).filter(F.col("id").cast("long") % 7 == 3).select(F.col("id").alias("key"))
    left = I.delete(key_tables(spark, d), SC.PRIMARY_KEYS, SC.FOREIGN_KEYS, {"users": users})
    parts = [df.select(F.lit(t).alias("table_name"), F.col(SC.PRIMARY_KEYS[t]).cast("string").alias("row_key"),
                       (F.col("complex_id") if t == "listings" else F.lit(None)).cast("string").alias("complex_id"))
             for t, df in left.items()]
    return reduce(DataFrame.unionByName, parts)


@register("set_null_delete", views=("complexes_v", "listings_v"), sql="""
WITH dc AS (SELECT id FROM complexes_v WHERE location IN (SELECT n_name FROM nation WHERE n_regionkey = 0))
SELECT id, CASE WHEN complex_id IN (SELECT id FROM dc) THEN NULL ELSE complex_id END AS complex_id
FROM listings_v
""")
def set_null_delete(spark, d):
    """Delete the complexes of one region; listings keep existing with complex_id set
    to null (ON DELETE SET NULL)."""
    nat = F.broadcast(read_table(spark, d, "nation").filter(F.col("n_regionkey") == 0)
                      .select(F.col("n_name").alias("location")))
    dc = V.complexes(spark, d).join(nat, "location", "left_semi").select("id")
    return I.set_null(V.listing_keys(spark, d).select("id", "complex_id"), "complex_id", dc)


_POL_VALUES = ", ".join(f"('{t}', '{c}', {str(u).lower()})" for t, c, u in I.POLICIES)
_CMD_VALUES = ", ".join(f"('{c}')" for c in I.COMMANDS)


@register("row_policies", views=("users_v", "landlords_v", "complexes_v", "listings_v", "reviews_v", "chats_v"),
          sql=f"""
WITH pol(t, c, u) AS (VALUES {_POL_VALUES}),
cmds(c) AS (VALUES {_CMD_VALUES}),
tabs(t, n) AS (SELECT 'users', count(*) FROM users_v UNION ALL SELECT 'landlords', count(*) FROM landlords_v
  UNION ALL SELECT 'complexes', count(*) FROM complexes_v UNION ALL SELECT 'listings', count(*) FROM listings_v
  UNION ALL SELECT 'listings_embeddings', count(*) FROM embeddings
  UNION ALL SELECT 'reviews', count(*) FROM reviews_v UNION ALL SELECT 'chats', count(*) FROM chats_v),
m AS (SELECT tabs.t, cmds.c, coalesce(bool_or(pol.u), false) AS allowed
      FROM tabs CROSS JOIN cmds LEFT JOIN pol ON pol.t = tabs.t AND pol.c IN (cmds.c, 'ALL')
      GROUP BY tabs.t, cmds.c)
SELECT m.t AS table_name, m.c AS command, m.allowed,
       CASE WHEN m.allowed THEN tabs.n ELSE 0 END AS visible_rows
FROM m JOIN tabs USING (t)
""")
def row_policies(spark, d):
    return I.policy_matrix(spark, key_tables(spark, d))

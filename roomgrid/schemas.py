"""Declared schemas: the listing model (from the DDL) and the driver tables.

Keys are opaque: the model declares them as strings, the views over the driver
tables keep them as bigint.  No reader in roomgrid infers a schema.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B, TS, DT = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(),
                         T.BooleanType(), T.TimestampType(), T.DateType())


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# ---- listing model -----------------------------------------------------------------
USERS = _struct(("id", S), ("phone_number", S), ("full_name", S), ("created_at", TS))
LANDLORDS = _struct(("id", S), ("user_id", S), ("name", S), ("contact_number", S),
                    ("email", S), ("is_verified", B))
COMPLEXES = _struct(("id", S), ("name", S), ("location", S), ("landlord_id", S))
LISTING_ATTRS = [
    ("title", S), ("description", S), ("property_type", S), ("location", S), ("price", D),
    ("is_bargainable", B), ("size_sqm", D), ("floor_number", I), ("year_built", I),
    ("furnishing", S), ("amenities", T.ArrayType(S)), ("utilities", S), ("internet_speed", S),
    ("minimum_lease_duration", S), ("availability_date", DT), ("photos", T.ArrayType(S)),
    ("video_tour_url", S), ("floor_plan_url", S), ("neighborhood_rating", D), ("renovations", S),
]
LISTINGS = _struct(("id", S), *LISTING_ATTRS, ("landlord_id", S), ("complex_id", S),
                   ("created_at", TS))
EMBEDDINGS = _struct(("listing_id", S), ("embedding", T.ArrayType(T.FloatType())),
                     ("updated_at", TS))
REVIEWS = _struct(("id", S), ("listing_id", S), ("user_id", S), ("rating", I), ("comment", S),
                  ("created_at", TS))
CHATS = _struct(("id", S), ("user_id", S), ("user_message", S), ("bot_response", S),
                ("created_at", TS))
FAVORITES = _struct(("user_id", S), ("listing_id", S), ("created_at", TS))
INQUIRIES = _struct(("user_id", S), ("listing_id", S), ("message", S), ("created_at", TS))
UNITS = _struct(("id", S), ("complex_id", S), ("title", S))
AGENT_TRACES = _struct(("id", S), ("payload", S), ("created_at", TS))

TABLES = {"users": USERS, "landlords": LANDLORDS, "complexes": COMPLEXES, "listings": LISTINGS,
          "listings_embeddings": EMBEDDINGS, "reviews": REVIEWS, "chats": CHATS, "favorites": FAVORITES,
          "inquiries": INQUIRIES, "units": UNITS, "agent_traces": AGENT_TRACES}

# nested load record: {landlord, complex | null, listing}
LANDLORD_IN = _struct(("name", S), ("contact_number", S), ("email", S), ("is_verified", B))
COMPLEX_IN = _struct(("name", S), ("location", S))
LISTING_IN = _struct(*LISTING_ATTRS)
LOAD_RECORD = _struct(("landlord", LANDLORD_IN), ("complex", COMPLEX_IN), ("listing", LISTING_IN))

# labelled text (text, intent) with a column for malformed lines
LABELLED_TEXT = _struct(("text", S), ("intent", S), ("_corrupt_record", S))

# inbound messages (form fields / JSON body)
MESSAGE_IN = _struct(("message_id", L), ("from_raw", S), ("text", S), ("ts", TS))

# Declared integrity rules (DDL): table -> primary key, unique keys, not-null columns,
# foreign keys (column, parent table, on-delete action).
PRIMARY_KEYS = {
    "users": "id", "landlords": "id", "complexes": "id", "listings": "id",
    "listings_embeddings": "listing_id", "reviews": "id", "chats": "id",
}
UNIQUE_KEYS = {"users": ["phone_number"], "landlords": ["user_id"]}
NOT_NULL = {"landlords": ["name", "contact_number"], "complexes": ["name"],
            "listings": ["title"], "chats": ["user_message"]}
FOREIGN_KEYS = [
    # child, column, parent, action
    ("landlords", "user_id", "users", "cascade"),
    ("complexes", "landlord_id", "landlords", "cascade"),
    ("listings", "landlord_id", "landlords", "cascade"),
    ("listings", "complex_id", "complexes", "set_null"),
    ("listings_embeddings", "listing_id", "listings", "cascade"),
    ("reviews", "listing_id", "listings", "cascade"),
    ("reviews", "user_id", "users", "cascade"),
    ("chats", "user_id", "users", "cascade"),
]
VECTOR_DIM_DECLARED = 1536   # default of the vector audit and quarantine

# ---- driver tables -----------------------------------------------------------------
DRIVER = {
    "region": _struct(("r_regionkey", I), ("r_name", S)),
    "nation": _struct(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _struct(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                        ("c_mktsegment", S)),
    "supplier": _struct(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _struct(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
                    ("p_size", I), ("p_retailprice", D)),
    "orders": _struct(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                      ("o_totalprice", D), ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _struct(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L),
                        ("l_linenumber", I), ("l_quantity", D), ("l_extendedprice", D),
                        ("l_discount", D), ("l_tax", D), ("l_returnflag", S),
                        ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _struct(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S),
                      ("value", D), ("props", S)),
    "documents": _struct(("doc_id", L), ("text", S), ("lang", S), ("source", S),
                         ("n_chars", L)),
    "embeddings": _struct(("vec_id", L), ("embedding", T.ArrayType(T.FloatType())),
                          ("label", I)),
    "pages": _struct(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _struct(("item_id", L), ("text", S)),
    "labels": _struct(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": _struct(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}

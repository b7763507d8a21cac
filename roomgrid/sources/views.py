"""The listing model expressed over the driver tables (FIXTURES.md section 4).

Each function returns a DataFrame in the model's shape whose size grows with the
driver tables.  Keys stay bigint (the engine treats them as opaque).  The same
definitions are stated in SQL in ``roomgrid.plans.oracle_views`` so that DuckDB can
check every registered query.

Dimension joins (nation: 25 rows by definition of the schema) are broadcast; every
other join is left to Catalyst/AQE, which broadcasts at runtime only when the
measured side is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgrid.sources.tables import read_table, row_count

# Fixed values of the view definitions.
PHONE_PREFIX = "+2547"          # landlord contact numbers
USER_KEY_PREFIX = "whatsapp:2547"  # normalised message sender keys
AMENITY_WORDS = ["wifi", "water", "parking"]
BASE_EPOCH = 1704067200          # 2024-01-01 00:00:00 UTC


def pad8(c: Column) -> Column:
    """At least eight digits; longer keys stay whole."""
    return F.format_string("%08d", c.cast("long"))


def _nation(spark, sf_dir):
    return F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


def landlords(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("id"),
        # every tenth landlord shares the user of the one before (a UNIQUE violation)
        (F.col("s_suppkey") - F.when(F.col("s_suppkey") % 10 == 9, 1).otherwise(0)).alias("user_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit(PHONE_PREFIX), pad8(F.col("s_suppkey"))).alias("contact_number"),
        F.concat(F.lit("landlord"), F.col("s_suppkey").cast("string"),
                 F.lit("@mail.test")).alias("email"),
        (F.col("s_acctbal") > 0).alias("is_verified"),
        F.col("s_nationkey"),
    )


def complexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    return (s.filter(F.col("s_suppkey") % 2 == 0)
            .join(_nation(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("s_suppkey").alias("id"),
                    # some complexes have the name of another one
                    F.concat(F.lit("Complex "), (F.col("s_suppkey") - F.when(F.col("s_suppkey") % 20 == 18, 2)
                                                 .otherwise(0)).cast("string")).alias("name"),
                    F.col("n_name").alias("location"),
                    F.col("s_suppkey").alias("landlord_id")))


def listings(spark: SparkSession, sf_dir: str, read=read_table) -> DataFrame:
    """part (read by ``read``) -> listings.  landlord = p_partkey mod (|supplier| + 1), so the listings of the
    last number have a landlord (and, when it is even, a complex) that does not exist; some
    have none, and some have no title."""
    n_sup = row_count(spark, sf_dir, "supplier")
    p = read(spark, sf_dir, "part")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lid = F.when(F.col("p_partkey") % 97 != 5, F.col("p_partkey") % F.lit(n_sup + 1))
    base = p.select("*", lid.alias("landlord_id"))
    return (base.join(s, base.landlord_id == s.s_suppkey, "left")
            .join(_nation(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("p_partkey").alias("id"),
                F.when(F.col("p_partkey") % 89 != 3, F.col("p_name")).alias("title"),
                F.col("p_brand").alias("description"),
                F.col("p_type").alias("property_type"),
                F.col("n_name").alias("location"),
                F.col("p_retailprice").alias("price"),
                F.lit(False).alias("is_bargainable"),
                F.col("p_size").cast("double").alias("size_sqm"),
                F.when(F.col("p_partkey") % 3 == 0, F.lit("Furnished"))
                 .when(F.col("p_partkey") % 3 == 1, F.lit("Unfurnished")).alias("furnishing"),
                F.slice(F.array(*[F.lit(w) for w in AMENITY_WORDS]), 1,
                        (F.col("p_partkey") % 4).cast("int")).alias("amenities"),
                F.lit(None).cast("string").alias("utilities"),
                F.lit(None).cast("string").alias("renovations"),
                ((F.col("p_partkey") % 51).cast("double") / F.lit(10.0)).alias("neighborhood_rating"),
                F.col("landlord_id"),
                F.when(F.col("landlord_id") % 2 == 0, F.col("landlord_id")).alias("complex_id"),
                F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("p_partkey")).alias("created_at"),
            ))


def listing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key columns of ``listings`` from their base table alone, for audits."""
    n_sup = row_count(spark, sf_dir, "supplier")
    k = F.col("p_partkey")
    lid = F.when(k % 97 != 5, k % F.lit(n_sup + 1))
    return read_table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 89 != 3, F.col("p_name")).alias("title"), lid.alias("landlord_id"),
        F.when(lid % 2 == 0, lid).alias("complex_id"))


def chat_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key columns of ``chats``, and the user's text, without the join to the replies."""
    mid = F.col("conv_id") * 1000 + F.col("turn")
    return read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user").select(
        mid.alias("id"), F.col("conv_id").cast("string").alias("user_id"), F.col("text").alias("user_message"))


def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings as an ingest batch: all of them, plus rows without an id and rows whose every
    text field is empty."""
    lst = listings(spark, sf_dir)
    no_id = lst.filter(F.col("id") % 101 == 7).withColumn("id", F.lit(None).cast("long"))
    empty = lst.filter(F.col("id") % 103 == 11).select(*[
        (-F.col("id")).alias(c) if c == "id" else F.col(c) if c == "landlord_id" else F.lit(None).cast(t).alias(c)
        for c, t in lst.dtypes])
    return lst.unionByName(no_id).unionByName(empty)


def listing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("listing_id"), "embedding", "label")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("id"),
                    F.concat(F.lit(USER_KEY_PREFIX), pad8(F.col("c_custkey"))).alias("phone_number"),
                    F.col("c_name").alias("full_name"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_part = row_count(spark, sf_dir, "part")
    ev = read_table(spark, sf_dir, "events")
    return (ev.filter(F.col("event_type") == "purchase")
            .select(F.col("event_id").alias("id"),
                    (F.col("event_id") % F.lit(n_part)).alias("listing_id"),
                    F.col("user_id"),
                    (F.lit(1) + F.col("event_id") % 6).cast("int").alias("rating"),
                    F.col("ts").alias("created_at")))


def message_ts(message_id: Column) -> Column:
    return F.timestamp_seconds(F.lit(BASE_EPOCH) + message_id)


# The command that a user turn carries, by its number (fixed values of the view).
COMMAND_KINDS = 7
INTENT_OF_KIND = {0: "save_listing", 1: "create_inquiry", 2: "create_inquiry", 4: "greeting", 5: "search_listings"}
SLANG_EVERY = 11      # of the plain turns, one in so many begins with a slang word


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as inbound messages.  Every turn is kept with its text; the sender format
    and a leading command are derived from the ids, and blank messages are rows of their own."""
    return messages_from(read_table(spark, sf_dir, "conversations"), row_count(spark, sf_dir, "part"))


def messages_from(conversations: DataFrame, n_part: int) -> DataFrame:
    cv = conversations.filter(F.col("role") == "user")
    mid = F.col("conv_id") * 1000 + F.col("turn")
    lid = pad8(mid % F.lit(n_part))
    k = F.col("conv_id") % 5
    from_raw = (F.when(k == 0, F.concat(F.lit("whatsapp:+2547"), pad8(F.col("conv_id"))))
                .when(k == 1, F.concat(F.lit("+2547"), pad8(F.col("conv_id"))))
                .when(k == 2, F.concat(F.lit("  whatsapp:2547"), pad8(F.col("conv_id")), F.lit("\t")))
                .when(k == 3, F.concat(F.lit("2547"), pad8(F.col("conv_id"))))
                .otherwise(F.lit("")))
    m = mid % COMMAND_KINDS
    text = (F.when(m == 0, F.concat(F.lit("save "), lid, F.lit(" "), F.col("text")))
            .when(m == 1, F.concat(F.lit("inquire "), lid, F.lit(" "), F.col("text")))
            .when(m == 2, F.concat(F.lit("book viewing "), F.col("text")))
            .when(m == 4, F.concat(F.lit("hello there "), F.col("text")))
            .when(m == 5, F.concat(F.lit("looking for a room to rent "), F.col("text")))
            .when(mid % SLANG_EVERY == 0, F.concat(F.lit("niko "), F.col("text")))
            .otherwise(F.col("text")))
    intent = F.lit("fallback")
    for kind, name in INTENT_OF_KIND.items():
        intent = F.when(m == kind, F.lit(name)).otherwise(intent)
    base = cv.select(mid.alias("message_id"), F.col("conv_id"), from_raw.alias("from_raw"),
                     text.alias("text"), message_ts(mid).alias("ts"), intent.alias("told_intent"))
    blanks = base.filter(F.col("message_id") % COMMAND_KINDS == 3).select(
        (F.col("message_id") + 500).alias("message_id"), "conv_id", "from_raw", F.lit("\u00a0\n").alias("text"),
        message_ts(F.col("message_id") + 500).alias("ts"), F.lit("fallback").alias("told_intent"))
    return base.unionByName(blanks)


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn + assistant turn at turn+1 of the same conversation."""
    return chats_from(read_table(spark, sf_dir, "conversations"))


def chats_from(cv: DataFrame) -> DataFrame:
    u = cv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_message"))
    a = cv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("bot_response"))
    j = u.join(a, ["conv_id", "turn"], "left")
    mid = F.col("conv_id") * 1000 + F.col("turn")
    return j.select(mid.alias("id"), F.col("conv_id").cast("string").alias("user_id"),
                    "user_message", "bot_response", message_ts(mid).alias("created_at"))


def chats_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat log as the message path writes it: every chat whose id is divisible by
    three was stored a second time one second later (the double save)."""
    c = chats(spark, sf_dir)
    dup = (c.filter(F.col("id") % 3 == 0)
           .select((F.col("id") + 500).alias("id"), "user_id", "user_message", "bot_response",
                   (F.col("created_at") + F.expr("INTERVAL 1 SECOND")).alias("created_at")))
    return c.unionByName(dup)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")

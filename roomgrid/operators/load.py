"""Load path: nested records, admission, insert-if-absent, keyed upsert, conform, rejects.

All keyed operations use aggregates with map-side partial aggregation (``min_by`` /
``max_by`` per key) rather than a per-key window, so a natural key that holds a large
share of the input is combined inside each task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomgrid import schemas as SC
from roomgrid.sources.files import read_labelled_text, read_nested_records  # noqa: F401


def hashed_id(prefix: str, key: Column) -> Column:
    """Deterministic id for a new row: prefix + sha256(key)."""
    return F.concat(F.lit(prefix), F.sha2(key.cast("string"), 256))


def split_nested(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """records -> (landlord.*, complex.*, listing.*) keyed by the record's position."""
    r = records.withColumn("rec_no", F.monotonically_increasing_id()) \
        if "rec_no" not in records.columns else records
    return (r.select("rec_no", "landlord.*"),
            r.filter(F.col("complex").isNotNull()).select("rec_no", "complex.*"),
            r.select("rec_no", "listing.*"))


def admission(records: DataFrame) -> DataFrame:
    """Admission check: a record needs a landlord and a listing."""
    reason = (F.when(F.col("landlord").isNull(), F.lit("missing landlord"))
              .when(F.col("listing").isNull(), F.lit("missing listing")))
    return records.withColumn("reject_reason", reason) \
        .withColumn("admitted", F.col("reject_reason").isNull())


# ---- insert-if-absent ----------------------------------------------------------------
def get_or_create(existing: DataFrame, incoming: DataFrame, key: str, order_col: str,
                  id_prefix: str, attrs: list[str]) -> DataFrame:
    """For each natural key: keep the existing row untouched if present; otherwise the
    first incoming row by ``order_col`` is inserted with a deterministic new id.
    Returns the full table (existing + new) with an ``is_new`` flag."""
    first = (incoming.filter(F.col(key).isNotNull())
             .groupBy(key).agg(F.min_by(F.struct(*attrs), F.col(order_col)).alias("r")))
    new = (first.join(existing.select(key), key, "left_anti")
           .select(hashed_id(id_prefix, F.col(key)).alias("id"), F.col(key),
                   *[F.col(f"r.{a}").alias(a) for a in attrs if a != key]))
    cols = ["id", key] + [a for a in attrs if a != key]
    old = existing.select(F.col("id").cast("string").alias("id"), key,
                          *[a for a in attrs if a != key])
    return old.withColumn("is_new", F.lit(False)).unionByName(
        new.select(*cols).withColumn("is_new", F.lit(True)))


def first_per_key(table: DataFrame, key: str, order: list[str], value: str = "id") -> DataFrame:
    """(key, value) of the first row of each key: what a lookup by a key that is not unique
    finds, so that a join with it keeps every looked-up row once."""
    return (table.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.min_by(value, F.struct(*order)).alias(value)))


# ---- keyed upsert ---------------------------------------------------------------------
def upsert_users(users: DataFrame, incoming_keys: DataFrame) -> DataFrame:
    """Merge on phone_number: existing ids/attributes kept, new keys get hashed ids."""
    inc = incoming_keys.select("phone_number").distinct()
    j = users.join(inc.withColumn("_in", F.lit(True)), "phone_number", "full_outer")
    return j.select(F.coalesce(F.col("id"), hashed_id("u-", F.col("phone_number"))).alias("id"),
                    "phone_number", "full_name", F.col("id").isNull().alias("is_new"))


def upsert_latest(existing: DataFrame, incoming: DataFrame, key: str, order_col: str) -> DataFrame:
    """Last writer wins per key within the batch (``max_by`` on the arrival order), then
    the batch replaces existing rows with the same key.  Column sets must match."""
    cols = [c for c in existing.columns if c != key]
    latest = incoming.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order_col)).alias("r")) \
        .select(key, *[F.col(f"r.{c}").alias(c) for c in cols])
    kept = existing.join(latest.select(key), key, "left_anti")
    return kept.withColumn("from_batch", F.lit(False)).unionByName(
        latest.withColumn("from_batch", F.lit(True)))


# ---- conform -------------------------------------------------------------------------
def conform(df: DataFrame, schema: T.StructType, defaults: dict[str, Column] | None = None,
            not_null: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cast every declared column with try_cast (missing -> null), apply defaults, and split
    off the rows whose non-null input failed to cast or that lack a ``not_null`` column, with
    the reasons.  Both frames are outputs."""
    defaults = defaults or {}
    present = set(df.columns)
    outs, fails = [], []
    for f in schema.fields:
        if f.name in present:
            src = F.col(f.name)
            casted = F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") \
                if f.dataType.simpleString() != "string" else src.cast("string")
            fails.append(F.when(src.isNotNull() & casted.isNull(), F.lit(f"type:{f.name}")))
        else:
            casted = F.lit(None).cast(f.dataType)
        if f.name in defaults:
            casted = F.coalesce(casted, defaults[f.name])
        if f.name in (not_null or []):
            fails.append(F.when(casted.isNull(), F.lit(f"null:{f.name}")))
        outs.append(casted.alias(f.name))
    failed = F.concat_ws(",", *fails) if fails else F.lit("")
    t = df.select(*outs, failed.alias("_failed"))
    good = t.filter(F.col("_failed") == "").drop("_failed")
    bad = t.filter(F.col("_failed") != "").withColumnRenamed("_failed", "reject_reason")
    return good, bad

"""Integrity rules of the DDL as data jobs: NOT NULL / CHECK / UNIQUE / FK audits,
vector dimension, cascading delete and SET NULL, row policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VIOLATION_COLS = ["table_name", "rule", "row_key"]


def _v(df: DataFrame, table: str, rule: str, key: Column) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                     key.cast("string").alias("row_key"))


def not_null(df: DataFrame, table: str, cols: list[str], key: str = "id") -> DataFrame:
    parts = [_v(df.filter(F.col(c).isNull()), table, f"not_null:{c}", F.col(key)) for c in cols]
    return reduce(DataFrame.unionByName, parts)


def check_range(df: DataFrame, table: str, col: str, lo, hi, key: str = "id") -> DataFrame:
    """CHECK (lo <= col <= hi); a null value passes, as in SQL."""
    bad = df.filter(F.col(col).isNotNull() & ((F.col(col) < lo) | (F.col(col) > hi)))
    return _v(bad, table, f"check:{col}", F.col(key))


def duplicates(df: DataFrame, table: str, cols: list[str]) -> DataFrame:
    """UNIQUE / PRIMARY KEY: key values held by more than one row (aggregated with
    map-side partial counts; a null key never conflicts)."""
    k = df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    g = k.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return g.select(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("key_cols"),
                    F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("key_value"),
                    F.col("n"))


def references(tables: dict[str, DataFrame], keys: dict[str, str], foreign_keys) -> DataFrame:
    """Every non-null foreign key value as a row (child_table, fk_column, child_key, parent,
    value): one scan of each child table, however many foreign keys it has."""
    parts = []
    for child in dict.fromkeys(f[0] for f in foreign_keys):
        own = [F.struct(F.lit(c).alias("fk_column"), F.lit(p).alias("parent"), F.col(c).cast("string").alias("value"))
               for t, c, p, _ in foreign_keys if t == child]
        parts.append(tables[child].select(F.lit(child).alias("child_table"), F.col(keys[child]).cast("string").alias("child_key"),
                                          F.explode(F.array(*own)).alias("f"))
                     .select("child_table", "f.fk_column", "child_key", "f.parent", "f.value"))
    return reduce(DataFrame.unionByName, parts).filter(F.col("value").isNotNull())


def orphans(tables: dict[str, DataFrame], keys: dict[str, str], foreign_keys) -> DataFrame:
    """Child rows whose non-null foreign key has no parent, for all declared foreign keys: one
    scan of each table and one anti join on (parent, key), which AQE splits for a hot key."""
    parents = reduce(DataFrame.unionByName, [
        tables[p].select(F.lit(p).alias("parent"), F.col(keys[p]).cast("string").alias("value"))
        for p in dict.fromkeys(f[2] for f in foreign_keys)])
    return references(tables, keys, foreign_keys).join(parents, ["parent", "value"], "left_anti") \
        .select("child_table", "fk_column", "child_key")


def delete(tables: dict[str, DataFrame], keys: dict[str, str], foreign_keys, roots: dict[str, DataFrame]
           ) -> dict[str, DataFrame]:
    """The tables after deleting the rows whose keys are in ``roots`` (table -> one column
    ``key``), with ON DELETE CASCADE and SET NULL along the declared foreign keys.  Tables are
    visited parents first; a child's cascade keys are marked by left joins and the row goes
    when any of them is deleted."""
    gone: dict[str, DataFrame] = {}
    left: dict[str, DataFrame] = {}
    order: list[str] = []

    def visit(t: str) -> None:
        if t not in order:
            for child, _, parent, _ in foreign_keys:
                if child == t:
                    visit(parent)
            order.append(t)

    for t in tables:
        visit(t)
    for t in order:
        df = tables[t].withColumn("_gone", F.lit(False))
        if t in roots:
            k = roots[t].select(F.col("key").cast("string").alias("_k"), F.lit(True).alias("_hit")).distinct()
            df = df.join(k, df[keys[t]].cast("string") == k["_k"], "left") \
                .withColumn("_gone", F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")
        for child, column, parent, action in foreign_keys:
            if child != t:
                continue
            k = gone[parent].select(F.col("key").alias("_k"), F.lit(True).alias("_hit"))
            df = df.join(k, df[column].cast("string") == k["_k"], "left")
            hit = F.coalesce("_hit", F.lit(False))
            df = (df.withColumn("_gone", F.col("_gone") | hit) if action == "cascade"
                  else df.withColumn(column, F.when(~hit, F.col(column)))).drop("_k", "_hit")
        gone[t] = df.filter("_gone").select(F.col(keys[t]).cast("string").alias("key")).distinct()
        left[t] = df.filter("NOT _gone").drop("_gone")
    return left


def vector_dims(emb: DataFrame, expected: int, col: str = "embedding") -> DataFrame:
    return (emb.groupBy(F.size(col).cast("bigint").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("ok", F.col("dim") == F.lit(expected)))


def set_null(child: DataFrame, fk: str, deleted: DataFrame) -> DataFrame:
    """ON DELETE SET NULL: the FK of children of deleted parents becomes null."""
    k = deleted.select(F.col("id").cast("string").alias("_k"), F.lit(True).alias("_hit")).distinct()
    c = child.withColumn("_fk", F.col(fk).cast("string"))
    j = c.join(k, c["_fk"] == k["_k"], "left")
    return j.withColumn(fk, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(fk))) \
        .drop("_fk", "_k", "_hit")


# ---- row policies -------------------------------------------------------------------
# The DDL's policies as (table, command, using).  "ALL" covers every
# command; with row security on, a command no policy covers is denied.
POLICIES = [
    ("users", "SELECT", True),
    ("landlords", "SELECT", True),
    ("complexes", "ALL", True),
    ("listings", "SELECT", True),
    ("listings", "ALL", True),
    ("reviews", "SELECT", True),
    ("reviews", "ALL", True),
    ("chats", "ALL", True),
    ("listings_embeddings", "ALL", False),
]
COMMANDS = ["SELECT", "INSERT", "UPDATE", "DELETE"]


def policy_allows(table: str, command: str) -> bool:
    """Permissive policies combine with OR; no applicable policy -> deny."""
    hits = [using for t, c, using in POLICIES if t == table and c in (command, "ALL")]
    return any(hits)


def secure(df: DataFrame, table: str, command: str = "SELECT") -> DataFrame:
    """The rows a caller may see/touch: the policy predicate applied as a filter
    (constant here, folded by Catalyst into an empty or unchanged scan)."""
    return df.filter(F.lit(policy_allows(table, command)))


def policy_matrix(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows a caller may see, by table and command: each table is counted once and meets the
    policy table (one row for each table and command)."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("table_name"), "n") for name, df in tables.items()])
    rules = spark.createDataFrame([(t, c, policy_allows(t, c)) for t in tables for c in COMMANDS],
                                  "table_name string, command string, allowed boolean")
    return rules.join(counts, "table_name").select(
        "table_name", "command", "allowed", F.when(F.col("allowed"), F.col("n")).otherwise(F.lit(0)).alias("visible_rows"))

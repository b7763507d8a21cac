"""File sources and sinks: nested JSON records, labelled CSV, JSON message bodies,
JSON-lines sink.  Explicit schemas everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgrid import schemas as SC

MESSAGE_BODY = "message string"


def read_nested_records(spark: SparkSession, path: str, multiline: bool = True,
                        schema=None) -> DataFrame:
    """{landlord, complex | null, listing} records: a JSON array file (``multiline``) or
    JSON lines (splittable, the form to use for large inputs)."""
    return spark.read.schema(schema or SC.LOAD_RECORD).option("multiLine", multiline).json(path)


def read_labelled_text(spark: SparkSession, path: str) -> DataFrame:
    """(text, intent) CSV with a header; lines that do not have exactly two fields are
    dropped (PERMISSIVE mode routes them to the corrupt-record column)."""
    # the malformed lines are told apart by a field count on the raw line's parse, without
    # keeping a cache: FAILFAST of from_csv is not used, a malformed line is null
    raw = spark.read.schema(SC.LABELLED_TEXT).option("header", True).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("encoding", "UTF-8").csv(path)
    return raw.select("text", "intent", F.col("_corrupt_record").isNull().alias("_ok")) \
        .filter(F.col("_ok") & F.col("intent").isNotNull()).select("text", "intent")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Inbound form messages (message_id, from_raw, text, ts) as JSON lines."""
    return spark.read.schema(SC.MESSAGE_IN).json(path)


def parse_message_bodies(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """JSON request bodies -> (messages, quarantine).  A body without a ``message`` field
    (or not JSON at all) is quarantined instead of failing the batch."""
    p = raw.withColumn("_m", F.from_json(F.col(body), MESSAGE_BODY))
    good = p.filter(F.col("_m.message").isNotNull()).withColumn("text", F.col("_m.message")).drop("_m")
    bad = p.filter(F.col("_m.message").isNull()).drop("_m") \
        .withColumn("reject_reason", F.lit("missing message"))
    return good, bad


def write_jsonl(df: DataFrame, path: str, compression: str | None = None, rows: int | None = None) -> None:
    """Append one JSON object per line (non-ASCII kept as is).  A compressed file is read by one
    task, so ``rows`` limits the lines of a file; the rest goes to further files."""
    out = df.write.mode("append")
    if compression:
        out = out.option("compression", compression)
    if rows:
        out = out.option("maxRecordsPerFile", rows)
    out.json(path)


def append_rows(df: DataFrame, table: str, path: str) -> DataFrame:
    """Append rows to a model table (``chats``, ``favorites``, ...) in its declared columns and
    types; columns that the rows lack are null.  Returns the rows that do not conform."""
    from roomgrid.operators.load import conform
    good, bad = conform(df, SC.TABLES[table], not_null=SC.NOT_NULL.get(table))
    append_table(good, path)
    return bad


def append_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows to a table folder, creating it when it does not exist yet (the
    reference tolerates a missing trace table; here the first append creates it).
    Write failures are raised, not swallowed."""
    df.write.mode("append").format(fmt).save(path)

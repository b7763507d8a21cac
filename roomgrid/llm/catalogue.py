"""Registered queries of the ``llm`` operators, and their SQL oracles where SQL can state
the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomgrid.llm import chat, mixing, pivots, prefix_trie, repair
from roomgrid.session import scratch_path
from roomgrid.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ARROW_ROWS = 1000  # rows of an Arrow batch: texts are long


# Arrow batches for long texts, and Spark's runtime Bloom filter for joins of the
# texts with a written list of ids, whatever the size of either side.  Its size stays Spark's
# (1 MB, good for about a million ids): with many more, raise numBits and the driver's memory.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ARROW_ROWS,
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "16MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
}


def settings(spark: SparkSession) -> None:
    """Set the session's ``SETTINGS``.  They stay set: the frames that are returned run later,
    and none of them changes a result."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            settings(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def crc_mod(col, n: int):
    """crc32 of the value as text, modulo n; -1 for null."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % n, F.lit(-1))


# CRC-32 in SQL, as DuckDB has none: ``crc`` is its byte table, made by rule; a query that uses
# ``crc_sql`` has it in its FROM.
CRC_TABLE = """crc AS (SELECT list(v ORDER BY n) AS tab FROM (SELECT n,
  list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS n)))"""


def crc_sql(ascii_text: str) -> str:
    """DuckDB: CRC-32 of a non-empty ASCII text, by the table ``tab`` of ``crc``."""
    return ("xor(list_reduce(list_prepend(4294967295, list_transform(string_split(" + ascii_text + ", ''), "
            "lambda s: CAST(ord(s) AS BIGINT))), lambda c, b: "
            "xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomgrid.llm import quality
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    model = quality.fit(docs, labels, label_col="quality")
    return (docs.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"),
                        quality.score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.7).cast("int")))


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomgrid.llm import neardup
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The vocabulary file that the packing queries use (a parameter of the operator)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomgrid.llm import packing
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_mixing", mixing.oracle_sql())
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), scattered=True)


@query("op9_chat", chat.oracle_sql())
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(told)
    turns = chat.canonical_turns(chat.from_rows(rows), "record")
    return chat.digests(chat.format_turns(turns).withColumnRenamed("conv", "conv_id"), "conv_id")


@query("op10_compression")
def op10_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomgrid.llm import compression
    text = F.col("text")
    path = scratch_path(spark, "compression")
    # measured once, in one pass; some hundred bytes a document are written
    read_table(spark, sf_dir, "documents").select("doc_id", F.xxhash64(text).alias("digest"), compression.measure(text).alias("m")) \
        .select("doc_id", "digest", "m.*").write.parquet(path)
    m = spark.read.parquet(path)
    m = compression.judge(m, compression.limits(m))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & F.col("passes")).alias("kept"), "ratio", "chunk_share")


@query("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomgrid.llm import secrets
    return secrets.scan(read_table(spark, sf_dir, "documents"))


@query("op2_top_k", pivots.ORACLE)
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_licenses")
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomgrid.llm import licenses
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query("op6_lm_score")
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomgrid.llm import lm
    scored = lm.score(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from roomgrid.llm import simhash
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", prefix_trie.oracle_sql(CRC_TABLE, "c - c % 20", crc_sql("CAST(c AS VARCHAR)") + " % 4"))
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(read_table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    rebuilt = prefix_trie.with_heads(lists, conv - conv % 20, F.crc32(conv.cast("string")) % 4, 3)
    return prefix_trie.trie(rebuilt)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults by a hash of id and turn: rows dropped, emptied, without
    full stops, repeated, or said by the user; nulls are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = blank("text")
    return (rows.select("conv_id", "turn", blank("role").alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
            .drop("copy"))


_DAMAGED_SQL = f"""{CRC_TABLE},
ids AS (SELECT DISTINCT conv_id AS c FROM conversations),
kinds AS (SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations, crc),
damaged AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0))"""


@query("op11_repair", repair.oracle_sql(_DAMAGED_SQL))
def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    done = repair.repair(damaged(rows))
    zero = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (ids.join(done, F.col("id").eqNullSafe(F.col("conv_id")), "left")
            .na.fill(zero | {"audit": "", "repaired_sha256": repair.EMPTY_SHA})
            .select(F.col("id").alias("conv_id"), *done.columns[1:]))

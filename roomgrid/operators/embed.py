"""Text embedding and the batch embedding ingest, as Spark jobs.

The reference calls a hosted embedding model per row.  Here the embedder is pluggable:
``hashed_tf`` is a native feature-hashing embedder (word tokens -> sha256 bucket ->
L2-normalised term frequencies), counted inside the rows; ``hashed_tfidf`` weighs
the buckets by document frequencies that grow batch by batch; a real model can be plugged in as an Arrow ``pandas_udf`` over the composed text (``model_udf``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roomgrid.functions.text import compose_listing_text
from roomgrid.operators.textmodel import word_tokens

HASH_DIM = 64


def bucket_of(token: Column, dim: int = HASH_DIM) -> Column:
    """Bucket = first 32 bits of sha256(token) mod dim (portable across engines)."""
    h = F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(dim))


def bucket_counts(df: DataFrame, key: str, text: str, dim: int = HASH_DIM) -> DataFrame:
    """One row for each row of ``df``: (key, cnt), how many tokens each bucket has over all texts
    of its key; none for a null key.  A text's tokens are counted inside its row; only those of
    keys with several rows become rows, and are added up."""
    buckets = F.transform(F.coalesce(word_tokens(F.col(text)), F.array().cast("array<string>")), lambda t: bucket_of(t, dim))
    # bound to a variable first: inside the inner lambda the tokens would be hashed for every bucket
    own = F.map_from_entries(F.transform(F.array(buckets), lambda b: F.transform(F.array_distinct(b), lambda x: F.struct(
        x, F.size(F.filter(b, lambda y: y == x)).cast("bigint"))))[0])
    several = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key)
    added = (df.join(several, key, "left_semi").select(key, F.explode(own).alias("bucket", "cnt"))
             .groupBy(key, "bucket").agg(F.sum("cnt").alias("cnt"))
             .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("_added")))
    j = df.select(key, own.alias("_own")).join(added, key, "left")
    return j.select(key, F.when(F.col(key).isNotNull(), F.coalesce("_added", "_own"))
                    .otherwise(F.create_map().cast("map<bigint,bigint>")).alias("cnt"))


def _dense(counts: DataFrame, key: str, dim: int, kind: str) -> DataFrame:
    """(key, cnt, w), maps by bucket -> (key, embedding, n_tokens, nnz, cnt)."""
    c = counts.withColumn("_norm", F.sqrt(F.aggregate(F.map_values("w"), F.lit(0.0), lambda a, x: a + x * x)))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(
        F.try_divide(F.try_element_at("w", i.cast("bigint")), F.col("_norm")), F.lit(0.0)).cast(kind))
    return c.select(key, vec.alias("embedding"),
                    F.aggregate(F.map_values("cnt"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_tokens"),
                    F.size("cnt").cast("bigint").alias("nnz"), "cnt")


def heaviest(cnt: Column) -> Column:
    """The bucket with the most tokens, the smallest of equal ones; null without tokens."""
    return -F.array_max(F.transform(F.map_entries(cnt), lambda e: F.struct(e["value"].alias("n"), (-e["key"]).alias("i"))))["i"]


def hashed_tf(df: DataFrame, key: str, text: str, dim: int = HASH_DIM, kind: str = "float") -> DataFrame:
    """-> (key, embedding of ``kind`` components and length dim, n_tokens, nnz, cnt by bucket).  Rows without any
    token get a zero vector (their similarity is null, never a match)."""
    counts = bucket_counts(df, key, text, dim)
    return _dense(counts.withColumn("w", F.transform_values("cnt", lambda _, n: n.cast("double"))), key, dim, kind)


DOCS = -1      # the bucket that counts texts


def add_document_frequencies(df: DataFrame, key: str, text: str, path: str, batch: str, dim: int = HASH_DIM) -> None:
    """Count in how many texts of a batch each bucket occurs, and the texts, into the folder
    ``path``: one part for each batch, of at most ``dim`` + 1 rows.  Earlier texts are not read;
    a batch that runs again replaces its own part.  A text that arrives in two batches counts
    in both; texts without a token count as texts."""
    # one row for each text and bucket, or one without a bucket: both counts in one aggregation
    rows = df.select(key, F.explode(F.array_append(F.array_distinct(F.transform(
        F.coalesce(word_tokens(F.col(text)), F.array().cast("array<string>")),
        lambda t: bucket_of(t, dim))), F.lit(DOCS).cast("bigint"))).alias("bucket"))
    rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def inverse_frequencies(spark: SparkSession, path: str, dim: int = HASH_DIM) -> DataFrame:
    """(bucket, idf) of every bucket: ln((1 + texts) / (1 + texts with the bucket)) + 1 over all
    batches; a bucket that no text has weighs most."""
    n = spark.read.schema("bucket long, n long, batch string").parquet(path).groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = spark.range(DOCS, dim).withColumnRenamed("id", "bucket").join(n, "bucket", "left").fillna(0, ["n"])
    texts = F.max(F.when(F.col("bucket") == DOCS, F.col("n"))).over(Window.partitionBy())
    return rows.select("bucket", (F.log((1 + texts) / (1 + F.col("n"))) + 1).alias("idf")).filter(F.col("bucket") != DOCS)


def hashed_tfidf(df: DataFrame, key: str, text: str, idf: DataFrame, dim: int = HASH_DIM,
                 kind: str = "float") -> DataFrame:
    """``hashed_tf`` with each bucket's count times its ``inverse_frequencies``; texts and queries
    need the same ones.  ``idf`` has ``dim`` rows, so it is one broadcast row; tokens of a bucket
    that it lacks do not count."""
    one = idf.groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("bigint"), "idf"))).alias("_idf"))
    counts = bucket_counts(df, key, text, dim).crossJoin(F.broadcast(one))
    counts = counts.withColumn("cnt", F.map_filter("cnt", lambda b, _: F.try_element_at("_idf", b).isNotNull()))
    return _dense(counts.withColumn("w", F.transform_values("cnt", lambda b, n: n * F.try_element_at("_idf", b))), key, dim, kind)


def model_udf(fn, dim: int):
    """Wrap a batch embedding function (list[str] -> list[list[float]]) as a pandas UDF.  It
    returns (embedding, error): a call that fails is halved until the rows that fail are alone,
    so they carry the error's text and no vector, and all others their vector.  A vector of
    another length than ``dim`` is such a failure.  A batch with r failing rows of n takes at
    most about 2 r log2(n) more calls."""
    def vectors(texts: list[str]) -> list[list[float]]:
        out = [list(map(float, v)) for v in fn(texts)]
        if len(out) != len(texts) or any(len(v) != dim for v in out):
            raise ValueError(f"the embedding function must return a vector of length {dim} for each text")
        return out

    def isolated(texts: list[str]) -> list[tuple]:
        done, todo = [], [texts]
        while todo:
            part = todo.pop()
            try:
                done.extend((v, None) for v in vectors(part))
            except Exception as e:  # whatever the model raises belongs to its rows
                if len(part) == 1:
                    done.append((None, f"{type(e).__name__}: {e}"))
                else:
                    half = len(part) // 2
                    todo += [part[half:], part[:half]]
        return done

    @F.pandas_udf("embedding array<float>, error string")
    def embed(texts: pd.Series) -> pd.DataFrame:
        rows = isolated(texts.fillna("").tolist()) if len(texts) else []
        return pd.DataFrame(rows, columns=["embedding", "error"], index=texts.index)
    return embed


def embed_rows(df: DataFrame, text: str, fn, dim: int) -> DataFrame:
    """Rows + embedding + reject_reason (one of the two is null): the model is called once for a
    row, so a caller that keeps both kinds writes this frame and splits what it reads back."""
    model = model_udf(fn, dim).asNondeterministic()  # no second call where the plan uses it twice
    made = df.withColumn("_made", model(F.col(text)))
    return made.withColumn("embedding", F.col("_made.embedding")) \
        .withColumn("reject_reason", F.col("_made.error")).drop("_made")


def ingest_split(listings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compose the text of every listing.  Rows without an id, and rows with an empty text
    (which stands for a call of the embedding model that fails), are rejected with a reason
    instead of aborting the job; a listing without a landlord is embedded like any other."""
    t = listings.withColumn("text", compose_listing_text())
    reason = (F.when(F.col("id").isNull(), F.lit("missing id"))
              .when(F.col("text") == "", F.lit("empty text")))
    t = t.withColumn("reject_reason", reason)
    return t.filter(F.col("reject_reason").isNull()), t.filter(F.col("reject_reason").isNotNull())


def ingest(listings: DataFrame, store: DataFrame, now: Column, dim: int = HASH_DIM) -> DataFrame:
    """Batch ingest: compose -> (re-)embed -> keyed upsert against the store (listing_id,
    text_hash, embedding, updated_at).  Returns the whole store after the upsert, with
    ``action``: insert, update, unchanged (same text: vector and time are kept), or kept
    (not in the batch).  Only changed texts are embedded; one join meets the store."""
    good, _ = ingest_split(listings)
    g = good.select(F.col("id").alias("listing_id"), "text", F.sha2("text", 256).alias("_new"))
    s = store.select("listing_id", F.col("text_hash").alias("_old"), F.col("embedding").alias("_vec"),
                     F.col("updated_at").alias("_at"), F.lit(True).alias("_stored"))
    j = g.join(s, "listing_id", "full_outer")
    action = (F.when(F.col("_new").isNull(), "kept").when(F.col("_stored").isNull(), "insert")
              .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update"))
    j = j.withColumn("action", action)
    changed = F.col("action").isin("insert", "update")
    emb = hashed_tf(j.filter(changed), "listing_id", "text", dim).select("listing_id", F.col("embedding").alias("_made"))
    j = j.join(emb, "listing_id", "left")
    return j.select("listing_id", F.coalesce("_new", "_old").alias("text_hash"), "action",
                    F.when(changed, F.col("_made")).otherwise(F.col("_vec")).alias("embedding"),
                    F.when(changed, now).otherwise(F.col("_at")).alias("updated_at"))

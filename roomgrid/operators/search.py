"""Vector search: threshold + top-k over cosine similarity, joined to listings.

Semantics of the search function in the reference DDL, per query vector:
    inner join embeddings to listings, keep cosine similarity strictly greater than the
    threshold, order by similarity desc, limit k.  Exact (no vector index).

Set-at-a-time design:
* embeddings are first semi-joined to listings (keys only) so orphan vectors never take
  a top-k slot, then scored, then the few surviving rows are joined for attributes;
* vectors that are null, of another dimension, or hold null or non-finite components are
  quarantined (``vector_rejects``), never scored;
* queries and embeddings are dealt into blocks of ``BLOCK_BYTES`` by a hash of their ids and
  every pair of blocks is one group (the replication scheme of distributed block matrix
  products), so no task holds more than one block of each side and nothing goes through the
  driver; a group returns at most k rows for each query, ties included;
* ids may be of any orderable type;
* ranking is deterministic: similarity rounded to 6 places desc, then listing id asc.
  The threshold is applied to the unrounded value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomgrid.functions.vectors import block_top, cosine_expr, unit_rows, usable
from roomgrid.schemas import VECTOR_DIM_DECLARED

# The reference's caller defaults.
DEFAULT_THRESHOLD = 0.5
DEFAULT_K = 5
BLOCK_BYTES = 16 << 20


def block_count(rows: int, dim: int, block_bytes: int) -> int:
    return max(1, -(-rows * dim * 8 // block_bytes))


def rank_topk(scores: DataFrame, k: int, part: str = "query_id") -> DataFrame:
    """Final exact ranking: rounded similarity desc, id asc; rank <= k.
    Spark plans a WindowGroupLimit (partial top-k before the shuffle) for this."""
    w = Window.partitionBy(part).orderBy(F.col("similarity").desc(), F.col("id").asc())
    return (scores.withColumn("similarity", F.round("sim", 6)).drop("sim")
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def knn(emb: DataFrame, queries: DataFrame, threshold: float = DEFAULT_THRESHOLD,
        k: int = DEFAULT_K, dim: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact top-k per query.

    ``emb``: (id, embedding array<float>); ``queries``: (query_id, embedding array<float>);
    ids of any orderable type.  ``dim`` is the declared dimension (default: the longest query);
    other vectors take no part.  Returns (query_id, id, similarity, rank).
    """
    if dim is None:
        dim = queries.select(F.max(F.size("embedding"))).first()[0] or 1
    emb = emb.filter(F.col("id").isNotNull() & usable(F.col("embedding"), dim)).select("id", "embedding")
    # named anew, as queries may come from the same frame as the embeddings
    queries = queries.filter(usable(F.col("embedding"), dim)).select("query_id", F.col("embedding").alias("vector"))
    # a count, not the rows: the sides stay where they are
    n_q, n_e = queries.count(), emb.count()
    qb, eb = block_count(n_q, dim, block_bytes), block_count(n_e, dim, block_bytes)

    def dealt(df: DataFrame, key: str, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("id", emb.schema["id"].dataType), T.StructField("sim", T.DoubleType())])

    def block(epdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
        ids, q_ids = epdf["id"], qpdf["query_id"]
        if len(ids) and len(q_ids):
            e, ev = unit_rows(epdf["embedding"].tolist(), dim)
            q, qv = unit_rows(qpdf["vector"].tolist(), dim)
            qi, ri, s = block_top(e, ev, q, qv, ids.rank(method="first").to_numpy(), threshold, k)
        else:
            qi, ri, s = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return pd.DataFrame({"query_id": q_ids.iloc[qi].array, "id": ids.iloc[ri].array, "sim": s})

    scores = (dealt(emb, "id", "eb", eb, "qb", qb).groupBy("qb", "eb")
              .cogroup(dealt(queries, "query_id", "qb", qb, "eb", eb).groupBy("qb", "eb"))
              .applyInPandas(block, schema))
    return rank_topk(scores, k)


def searchable(embeddings: DataFrame, listings: DataFrame) -> DataFrame:
    """Embeddings that join a listing (keys only, so the semi join shuffles ids, not
    listing rows)."""
    e = embeddings.select(F.col("listing_id").alias("id"), "embedding")
    return e.join(listings.select("id"), "id", "left_semi")


def vector_rejects(embeddings: DataFrame, dim: int = VECTOR_DIM_DECLARED, key: str = "listing_id") -> DataFrame:
    """The vectors that no search uses, with the reason."""
    v = F.col("embedding")
    reason = (F.when(v.isNull(), "missing vector").when(F.size(v) != dim, "wrong dimension").otherwise("bad component"))
    return embeddings.filter(~usable(v, dim)).select(key, reason.alias("reject_reason"))


def match_listings(embeddings: DataFrame, listings: DataFrame, queries: DataFrame,
                   threshold: float = DEFAULT_THRESHOLD, k: int = DEFAULT_K,
                   columns: list[str] | None = None, **kw) -> DataFrame:
    """Batch form of the reference's search function: one result set per query_id."""
    hits = knn(searchable(embeddings, listings), queries, threshold, k, **kw)
    cols = columns or [c for c in listings.columns]
    attrs = listings.select(*cols)
    return hits.join(attrs, "id", "inner")


def knn_single_native(emb: DataFrame, query_vector: list[float], threshold: float,
                      k: int) -> DataFrame:
    """One query, fully JVM side: the query vector is a literal array, similarity is a
    higher-order-function expression, and the global top-k is a TakeOrderedAndProject.  The
    threshold is applied to the k rows (a filter below would score every vector twice)."""
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    emb = emb.filter(usable(F.col("embedding"), len(query_vector)))
    scored = emb.select("id", cosine_expr(F.col("embedding"), q).alias("sim"))
    top = scored.orderBy(F.round("sim", 6).desc_nulls_last(), F.col("id").asc()).limit(k)
    return top.filter(F.col("sim") > F.lit(threshold)).select("id", F.round("sim", 6).alias("similarity"))


def centroids(emb: DataFrame, by: str | None = None, out: str = "query_id") -> DataFrame:
    """Mean vector per group (or of all): one summarizer aggregate with partial sums."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    rows = emb.select(*([F.col(by).alias(out)] if by else []),
                      array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    mean = vector_to_array(Summarizer.mean(F.col("v"))).alias("embedding")
    return (rows.groupBy(out) if by else rows.groupBy()).agg(mean)


def lsh_candidates(emb: DataFrame, queries: DataFrame, threshold: float, k: int, dim: int,
                   tables: int = 32, bits: int = 4, seed: int = 7, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Approximate path: each of ``tables`` keys is the side of ``bits`` random hyperplanes a
    vector lies on; vectors that share a key with a query are scored exactly and ranked.
    Recall < 1 by design (a pair at angle a shares a key with probability
    1 - (1 - (1 - a / pi) ** bits) ** tables); exact paths are ``knn``.

    A table's vectors and queries are dealt into pairs of blocks as in ``knn``; in a block those
    of equal keys are scored as matrices and only the k best of a query leave it.  So no pair
    of vectors is ever a row, but for at most k of each query, table and block."""
    planes = np.random.default_rng(seed).normal(size=(tables * bits, dim))

    @F.pandas_udf("array<int>")
    def keys(v: pd.Series) -> pd.Series:
        m = np.array(v.tolist(), dtype=np.float64).reshape(len(v), dim)
        side = (m @ planes.T > 0).reshape(len(v), tables, bits)
        return pd.Series(list((side @ (1 << np.arange(bits))).astype(np.int32)))

    vectors = emb.filter(F.col("id").isNotNull() & usable(F.col("embedding"), dim)).select("id", "embedding")
    asked = queries.filter(F.col("query_id").isNotNull() & usable(F.col("embedding"), dim)) \
        .select("query_id", F.col("embedding").alias("vector"))
    qb, eb = block_count(asked.count(), dim, block_bytes), block_count(vectors.count(), dim, block_bytes)

    def dealt(df: DataFrame, key: str, vector: str, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        return (df.select("*", F.posexplode(keys(vector)).alias("table", "key"))
                .withColumn(mine, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    kinds = dict(queries.dtypes)["query_id"], dict(emb.dtypes)["id"]

    def block(epdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
        ids, q_ids, best_q, best_e = epdf["id"], qpdf["query_id"], [], []
        if len(ids) and len(q_ids):
            e, ev = unit_rows(epdf["embedding"].tolist(), dim)
            q, qv = unit_rows(qpdf["vector"].tolist(), dim)
            rank, ek, qk = ids.rank(method="first").to_numpy(), epdf["key"].to_numpy(), qpdf["key"].to_numpy()
            for key in np.unique(qk):
                eat, qat = np.flatnonzero(ek == key), np.flatnonzero(qk == key)
                qi, ri, _ = block_top(e[eat], ev[eat], q[qat], qv[qat], rank[eat], threshold - 1e-9, k)
                best_q.append(qat[qi])
                best_e.append(eat[ri])
        qi, ri = (np.concatenate(x) if x else np.zeros(0, int) for x in (best_q, best_e))
        return pd.DataFrame({"query_id": q_ids.iloc[qi].array, "id": ids.iloc[ri].array})

    pairs = (dealt(vectors, "id", "embedding", "eb", eb, "qb", qb).groupBy("table", "qb", "eb")
             .cogroup(dealt(asked, "query_id", "vector", "qb", qb, "eb", eb).groupBy("table", "qb", "eb"))
             .applyInPandas(block, f"query_id {kinds[0]}, id {kinds[1]}").distinct())
    scored = (pairs.join(vectors.select("id", F.col("embedding").alias("_e")), "id")
              .join(asked.select("query_id", F.col("vector").alias("_q")), "query_id")
              .select("query_id", "id", cosine_expr(F.col("_e"), F.col("_q")).alias("sim")))
    return rank_topk(scored.filter(F.col("sim") > F.lit(threshold)), k)

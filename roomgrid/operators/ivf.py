"""Approximate vector search by an inverted file with compressed vectors.

* ``fit`` learns the coarse centroids by spherical k-means on a documented sample of at most
  about ``sample_rows`` vectors; every vector is then indexed, in its ``ASSIGN`` nearest lists,
  as one signed byte a component with a scale.  An index is a DataFrame, to be written and read
  like any other.
* A query reads its ``probes`` nearest lists.  Lists and the queries that read them are dealt into
  blocks of bounded size, and each pair of blocks is one group, however long a list is or many
  queries read it.  A group scores its compressed vectors by a matrix product and keeps the best
  ``refine`` for each query.
* The best ``refine`` of all lists are scored exactly from the full vectors and ranked as the
  exact search ranks.  So reported scores are exact; only recall is below 1.

How many lists a query must read depends on the vectors: few where they cluster, most where
they do not, as compressed vectors are then the whole saving.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomgrid.functions.vectors import cosine_expr, unit_rows, usable
from roomgrid.operators.search import rank_topk

LISTS, ASSIGN, PROBES, REFINE = 16, 2, 10, 50
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 65_536     # compressed vectors of a list in one group
BLOCK_QUERIES = 4_096


def fit(emb: DataFrame, dim: int, lists: int = LISTS, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> np.ndarray:
    """Unit centroids (lists x dim) of (id, embedding)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    good = emb.filter(usable(F.col("embedding"), dim))
    n = good.count()
    if n == 0:
        return np.eye(1, dim)
    part = min(1.0, sample_rows / n)
    rows = (good.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(part * (1 << 30)))
            .filter(F.exists("embedding", lambda x: x != 0))
            .select("id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
            .repartition(8, "id").sortWithinPartitions("id"))
    if rows.isEmpty():
        return np.eye(1, dim)
    model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=20).fit(rows)
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)


def _nearest(centroids: np.ndarray, many: int):
    many = min(many, len(centroids))

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        m, _ = unit_rows(v.tolist(), centroids.shape[1])
        return pd.Series(list(np.argsort(-(m @ centroids.T), axis=1, kind="stable")[:, :many].astype(np.int32)))

    return nearest


def index(emb: DataFrame, centroids: np.ndarray, assign: int = ASSIGN) -> DataFrame:
    """(id, embedding) -> (list, id, scale, code) of every usable vector but zero ones."""
    dim = centroids.shape[1]

    @F.pandas_udf("struct<scale:double,code:binary>")
    def packed(v: pd.Series) -> pd.DataFrame:
        m, _ = unit_rows(v.tolist(), dim)
        scale = np.abs(m).max(axis=1) / 127 if len(m) else np.zeros(0)
        code = np.rint(m / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
        return pd.DataFrame({"scale": scale, "code": [c.tobytes() for c in code]})

    rows = emb.filter(F.col("id").isNotNull() & usable(F.col("embedding"), dim)).select("id", "embedding")
    return (rows.withColumn("p", packed("embedding")).filter("p.scale > 0")
            .select("id", "p.scale", "p.code", F.explode(_nearest(centroids, assign)("embedding")).alias("list")))


def search(found_in: DataFrame, emb: DataFrame, queries: DataFrame, centroids: np.ndarray, threshold: float, k: int,
           probes: int = PROBES, refine: int = REFINE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Top k of each query (query_id, embedding): (query_id, id, similarity, rank)."""
    return rank_topk(refined(found_in, emb, queries, centroids, probes, refine, block_rows, block_queries)
                     .filter(F.col("sim") > F.lit(threshold)), k)


def refined(found_in: DataFrame, emb: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int = PROBES,
            refine: int = REFINE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The vectors scored exactly: (query_id, id, sim)."""
    dim = centroids.shape[1]
    queries = queries.filter(usable(F.col("embedding"), dim)).select("query_id", "embedding")
    asked = queries.select("query_id", "embedding", F.explode(_nearest(centroids, probes)("embedding")).alias("list"))
    # a row for each list, at most as many as there are centroids
    longest = found_in.groupBy("list").count().agg(F.max("count")).first()[0] or 0
    most = asked.groupBy("list").count().agg(F.max("count")).first()[0] or 0
    vb, qb = max(1, -(-longest // block_rows)), max(1, -(-most // block_queries))

    def dealt(df: DataFrame, key: str, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(mine, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("list", "vb", "qb"))

    def block(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": q["query_id"][:0], "id": v["id"][:0], "near": np.zeros(0)})
        code = np.frombuffer(b"".join(v["code"]), np.int8).reshape(len(v), dim).astype(np.float32)
        m, _ = unit_rows(q["embedding"].tolist(), dim)
        out_q, out_v, near = [], [], []
        for lo in range(0, len(m), 256):
            s = (m[lo:lo + 256].astype(np.float32) @ code.T) * v["scale"].to_numpy(np.float32)
            top = np.argpartition(-s, min(refine, len(v)) - 1, axis=1)[:, :refine]
            out_q.append(np.repeat(np.arange(lo, lo + len(s)), top.shape[1]))
            out_v.append(top.ravel())
            near.append(np.take_along_axis(s, top, 1).ravel())
        return pd.DataFrame({"query_id": q["query_id"].iloc[np.concatenate(out_q)].array,
                             "id": v["id"].iloc[np.concatenate(out_v)].array, "near": np.concatenate(near).astype(np.float64)})

    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                           T.StructField("id", emb.schema["id"].dataType), T.StructField("near", T.DoubleType())])
    scored = (dealt(found_in, "id", "vb", vb, "qb", qb).cogroup(dealt(asked, "query_id", "qb", qb, "vb", vb))
              .applyInPandas(block, schema))
    once = scored.groupBy("query_id", "id").agg(F.max("near").alias("sim"))     # a vector may be in several lists
    pairs = rank_topk(once, refine).select("query_id", "id")
    return (pairs.join(emb.select("id", F.col("embedding").alias("_v")), "id")
            .join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
            .select("query_id", "id", cosine_expr(F.col("_v"), F.col("_q")).alias("sim")))

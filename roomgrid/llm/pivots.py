"""Exact top-k inner products by pivot-table elimination.

Vectors become integers, floor(scale * x).  With one more component that lifts every vector to
the same length, the largest inner product is the smallest Euclidean distance, so the triangle
inequality holds: for a pivot p, |d(q, p) - d(x, p)| bounds d(q, x) from below.  The distances
of all vectors to the pivots are computed once and kept with the vectors.  For a query, the
largest bound over all pivots gives each candidate the highest score it can have; candidates
are evaluated in that order until the next one cannot reach the k-th best score so far.  The
k-th best score among the pivots is a first limit.  Nothing is dropped that could be in the
result, ties included.

Queries and vectors are dealt into blocks of bounded size; every pair of blocks is one group,
which returns at most k rows for each query, and a ranking of those is the result.  The pivots
are chosen farthest-first from a sample of ``sample`` vectors (a documented bound).

Defined results: vectors that are null, empty, of another length than most (on a tie the
longest), or hold a null or non-finite component take no part; nor do null ids.  Rows with the
query's id are its own.  Repeated query rows ask once, repeated candidate rows count apart.
Equal scores go by id.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIVOTS = 32
SAMPLE = 2048
BLOCK_BYTES = 4 << 20
SCALE = 256.0


def quantised(vec: Column, scale: float = SCALE) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & ~bad


def _rows(col: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), width)


def choose(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of up to ``n`` different rows."""
    picked = [0]
    gap = np.full(len(vectors), np.inf)
    while len(picked) < min(n, len(vectors)):
        d = vectors - vectors[picked[-1]]
        gap = np.minimum(gap, (d * d).sum(axis=1))
        if gap.max() <= 0:
            break
        picked.append(int(gap.argmax()))
    return vectors[picked]


def top_of_block(qid, q, cid, x, table, pivots, lift, top: float, k: int, stats: dict | None = None):
    """(query, candidate, score) of the best ``k`` of a block of candidates for each query;
    further ones that tie with the k-th and have larger ids are left out."""
    norm = (q * q).sum(axis=1)
    to_pivot = np.sqrt(np.maximum(norm[:, None] + top - 2.0 * (q @ pivots.T), 0.0))
    order_id = np.argsort(cid, kind="stable")
    cid, x, table = cid[order_id], x[order_id], table[order_id].astype(np.float64)
    out_q, out_c, out_s = [], [], []
    done = 0
    for i in range(len(q)):
        low = np.zeros(len(x))
        for p in range(len(pivots)):
            np.maximum(low, np.abs(to_pivot[i, p] - table[:, p]), out=low)
        # table values are single precision: give the bound that much slack
        low = np.maximum(low - 1e-6 * (np.sqrt(top) + to_pivot[i].max() + 1.0), 0.0)
        most = (norm[i] + top - low * low) / 2.0 + 1e-6 * (norm[i] + top + 1.0)
        order = np.argsort(-most, kind="stable")
        best_s, best_c = np.zeros(0), np.zeros(0, np.int64)
        a, step = 0, 64
        while a < len(order):
            if len(best_s) == k and most[order[a]] < best_s[-1]:
                break
            at = order[a:a + step]
            if len(best_s) == k:
                at = at[most[at] >= best_s[-1]]
            done += len(at)
            s, c = x[at] @ q[i], cid[at]
            s, c = s[c != qid[i]], c[c != qid[i]]
            best_s, best_c = np.concatenate([best_s, s]), np.concatenate([best_c, c])
            keep = np.lexsort((best_c, -best_s))[:k]
            best_s, best_c = best_s[keep], best_c[keep]
            a += step
            step *= 2
        out_q.append(np.full(len(best_s), qid[i]))
        out_c.append(best_c)
        out_s.append(best_s)
    if stats is not None:
        stats["evaluated"] = stats.get("evaluated", 0) + done
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
           scale: float = SCALE, n_pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, id, score): the best ``k`` of all other rows for each query row."""
    rows = (vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
            .select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), quantised(F.col(vec_col), scale).alias("v")))
    shape = rows.groupBy(F.size("v").alias("dim")).agg(
        F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("top"))
    shape = shape.orderBy(F.desc("n"), F.desc("dim")).first()
    if shape is None:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    dim, n, top = shape["dim"], shape["n"], float(shape["top"])
    rows = rows.filter(F.size("v") == dim)
    some = rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).select("v").toPandas()["v"]
    pivots = choose(np.array([list(v) for v in some], dtype=np.float64), n_pivots)
    lift = np.sqrt(np.maximum(top - (pivots * pivots).sum(axis=1), 0.0))

    packed = T.StructType([T.StructField("vec", T.BinaryType()), T.StructField("table", T.BinaryType())])

    @F.arrow_udf(packed)
    def with_table(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), dim)
        own = np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))
        d2 = ((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2.0 * (x @ pivots.T)
              + (own[:, None] - lift) ** 2)
        d = np.sqrt(np.maximum(d2, 0.0)).astype(np.float32)
        x = x.astype(np.float64)
        return pa.StructArray.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()),
                                           pa.array([r.tobytes() for r in d], pa.binary())], names=["vec", "table"])

    base = rows.select("id", "asks", with_table("v").alias("p")).select("id", "asks", "p.vec", "p.table").checkpoint()
    per_block = max(1, BLOCK_BYTES // (8 * dim + 4 * len(pivots)))
    ask = base.filter("asks").select("id", "vec").dropDuplicates(["id", "vec"])
    n_q = ask.count()
    c_blocks, q_blocks = -(-n // per_block), max(1, -(-n_q // max(1, per_block // 8)))

    def spread(df: DataFrame, mine: str, blocks: int, other: str, others: int) -> DataFrame:
        return (df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))))

    queries = spread(ask, "qb", q_blocks, "cb", c_blocks)
    cands = spread(base.select("id", "vec", "table"), "cb", c_blocks, "qb", q_blocks)

    def run(key, q: pa.Table, c: pa.Table) -> pa.Table:
        if q.num_rows and c.num_rows:
            qid, cid = q.column("id").to_numpy(), c.column("id").to_numpy()
            x = top_of_block(qid, _rows(q.column("vec"), np.float64, dim), cid, _rows(c.column("vec"), np.float64, dim),
                             _rows(c.column("table"), np.float32, len(pivots)), pivots, lift, top, k)
        else:
            x = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": x[0].astype(np.int64), "id": x[1].astype(np.int64), "score": x[2].astype(np.int64)})

    best = queries.groupBy("qb", "cb").cogroup(cands.groupBy("qb", "cb")).applyInArrow(
        run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

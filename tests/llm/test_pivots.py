"""Pivot search against brute force."""
import math
import random

import duckdb
import numpy as np

from roomgrid.llm import catalogue
from roomgrid.llm import pivots as P


def brute(rows, k=5):
    v = {}
    rows = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e and len(e) == 8
            and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i in sorted({i for i, _ in rows if i % 50 == 0}):
        for q in {tuple(e) for j, e in rows if j == i}:
            s = sorted((-sum(a * b for a, b in zip(q, e)), j) for j, e in rows if j != i)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def vectors():
    r = random.Random(3)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(700):
        c = r.choice(base)
        rows.append((i, [float(np.float32(x + r.gauss(0, 0.05 if i % 3 else 1))) for x in c]))
    rows += [(i, rows[3][1]) for i in range(700, 900)]          # one very common vector
    rows += [(900, None), (901, [1.0] * 7), (902, [1.0] * 7 + [None]), (903, [float("nan")] * 8), (904, []),
             (None, [1.0] * 8), (905, [math.inf] + [0.0] * 7), rows[50], rows[7], (950, [0.0] * 8)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BYTES", 20_000)    # several blocks of both sides
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as cb")
    got = sorted(map(tuple, P.search(df, P.F.col("vec_id") % 50 == 0).collect()))
    assert got == brute(vectors())
    assert P.search(df.limit(0), P.F.col("vec_id") % 50 == 0).count() == 0
    one = df.filter("vec_id = 0")
    assert P.search(one, P.F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_eliminate_candidates():
    r = np.random.default_rng(1)
    centres = r.normal(0, 200, (20, 16))
    x = np.floor(centres[r.integers(0, 20, 4000)] + r.normal(0, 4, (4000, 16)))
    top = (x * x).sum(axis=1).max()
    pivots = P.choose(x[:500], 32)
    lift = np.sqrt(top - (pivots * pivots).sum(axis=1))
    own = np.sqrt(top - (x * x).sum(axis=1))
    table = np.sqrt(((x[:, None] - pivots) ** 2).sum(axis=2) + (own[:, None] - lift) ** 2).astype(np.float32)
    stats = {}
    q, c, s = P.top_of_block(np.arange(50), x[:50], np.arange(4000), x, table, pivots, lift, top, 5, stats)
    want = [sorted((-(x[i] @ x[j]), j) for j in range(4000) if j != i)[:5] for i in range(50)]
    assert [(-a, b) for a, b in zip(s, c)] == [t for w in want for t in w]
    assert stats["evaluated"] < 0.5 * 50 * 4000


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    got = catalogue.QUERIES["op2_top_k"](spark, sf)
    want = con.execute(catalogue.ORACLES["op2_top_k"]).fetchdf()
    assert sorted(map(tuple, got.collect())) == sorted(want[got.columns].itertuples(index=False, name=None))

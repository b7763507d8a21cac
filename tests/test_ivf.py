"""Inverted file: recall on clustered vectors, exact scores, blocks, unusable vectors."""
import numpy as np

from roomgrid.operators import ivf as IVF
from roomgrid.operators import search as S

DIM = 16


def clustered(n=1500, clusters=30):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(clusters, DIM))
    return [(i, [float(x) for x in centre[0 if i % 3 == 0 else i % clusters] + 0.25 * rng.normal(size=DIM)]) for i in range(n)]


def test_recall_and_blocks(spark):
    rows = clustered()
    emb = spark.createDataFrame(rows + [(9001, None), (9002, [0.0] * DIM), (9003, [1.0]), (9004, [float("nan")] * DIM), (None, rows[0][1])],
                                "id long, embedding array<float>")
    queries = emb.filter("id % 50 = 0").selectExpr("id as query_id", "embedding")
    centroids = IVF.fit(emb, DIM, lists=24)
    assert np.allclose(centroids, IVF.fit(emb, DIM, lists=24))
    lists = IVF.index(emb, centroids, 1).checkpoint()
    assert sorted(r["id"] for r in lists.select("id").collect()) == [i for i, _ in rows]     # every usable row is indexed
    want = {(r["query_id"], r["id"]): r["similarity"] for r in S.knn(emb, queries, 0.2, 5, dim=DIM).collect()}
    results = []
    for block_rows, block_queries in ((65_536, 4_096), (40, 3)):    # the hot list spans many blocks of either side
        got = IVF.search(lists, emb, queries, centroids, 0.2, 5, probes=4, refine=40, block_rows=block_rows, block_queries=block_queries)
        got = {(r["query_id"], r["id"]): r["similarity"] for r in got.collect()}
        assert all(abs(want[p] - s) < 1e-6 for p, s in got.items() if p in want)
        assert sum(p in got for p in want) >= 0.9 * len(want)
        results.append(got)
    assert results[0] == results[1]
    scored = IVF.refined(lists, emb, queries, centroids, 4, 40).count()
    assert scored <= 0.2 * len(rows) * queries.count()


def test_no_rows(spark):
    emb = spark.createDataFrame([], "id string, embedding array<float>")
    queries = spark.createDataFrame([("q", [1.0] * DIM)], "query_id string, embedding array<float>")
    centroids = IVF.fit(emb, DIM)
    assert IVF.search(IVF.index(emb, centroids), emb, queries, centroids, 0.0, 5).count() == 0
    one = spark.createDataFrame([("a", [1.0] * DIM)], "id string, embedding array<float>")
    centroids = IVF.fit(one, DIM)
    lists = IVF.index(one, centroids)
    assert [r["id"] for r in IVF.search(lists, one, queries, centroids, 0.0, 5).collect()] == ["a"]
    assert IVF.search(lists, one, queries.limit(0), centroids, 0.0, 5).count() == 0

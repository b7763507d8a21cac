"""The search table function against the batch operator, and its defined results."""
import datetime as dt

from roomgrid import schemas as SC
from roomgrid.operators import search as S
from roomgrid.operators import search_sql as SQ
from roomgrid.sources import views as V

NAN, INF = float("nan"), float("inf")


def test_equals_the_batch_search(spark, sf):
    lst, emb = V.listings(spark, sf), V.listing_embeddings(spark, sf)
    SQ.register_match_listings(spark, lst, emb)
    q = [0.3 - 0.01 * i for i in range(64)]
    got = spark.sql(f"SELECT id, title, similarity FROM match_listings(array({','.join(f'{x}D' for x in q)}), 0.05D, 7)")
    want = S.match_listings(emb, lst, spark.createDataFrame([(0, q)], "query_id int, embedding array<float>"), 0.05, 7, dim=64)
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(map(tuple, want.select("id", "title", "similarity").collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "TakeOrderedAndProject(limit=7" in plan          # the best k of each task, then of all


def test_defined_results_and_columns(spark):
    lst = spark.createDataFrame([(i, f"t{i}", i, dt.datetime(2024, 1, 1)) for i in range(1, 9)],
                                "id long, title string, landlord_id int, created_at timestamp").withColumn("similarity", SQ.F.lit("x"))
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [1.0]), (5, [NAN, 1.0]), (6, [INF, 1.0]),
                                 (7, [0.0, 0.0]), (8, [1.0, None]), (99, [1.0, 0.0]), (None, [1.0, 0.0])],
                                "listing_id long, embedding array<float>")
    SQ.register_match_listings(spark, lst, emb, "other_search")
    got = spark.sql("SELECT * FROM other_search(array(1D, 0D), 0.5D, 5)")
    assert got.columns == [f.name for f in SC.LISTINGS] + ["similarity"] and len(got.columns) == 25
    assert sorted((r.id, r.title, r.landlord_id, r.floor_number, r.similarity) for r in got.collect()) == \
        [(1, "t1", 1, None, 1.0), (2, "t2", 2, None, 1.0)]
    assert [r.id for r in spark.sql("SELECT id FROM other_search(array(1D, 0D), 0.5D, 1)").collect()] == [1]   # a tie: smaller id
    for call in ("NULL, 0.5D, 5", "array(1D, 0D), 1D, 5", "array(1D, 0D), 0.5D, 0", "array(CAST('NaN' AS DOUBLE), 0D), -1D, 5"):
        assert spark.sql(f"SELECT * FROM other_search({call})").count() == 0
    # the function joins other tables as any relation does
    assert spark.sql("SELECT l.title FROM other_search(array(1D, 0D), 0.5D, 5) s JOIN other_search_listings l USING (id)").count() == 2

"""Versioned snapshots: pinned readers, invisible failed writes, batches that run again."""

import pytest
from pyspark.sql import functions as F

from roomgrid.sources import snapshots as SNAP


def plus(n):
    return lambda old: old.unionByName(old.sparkSession.createDataFrame([(n,)], "x int"))


def test_versions_pinned_readers_and_repeated_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert SNAP.versions(spark, path) == []
    with pytest.raises(LookupError):
        SNAP.read(spark, path)
    SNAP.commit(spark, path, "a/1", lambda old: spark.range(0).select(F.col("id").cast("int").alias("x")))
    pinned = SNAP.read(spark, path)
    SNAP.commit(spark, path, "b", plus(1))
    again = SNAP.commit(spark, path, "b", plus(1))
    SNAP.commit(spark, path, "c", plus(2))
    assert again.number == 2
    assert [(v.number, v.batch) for v in SNAP.versions(spark, path)] == [(1, "a/1"), (2, "b"), (3, "c")]
    assert pinned.count() == 0
    assert [r.x for r in SNAP.read(spark, path, 2).collect()] == [1]
    assert sorted(r.x for r in SNAP.read(spark, path).collect()) == [1, 2]
    with pytest.raises(LookupError):
        SNAP.read(spark, path, 9)
    with pytest.raises(ValueError):
        SNAP.commit(spark, path, "", plus(3))


def test_failed_write_is_invisible_and_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "t")
    SNAP.commit(spark, path, "a", lambda old: spark.createDataFrame([(0,)], "x int"))
    with pytest.raises(Exception):
        SNAP.commit(spark, path, "b", lambda old: old.select(F.expr("cast(raise_error('lost') as int)").alias("x")))
    assert [v.batch for v in SNAP.versions(spark, path)] == ["a"]
    assert [r.x for r in SNAP.read(spark, path).collect()] == [0]
    made = SNAP.commit(spark, path, "b", plus(1))
    assert made.committed and sorted(r.x for r in SNAP.read(spark, path).collect()) == [0, 1]
    # a folder that a lost driver left without a marker keeps its number, and is not read
    (tmp_path / "t" / f"v{made.number + 1:08d}-c").mkdir()
    assert SNAP.read(spark, path).count() == 2
    assert SNAP.commit(spark, path, "c", plus(2)).number == made.number + 2

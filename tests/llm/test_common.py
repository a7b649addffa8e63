import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessera.llm.common import lowest, slices


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_slices(kind):
    texts = [None, "", "é" * 10, "b", "c", None, "d" * 50, "e"]
    found = list(slices(pa.array(texts, kind), limit=20))
    assert [x for a, b, own in found for x in own] == [t or "" for t in texts]
    assert [(a, b) for a, b, _ in found] == [(0, 3), (3, 7), (7, 8)]
    assert all(b - a == len(own) for a, b, own in found)
    assert list(slices(pa.array([], kind))) == []
    part = pa.array(texts, kind).slice(3, 2)
    assert list(slices(part)) == [(0, 2, ["b", "c"])]


def test_slices_of_bad_utf8():
    column = pa.array([b"ok", b"\xff\xfe"]).view(pa.string())
    assert list(slices(column)) == [(0, 2, ["ok", "��"])]


@pytest.mark.parametrize("want", [0, 1, 50, 5000])
def test_lowest(spark, want):
    df = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    found = [r.id for r in lowest(df, F.col("h"), want, 20_000, "id").collect()]
    assert found == [r.id for r in sorted(df.collect(), key=lambda r: (r.h, r.id))[:want]]
    assert lowest(df.limit(0), F.col("h"), want, 0, "id").count() == 0


def test_lowest_leaves_rows_out_beforehand(spark):
    df = spark.range(1_000_000)
    plan = lowest(df, F.xxhash64("id"), 100, 1_000_000, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan

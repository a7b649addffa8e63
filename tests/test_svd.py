import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import svd
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def sparse(spark, x):
    rows = [(n, [int(i) for i in np.flatnonzero(r)], [float(r[i]) for i in np.flatnonzero(r)]) for n, r in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id long, i array<int>, w array<double>").repartition(5)


def made(n=400, d=150, seed=3):
    rng = np.random.default_rng(seed)
    low = rng.gamma(1.0, size=(n, 12)) @ rng.gamma(0.6, size=(12, d))
    return np.round(low * (rng.random((n, d)) < 0.3) / 10, 4)


def test_is_the_dense_decomposition(spark):
    x = made()
    rows, parts = sparse(spark, x), 20
    model = svd.fit(rows, x.shape[1], parts)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.abs(model.values / s[:parts] - 1).max() < 0.01
    assert np.abs(model.vectors.T @ model.vectors - np.eye(parts)).max() < 1e-9
    assert np.abs((model.vectors[:, :3] * vt[:3].T).sum(0)).min() > 0.999
    share = (x @ model.vectors).var(0) / x.var(0).sum()
    assert np.allclose(model.explained, share, rtol=1e-6)
    found = svd.project(rows, model).orderBy("doc_id").toPandas()
    assert list(found.columns) == ["doc_id", "components"]
    assert np.allclose(np.stack(found["components"]), x @ model.vectors, atol=1e-9)


@pytest.mark.parametrize("strip", [7, 256])
def test_squares_by_strips(strip, monkeypatch):
    """The strips hold X'X, whatever their width."""
    x = made(300, 30)
    monkeypatch.setattr(svd, "STRIP", strip)
    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    batch = pa.record_batch([pa.array([i for i, _ in rows], pa.list_(pa.int32())), pa.array([w for _, w in rows], pa.list_(pa.float64()))], ["i", "w"])
    found = np.zeros((30, 30))
    for b in svd._squares(30)([batch, batch]):
        a = b.column("strip")[0].as_py() * strip
        found[a : a + strip, a:] = np.frombuffer(b.column("y")[0].as_py()).reshape(-1, 30 - a)
    assert np.allclose(np.triu(found), np.triu(2 * x.T @ x), atol=1e-12)


def test_rows_are_read_once(spark):
    """More passes multiply no more rows: the passes read X'X."""
    x, seen = made(), spark.sparkContext.accumulator(0)
    rows = sparse(spark, x)
    count = F.udf(lambda i: (seen.add(1), i)[1], "array<int>").asNondeterministic()
    svd.gram(rows.withColumn("i", count("i")), x.shape[1]).count()
    once = seen.value
    svd.fit(rows.withColumn("i", count("i")), x.shape[1], 20, tolerance=0.0, passes=6)
    assert once == len(x) and seen.value - once <= 3 * len(x)


def test_terms_of_the_documents(spark):
    """Singular values on real weights, all components asked for."""
    model, rows = catalogue.svd_model(spark, SF)
    train = rows.filter("split = 'train'").toPandas()
    x = np.zeros((len(train), len(model.vectors)))
    for n, (i, w) in enumerate(zip(train["i"], train["w"], strict=True)):
        x[n, np.asarray(i, int)] = w
    s = np.linalg.svd(x, compute_uv=False)
    s = s[s > 1e-6 * s[0]][:250]
    assert len(model.values) == len(s)
    assert np.abs(model.values / s - 1).max() < 0.01
    assert 0.99 < model.explained.sum() < 1.01


@pytest.mark.parametrize("x", [np.zeros((0, 6)), np.zeros((5, 6)), np.eye(6)[:1], np.ones((7, 6))])
def test_few_directions(spark, x):
    """An empty table, rows without weights, one row, equal rows: as many components as there are directions."""
    model = svd.fit(sparse(spark, x), 6, 4)
    rank = int(np.linalg.matrix_rank(x)) if x.size else 0
    assert len(model.values) == rank and model.vectors.shape == (6, rank)
    assert np.isfinite(model.explained).all()
    assert svd.project(sparse(spark, x), model).count() == len(x)


def test_boosted_trees_bend(spark):
    """A class that no line in the components separates."""
    rng = np.random.default_rng(5)
    z = rng.random((600, 2))
    label = ((z[:, 0] > 0.5) ^ (z[:, 1] > 0.5)).astype(int)
    rows = [(i, [float(a), float(b)], int(y)) for i, ((a, b), y) in enumerate(zip(z, label, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, c array<double>, label int").withColumn("features", array_to_vector("c"))
    train, test = df.filter("doc_id < 400"), df.filter("doc_id >= 400")
    out = svd.boosted(rounds=10).fit(train).transform(test)
    assert out.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.9

"""Truncated singular value decomposition of sparse rows, and boosted trees on its components.

The rows are not centred.  X'X is added up over partitions once and kept in
strips of features.  A random basis of the features is multiplied by it again
and again (a range finder with power steps) and made orthonormal in between;
the last product, seen in that basis, gives the singular values and vectors.  A
pass reads the strips alone; what reaches the driver is a number for each
feature and direction, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.kept import written

#: Rows that are spread out at a time (256 x features doubles), and features of a strip of X'X.
BLOCK, STRIP = 256, 256


def _blocks(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    """The rows of a batch (list columns i and w), spread out block by block."""
    for a in range(0, batch.num_rows, BLOCK):
        i, w = (batch.column(c).slice(a, BLOCK) for c in ("i", "w"))
        x = np.zeros((len(i), d))
        row = np.repeat(np.arange(len(i)), i.value_lengths().to_numpy(zero_copy_only=False))
        x[row, i.flatten().to_numpy(zero_copy_only=False)] = w.flatten().to_numpy(zero_copy_only=False)
        yield x


def _record(at: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(at, pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))], ["i", "y"])


def _squares(d: int):
    """X'X on and right of the diagonal: a row for each strip that has any weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips = [np.zeros((min(STRIP, d - a), d - a)) for a in range(0, d, STRIP)]
        for b in batches:
            for x in _blocks(b, d):
                for k, y in enumerate(strips):
                    a = k * STRIP
                    y += x[:, a : a + STRIP].T @ x[:, a:]
        for k, y in enumerate(strips):
            if y.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([y.tobytes()], pa.binary())], ["strip", "y"])

    return run


def _strip(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    y = sum(np.frombuffer(v.as_buffer()) for b in batches for v in b.column("y"))
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([y.tobytes()], pa.binary())], ["strip", "y"])


def gram(rows: DataFrame, d: int) -> DataFrame:
    """(strip, y): X'X of rows with arrays i and w on and right of the diagonal, ``STRIP`` features to a row, as bytes in the shared folder.

    A task holds d x d / 2 doubles; each core's are shuffled once.
    """
    # As many partial sums as there are cores, not one for each split of the table.
    few = rows.select("i", "w").coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    kind = "strip int, y binary"
    return written(few.mapInArrow(_squares(d), kind).groupBy("strip").applyInArrow(_strip, kind), "gram")


def _product(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        y = np.zeros_like(q)
        for strip, v in (r for b in batches for r in zip(b.column("strip"), b.column("y"), strict=True)):
            a = strip.as_py() * STRIP
            z = np.frombuffer(v.as_buffer()).reshape(-1, len(q) - a)
            n = len(z)
            y[a : a + n] += z @ q[a:]
            y[a + n :] += z[:, n:].T @ q[a : a + n]
        at = np.flatnonzero(y.any(1))
        yield _record(at, y[at])

    return run


def _added(d: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, seen = np.zeros((d, parts)), np.zeros(d, bool)
        for b in batches:
            at = b.column("i").to_numpy()
            np.add.at(y, at, b.column("y").flatten().to_numpy().reshape(len(at), parts))
            seen[at] = True
        at = np.flatnonzero(seen)
        yield _record(at, y[at])

    return run


@dataclass
class SVD:
    """values: the singular values, falling; vectors: features x components; explained: each component's share of the variance."""

    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, features: int, parts: int = 250, passes: int = 20, more: int = 50, tolerance: float = 1e-3, seed: int = 42) -> SVD:
    """The leading ``parts`` components of rows with arrays i and w (``linear.vectors``), i below ``features``.

    Fewer come back where the rows span fewer directions, none for rows without
    any weight.  ``more`` directions are carried along to make the last of them
    sharp; passes end when none of the values moves by more than ``tolerance``
    of itself.  Tasks hold features x features / 2 doubles, the driver features
    x (parts + more).
    """
    spark, x = rows.sparkSession, rows.select("i", "w")
    width = min(parts + more, features)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]
    few = gram(x, features).coalesce(spark.sparkContext.defaultParallelism)
    values = np.zeros(0)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(q)
        sums = few.mapInArrow(_product(shared), "i int, y array<double>").repartition("i").mapInArrow(_added(features, width), "i int, y array<double>").toArrow()
        y = np.zeros((features, width))
        if sums.num_rows:
            y[sums.column("i").to_numpy()] = np.array(sums.column("y").combine_chunks().flatten()).reshape(-1, width)
        shared.unpersist()
        square, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
        best = np.argsort(-square, kind="stable")[:parts]
        best = best[square[best] > 1e-12 * max(square.max(initial=0), 1e-300)]
        before, values, vectors = values, np.sqrt(square[best]), q @ turn[:, best]
        if len(before) == len(values) and (np.abs(values - before) <= tolerance * values).all():
            break
        q = np.linalg.qr(y)[0]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(best))] < 0, -1.0, 1.0)
    entry = F.explode(F.arrays_zip("i", "w")).alias("e")
    n = max(x.count(), 1)
    mean, total = np.zeros(features), 0.0
    for r in x.select(entry).groupBy("e.i").agg(F.sum("e.w").alias("s"), F.sum(F.col("e.w") ** 2).alias("ss")).collect():  # at most one row a feature
        mean[r["i"]], total = r["s"] / n, total + r["ss"] / n
    variance = values**2 / n - (mean @ vectors) ** 2
    return SVD(values, vectors, variance / max(total - float(mean @ mean), 1e-300))


def project(rows: DataFrame, model: SVD, name: str = "components") -> DataFrame:
    """``rows`` with an array of their components; i and w go."""
    keep = [c for c in rows.columns if c not in ("i", "w")]
    shared = rows.sparkSession.sparkContext.broadcast(model.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            z = [x @ v for x in _blocks(b, len(v))]
            made = pa.array([r for block in z for r in block.tolist()], pa.list_(pa.float64()))
            yield pa.record_batch([*[b.column(c) for c in keep], made], [*keep, name])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep], f"`{name}` array<double>"])
    return rows.select(*keep, "i", "w").mapInArrow(run, schema)


def spectrum(model: SVD, spark) -> DataFrame:
    """(component, singular_value, explained): one row a component, from 1."""
    rows = [(j + 1, float(s), float(e)) for j, (s, e) in enumerate(zip(model.values, model.explained, strict=True))]
    return spark.createDataFrame(rows, "component int, singular_value double, explained double")


def boosted(rounds: int = 100, seed: int = 42):
    """Boosted trees on ``features``: steps of 0.1, 255 bins, at least 20 rows a leaf, and 32 leaves as depth 5 gives them."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, stepSize=0.1, maxDepth=5, maxBins=255, minInstancesPerNode=20, seed=seed)

"""Exact top-k inner products by columnar branch-and-bound.

Vectors become integers floor(scale * x).  Candidates stay where they are: a
task reads its share of them, longest first, and packs them into blocks in
vertical layout, one row a dimension.  Queries come in runs of bounded size,
each of which is broadcast; a query set that does not fit in one takes several
passes over the candidates.

Scores of a block are accumulated dimension block by dimension block, heaviest
dimensions first.  What the remaining dimensions can add is at most the product
of the remaining norms, so a pair whose bound is below the query's k-th best
score so far is out: blocks that no query of a group needs are passed over by
their largest norm, columns that none needs are compacted away, and once few
pairs are alive only those are multiplied.  A query's bound rises from block to
block.

Only the k best of each query leave a task, and the last ranking is a window by
query over those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import by_dim, matrix, usable

STEP, ROWS, GROUP = 16, 4096, 128
#: From this share of live pairs on down, pairs are multiplied one by one.
FEW = 0.4


class Queries:
    """A run of queries of one length, and the k best units found for each so far."""

    def __init__(self, units: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int):
        self.units, self.ids, self.data, self.k = units, ids, data, k  # data: (queries, dimensions)
        self.norm = np.sqrt((data**2).sum(1))
        self.tau = np.full(len(ids), -np.inf)
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.multiplied = 0

    def search(self, units: np.ndarray, ids: np.ndarray, times: np.ndarray, data: np.ndarray) -> None:
        """Meet a block of candidates, ``data`` as (dimensions, candidates)."""
        dim = len(data)
        weight = np.abs(data).sum(1) + np.abs(self.data).sum(0)
        order = np.argsort(-weight, kind="stable")
        c, steps = data[order], [*range(0, dim, STEP), dim]
        # Sums below 2^24 are exact in single precision.
        top = float(np.abs(data).max(initial=0)) * float(np.abs(self.data).max(initial=0)) * max(dim, 1)
        kind = np.float32 if top < 1 << 24 else np.float64
        c_rest = [np.sqrt((c[s:] ** 2).sum(0)) * (1 + 1e-6) + 1e-6 for s in steps]
        longest, c = c_rest[0].max(initial=0), np.ascontiguousarray(c, kind)
        for start in range(0, len(self.ids), GROUP):
            own = np.arange(start, min(start + GROUP, len(self.ids)))
            own = own[self.norm[own] * (1 + 1e-6) * longest + 1e-6 >= self.tau[own]]
            if not len(own):
                continue
            q = self.data[own][:, order]
            q_rest = [np.sqrt((q[:, s:] ** 2).sum(1)) * (1 + 1e-6) + 1e-6 for s in steps]
            q, tau = q.astype(kind), self.tau[own]
            cols, score, pairs = np.arange(c.shape[1]), np.zeros((len(own), c.shape[1]), kind), None
            for s, (a, b) in enumerate(zip(steps, steps[1:], strict=False), 1):
                if pairs is None:
                    score += q[:, a:b] @ c[a:b, cols]
                    self.multiplied += len(own) * len(cols) * (b - a)
                    alive = score + np.outer(q_rest[s], c_rest[s][cols]) >= tau[:, None]
                    if b < dim and alive.mean() <= FEW:
                        row, col = np.nonzero(alive)
                        pairs = row, cols[col], score[row, col].astype(np.float64)
                    elif not (some := alive.any(0)).all():
                        cols, score, alive = cols[some], score[:, some], alive[:, some]
                else:
                    row, col, sums = pairs
                    sums = sums + np.einsum("ij,ji->i", q[row, a:b], c[a:b, col], dtype=np.float64)
                    self.multiplied += len(row) * (b - a)
                    keep = sums + q_rest[s][row] * c_rest[s][col] >= tau[row]
                    pairs = row[keep], col[keep], sums[keep]
            if pairs is None:
                row, col = np.nonzero((score >= tau[:, None]))
                pairs = row, cols[col], score[row, col].astype(np.float64)
            row, col, sums = pairs
            # The query's own row is no candidate; rows that repeat it are.
            own_row = (ids[col] == self.ids[own][row]) & (units[col] == self.units[own][row])
            count = times[col] - own_row
            ok = count > 0
            self._add(own[row[ok]], sums[ok], ids[col[ok]], count[ok])

    def _add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, times: np.ndarray) -> None:
        by = np.argsort(row, kind="stable")
        row, score, ids, times = row[by], score[by], ids[by], times[by]
        edges = np.r_[np.flatnonzero(np.r_[True, row[1:] != row[:-1]]), len(row)] if len(row) else np.zeros(1, np.int64)
        for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
            r = int(row[a])
            old = self.best.get(r)
            s, i, t = (score[a:b], ids[a:b], times[a:b]) if old is None else (np.r_[old[0], score[a:b]], np.r_[old[1], ids[a:b]], np.r_[old[2], times[a:b]])
            best = np.lexsort((i, -s))[: self.k]
            self.best[r] = s[best], i[best], t[best]
            if len(best) == self.k:
                self.tau[r] = s[best[-1]]

    def rows(self) -> pa.RecordBatch:
        at = [r for r, (s, _, _) in self.best.items() for _ in s]
        join = [np.concatenate([b[j] for b in self.best.values()]) if self.best else np.empty(0) for j in range(3)]
        return pa.record_batch([pa.array(self.units[at]), pa.array(self.ids[at]), pa.array(join[1].astype(np.int64)), pa.array(join[0].astype(np.int64)), pa.array(join[2].astype(np.int64))], ["unit", "query_id", "vec_id", "score", "times"])


_FOUND = "unit long, query_id long, vec_id long, score long, times long"


def _search(run, scale: float, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {d: Queries(*own, k) for d, own in run.value.items()}
        kept: dict[int, list] = {}

        def meet(dim: int) -> None:
            own = kept.pop(dim)
            units, ids, times, data = (np.concatenate([x[j] for x in own]) for j in range(4))
            queries[dim].search(units, ids, times, np.ascontiguousarray(data.T))

        for dim, b in by_dim(batches, 3):
            if dim not in queries:
                continue
            units, ids, times = (b.column(i).to_numpy() for i in range(3))
            data = np.floor(scale * matrix(b.column(3), dim))
            for a in range(0, len(ids), ROWS):
                kept.setdefault(dim, []).append((units[a : a + ROWS], ids[a : a + ROWS], times[a : a + ROWS], data[a : a + ROWS]))
                if sum(len(x[0]) for x in kept[dim]) >= ROWS:
                    meet(dim)
        for dim in list(kept):
            meet(dim)
        for own in queries.values():
            yield own.rows()

    return search


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding", run_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of every query row.

    ``queries`` is a boolean column over the key, named ``vec_id`` in it.  A
    candidate is every row but the query's own.  Vectors that are null or hold a
    null or non-finite component, and null keys, take no part.  Rows that repeat
    a key are rows of their own, as queries and as candidates, with equal or
    other vectors.  Ties go to smaller keys.  Products are taken between vectors
    of the same length.  Scores are exact up to 2^53.  With fewer than ``k``
    candidates all are returned; an empty table gives an empty result; other
    columns are not read.  The driver holds ``run_bytes`` of queries at a time.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable("v"))
    # Rows that are equal in all are one unit; where no row repeats, that is every row.
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    rows = rows.select(F.xxhash64("vec_id", "v").alias("unit"), "vec_id", "times", "v")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    units = materialise(rows.withColumn("norm", norm), "vectors")
    shared = units.sortWithinPartitions(F.desc("norm")).select("unit", "vec_id", "times", "v")
    asked = materialise(units.filter(queries).select("unit", "vec_id", "times", "v"), "queries")
    found, own, size = None, {}, 0

    def flush() -> None:
        nonlocal found, own, size
        run = {d: (np.array([r[0] for r in x], np.int64), np.array([r[1] for r in x], np.int64), np.floor(scale * np.array([r[2] for r in x], np.float64).reshape(len(x), d))) for d, x in own.items()}
        part = materialise(shared.mapInArrow(_search(spark.sparkContext.broadcast(run), scale, k), _FOUND), "found")
        found, own, size = part if found is None else found.unionByName(part), {}, 0

    for r in asked.select("unit", "vec_id", "v").toLocalIterator():
        own.setdefault(len(r["v"]), []).append((r["unit"], r["vec_id"], r["v"]))
        size += 8 * len(r["v"]) + 64
        if size >= run_bytes:
            flush()
    if own or found is None:
        flush()
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k).cast("long")).cast("int"))))
    best = Window.partitionBy("unit", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
    again = ranked.join(asked.filter("times > 1").select("unit", F.col("times").alias("rows")), "unit", "left")
    return again.withColumn("row", F.explode(F.sequence(F.lit(1), F.coalesce("rows", F.lit(1).cast("long")).cast("int")))).select("query_id", "rank", "vec_id", "score")

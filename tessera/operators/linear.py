"""Linear models over sparse term weights, fitted by passes over partitions.

A pass adds up the loss, its gradient and the diagonal of its curvature for
every model at once, in each task first; what reaches the driver is one number
for each model and feature, whatever the number of rows.  The driver moves the
weights by L-BFGS, scaled by that curvature.  Several models that learn from
other rows of the same table, as the folds of a calibration do, share a pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import packed
from tessera.plans.kept import written


def numbered(vocab: DataFrame, *more: str) -> DataFrame:
    """(term, i) and ``more`` columns: the terms in order, numbered from 0."""
    return vocab.select("term", (F.row_number().over(Window.orderBy("term")) - 1).cast("int").alias("i"), *more)  # as many rows as features


def vectors(weights: DataFrame, docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``docs`` (doc_id and any other columns) with arrays i and w of their terms' numbers and weights, written to the shared folder."""
    entry = F.struct("i", F.col("weight").alias("w"))
    x = weights.select("doc_id", "term", "weight").join(F.broadcast(terms), "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("x"))
    y = docs.join(x, "doc_id", "left")
    return written(y.select(*docs.columns, F.coalesce("x.i", F.array().cast("array<int>")).alias("i"), F.coalesce("x.w", F.array().cast("array<double>")).alias("w")), "vectors")


def _rows(i: pa.Array, w: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and weight of each entry of two list columns."""
    sizes = i.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(i)), sizes), i.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False)


def _margins(coef: np.ndarray, row: np.ndarray, at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """models x rows; the last weight of a model is its intercept."""
    return np.stack([np.bincount(row, value * c[at], n) + c[-1] for c in coef])


def loss(kind: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss at z = y * margin, its slope and its curvature."""
    if kind == "svm":
        gap = np.maximum(0, 1 - z)
        return gap**2, -2 * gap, 2.0 * (z < 1)
    p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
    return np.logaddexp(0, -z), -p, p * (1 - p)


#: What a block holds, one value a row but for i and w.
BLOCK = {"sizes": np.int32, "i": np.int32, "w": np.float64, "label": np.float64, "fold": np.int32}


def blocks(rows: DataFrame) -> DataFrame:
    """``vectors`` rows with label and fold as bytes, many rows to one, written to the shared folder: a pass reads them as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in packed.slices(batch, "i"):
                have = {"sizes": b.column("i").value_lengths(), "i": b.column("i").flatten(), "w": b.column("w").flatten(), "label": b.column("label"), "fold": b.column("fold")}
                yield pa.record_batch([pa.array([v.to_numpy(zero_copy_only=False).astype(BLOCK[k]).tobytes()], pa.binary()) for k, v in have.items()], list(have))

    return written(rows.select("i", "w", "label", "fold").mapInArrow(run, ", ".join(f"{k} binary" for k in BLOCK)), "blocks")


def _sums(kind: str, shared, folds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coef = shared.value
        k, d = coef.shape
        total, slope, bend = np.zeros(k), np.zeros((k, d)), np.zeros((k, d))
        for b in (row for batch in batches for row in zip(*[batch.column(k) for k in BLOCK], strict=True)):
            sizes, at, value, y, fold = (np.frombuffer(v.as_buffer(), t) for v, t in zip(b, BLOCK.values(), strict=True))
            row, y = np.repeat(np.arange(len(sizes)), sizes), 2.0 * y - 1
            for m, margin in enumerate(_margins(coef, row, at, value, len(y))):
                f, g, h = loss(kind, y * margin)
                # A model of several leaves its own fold out.
                on = (fold != m) if folds > 1 else np.ones(len(y), bool)
                f, g, h = f * on, g * on * y, h * on
                total[m] += f.sum()
                slope[m] += np.r_[np.bincount(at, value * g[row], d - 1), g.sum()]
                bend[m] += np.r_[np.bincount(at, value**2 * h[row], d - 1), h.sum()]
        for m in range(k):
            use = np.flatnonzero((slope[m] != 0) | (bend[m] != 0))
            yield pa.record_batch(
                [pa.array(np.full(len(use) + 1, m), pa.int32()), pa.array(np.r_[use, -1], pa.int32()), pa.array(np.r_[slope[m][use], total[m]]), pa.array(np.r_[bend[m][use], 0.0])], ["model", "i", "slope", "bend"]
            )

    return run


class Descent:
    """L-BFGS for one model: ``point`` is what to evaluate next, ``tell`` takes the result."""

    def __init__(self, d: int, keep: int = 10, tolerance: float = 1e-5):
        self.x, self.f, self.g, self.point = np.zeros(d), np.inf, None, np.zeros(d)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.keep, self.tolerance, self.rate, self.done = keep, tolerance, 1.0, False

    def tell(self, f: float, g: np.ndarray, h: np.ndarray) -> None:
        if self.done:
            return
        if self.g is not None and f > self.f + 1e-4 * float(self.g @ (self.point - self.x)):
            self.rate /= 2
            self.done = self.rate < 1e-6
        else:
            if self.g is not None:
                s, y = self.point - self.x, g - self.g
                if s @ y > 1e-12 * (y @ y):
                    self.pairs = [*self.pairs[1 - self.keep :], (s, y)]
            self.x, self.f, self.g, self.h, self.rate = self.point, f, g, h, 1.0
            self.start = getattr(self, "start", None) or float(np.abs(g).max())
            self.done = float(np.abs(g).max()) <= self.tolerance * max(self.start, 1e-12)
            self.step = self._direction()
        self.point = self.x if self.done else self.x + self.rate * self.step

    def _direction(self) -> np.ndarray:
        q, back = self.g.copy(), []
        for s, y in reversed(self.pairs):
            a = (s @ q) / (s @ y)
            back.append(a)
            q -= a * y
        q = self._scaled(q)
        for (s, y), a in zip(self.pairs, reversed(back), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        return -q

    def _scaled(self, q: np.ndarray) -> np.ndarray:
        return q / self.h


class Bend:
    """Curvature of the losses as some rows show it: it only turns a step, loss and slope are those of all rows.

    ``row``, ``at`` and ``value`` are the entries of the rows that ``y`` (-1 or 1)
    has, ``scale`` is what a value is times by feature, ``weight`` that of all
    rows together; with ``on`` some rows count only.  Where entries stand for
    several features, ``up`` adds up their weights and ``down`` deals sums out.
    """

    def __init__(self, kind: str, row: np.ndarray, at: np.ndarray, value: np.ndarray, y: np.ndarray, scale: np.ndarray, ridge: np.ndarray, weight: float, on: np.ndarray | None = None, up=lambda v: v, down=lambda v: v):
        self.kind, self.row, self.at, self.value, self.y, self.scale, self.ridge = kind, row, at.astype(np.intp), value, y, scale, ridge
        self.up, self.down = up, down
        on = np.ones(len(y)) if on is None else on.astype(float)
        self.share, self.h = on * weight / max(on.sum(), 1.0), np.zeros(len(y))

    def margins(self, x: np.ndarray) -> np.ndarray:
        v = self.up(x * self.scale)
        return np.bincount(self.row, v[self.at] * self.value, len(self.y)) + v[-1]

    def move(self, x: np.ndarray) -> None:
        z = self.y * self.margins(x)
        # Rows near the hinge count in part: a step brings some of them in.
        bend = 2 / (1 + np.exp(np.clip((z - 1) / 0.4, -500, 500))) if self.kind == "svm" else loss(self.kind, z)[2]
        self.h = self.share * bend

    def times(self, p: np.ndarray) -> np.ndarray:
        s = self.h * self.margins(p)
        return self.ridge * p + self.scale * np.r_[self.down(np.bincount(self.at, self.value * s[self.row], len(p) - 1)), s.sum()]


class Turned(Descent):
    """Steps are scaled by a ``Bend``, which conjugate gradients solve for, themselves scaled by the diagonal of all rows.

    Few rows of a machine are within the hinge, so a part of that diagonal is
    mixed in.  A step begins as long as the last one ended, or twice as long.
    """

    def __init__(self, d: int, bend: Bend, steps: int = 30, near: float = 0.05):
        super().__init__(d)
        self.bend, self.steps, self.near = bend, steps, near
        self.part, self.missed = 0.2 if bend.kind == "svm" else 0.0, False

    def tell(self, f: float, g: np.ndarray, h: np.ndarray) -> None:
        x, rate = self.x, self.rate
        super().tell(f, g, h)
        taken = self.x is not x
        if taken and not self.done:
            self.rate = min(1.0, rate if self.missed else 2 * rate)
            self.point = self.x + self.rate * self.step
        self.missed = not taken

    def _direction(self) -> np.ndarray:
        self.bend.move(self.x)
        return super()._direction()

    def _scaled(self, q: np.ndarray) -> np.ndarray:
        if not self.bend.h.any():
            return q / self.h
        x, r = np.zeros(len(q)), q
        z = p = r / self.h
        rest = first = float(r @ z)
        for _ in range(self.steps):
            hp = (1 - self.part) * self.bend.times(p) + self.part * self.h * p
            bent = float(p @ hp)
            if rest <= self.near**2 * first or bent <= 0:
                break
            x, r = x + rest / bent * p, r - rest / bent * hp
            z = r / self.h
            rest, old = float(r @ z), rest
            p = z + rest / old * p
        return x


def total(parts: DataFrame, run, size: int) -> np.ndarray:
    """The sums of all tasks of ``run``: one row of ``size`` numbers comes from each."""
    found = parts.mapInArrow(run, "y binary").toArrow().column("y")
    return sum((np.frombuffer(v.as_buffer()) for v in found), np.zeros(size))


class Linear:
    """Fitted models over the same terms: coef is models x (features + 1), the intercept last."""

    def __init__(self, kind: str, coef: np.ndarray, terms: list[str], curves: list[tuple[float, float]] | None = None, passes: int = 0):
        self.kind, self.coef, self.terms, self.curves, self.passes = kind, coef, terms, curves, passes


def fit(rows: DataFrame, terms: DataFrame, kind: str = "svm", c: float = 1.0, folds: int = 1, passes: int = 200) -> Linear:
    """Models of ``vectors`` rows with label and fold: one, or one for each fold that it leaves out.

    svm: half the squared norm of the weights, the intercept among them, plus c
    times the squared hinge losses.  lr: c times the logistic losses, the
    intercept not in the norm.
    """
    spark, names = rows.sparkSession, [r["term"] for r in terms.orderBy("i").collect()]
    d = len(names) + 1
    ridge = np.ones(d)
    ridge[-1] = 1.0 if kind == "svm" else 0.0
    runs, n, data = [Descent(d) for _ in range(folds)], 0, blocks(rows)
    while n < passes and not all(r.done for r in runs):
        shared = spark.sparkContext.broadcast(np.stack([r.point for r in runs]))
        found = data.mapInArrow(_sums(kind, shared, folds), "model int, i int, slope double, bend double").groupBy("model", "i").agg(F.sum("slope").alias("slope"), F.sum("bend").alias("bend")).toArrow()
        model, at, slope, bend = (found.column(k).to_numpy() for k in ("model", "i", "slope", "bend"))
        for m, r in enumerate(runs):
            own = (model == m) & (at >= 0)
            g, h = ridge * r.point, np.maximum(ridge, 1e-6)
            g[at[own]] += c * slope[own]
            h[at[own]] += c * bend[own]
            r.tell(0.5 * float((ridge * r.point**2).sum()) + c * float(slope[(model == m) & (at < 0)].sum()), g, h)
        shared.unpersist()
        n += 1
    return Linear(kind, np.stack([r.x for r in runs]), names, passes=n)


def margins(rows: DataFrame, model: Linear, own_fold: bool = False) -> DataFrame:
    """doc_id, label, fold of ``rows`` and m, the margins by model; with ``own_fold`` only that of the model that left the row out."""
    shared = rows.sparkSession.sparkContext.broadcast(model.coef)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _margins(shared.value, *_rows(b.column("i"), b.column("w")), b.num_rows)
            if own_fold:
                m = m[b.column("fold").to_numpy(zero_copy_only=False), np.arange(b.num_rows)][None, :]
            yield pa.record_batch([b.column("doc_id"), b.column("label"), b.column("fold"), pa.array(m.T.tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "fold", "m"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "label", "fold", "i", "w").mapInArrow(run, f"doc_id {kind}, label int, fold int, m array<double>")


def sigmoids(scored: DataFrame, folds: int, steps: int = 60) -> list[tuple[float, float]]:
    """(a, b) for each fold of ``scored`` (fold, label, m): 1 / (1 + exp(a m + b)) fitted to targets drawn in by the classes' sizes, as Platt has them.

    Every step is one aggregate over all folds.
    """
    x = written(scored.select("fold", F.col("label").cast("double").alias("y"), F.col("m")[0].alias("m")), "margins")
    n = {r["fold"]: (r["p"], r["n"] - r["p"]) for r in x.groupBy("fold").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()}
    sizes = [n.get(f, (0.0, 0.0)) for f in range(folds)]
    high, low = ([*v] for v in zip(*[((p + 1) / (p + 2), 1 / (q + 2)) for p, q in sizes], strict=True))
    pick = lambda v: F.element_at(F.array(*[F.lit(float(z)) for z in v]), F.col("fold") + 1)
    t = F.when(F.col("y") > 0, pick(high)).otherwise(pick(low))
    state = [{"at": (0.0, float(np.log((q + 1) / (p + 1)))), "f": np.inf, "rate": 1.0, "done": False} for p, q in sizes]
    for s in state:
        s["try"] = s["at"]
    for _ in range(steps):
        if all(s["done"] for s in state):
            break
        a, b = pick([s["try"][0] for s in state]), pick([s["try"][1] for s in state])
        u = a * F.col("m") + b
        p = 1 / (1 + F.exp(u))
        gap, bend = t - p, p * (1 - p)
        # log(1 + exp(u)) without overflow.
        cost = t * u + F.greatest(-u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u)))
        sums = x.groupBy("fold").agg(*[F.sum(v).alias(k) for k, v in {"f": cost, "ga": gap * F.col("m"), "gb": gap, "haa": bend * F.col("m") ** 2, "hab": bend * F.col("m"), "hbb": bend}.items()])
        for r in sums.collect():
            s = state[r["fold"]]
            if s["done"]:
                continue
            if r["f"] > s["f"] + 1e-12 * abs(s["f"]):
                s["rate"] /= 2
                s["done"] = s["rate"] < 1e-8
            else:
                gain = s["f"] - r["f"]
                s |= {"at": s["try"], "f": r["f"], "rate": 1.0, "done": gain < 1e-10 * max(1.0, abs(r["f"]))}
                step = np.linalg.solve([[r["haa"] + 1e-12, r["hab"]], [r["hab"], r["hbb"] + 1e-12]], [r["ga"], r["gb"]])
                s["step"] = step
            s["try"] = tuple(float(v) for v in np.array(s["at"]) - s["rate"] * s["step"])
        for f, s in enumerate(state):
            s["done"] = s["done"] or sum(sizes[f]) == 0
    return [s["at"] for s in state]


def calibrated_svm(train: DataFrame, terms: DataFrame, c: float = 1.0, folds: int = 3) -> Linear:
    """A support vector machine for each fold it leaves out, each with a sigmoid fitted on that fold."""
    model = fit(train, terms, "svm", c, folds)
    model.curves = sigmoids(margins(train, model, own_fold=True), folds)
    return model


def scores(rows: DataFrame, model: Linear, system: str) -> DataFrame:
    """(doc_id, system, label, pred, proba): the mean of the models' probabilities of class 1."""
    curves = model.curves or [(-1.0, 0.0)] * len(model.coef)
    each = [1 / (1 + F.exp(F.lit(a) * F.col("m")[i] + F.lit(b))) for i, (a, b) in enumerate(curves)]
    p = sum(each[1:], each[0]) / len(each)
    return margins(rows, model).select("doc_id", F.lit(system).alias("system"), "label", (p >= 0.5).cast("int").alias("pred"), p.alias("proba"))


def feature_weights(model, spark) -> DataFrame:
    """(term, weight): what each term pushes towards class 1; the mean over the models of a calibration."""
    if not isinstance(model, Linear):
        raise TypeError(f"{type(model).__name__} is no linear model: it has no weight for each term")
    return spark.createDataFrame(list(zip(model.terms, model.coef[:, :-1].mean(0).tolist(), strict=True)), "term string, weight double")


def top_features(weights: DataFrame, top: int = 20) -> DataFrame:
    """(side, rank, term, weight): the terms that lean most to each class."""
    x = weights.withColumns({"up": F.row_number().over(Window.orderBy(F.desc("weight"), "term")), "down": F.row_number().over(Window.orderBy("weight", "term"))})  # one row a feature
    sides = F.explode(F.array(F.struct(F.lit("REAL").alias("side"), F.col("up").alias("rank")), F.struct(F.lit("FAKE").alias("side"), F.col("down").alias("rank")))).alias("s")
    y = x.select("term", "weight", sides).select("s.side", "s.rank", "term", F.round("weight", 6).alias("weight")).filter(F.col("rank") <= top)
    return y.filter(F.when(F.col("side") == "REAL", F.col("weight") > 0).otherwise(F.col("weight") < 0))

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear, models, nested
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"


def made(seed=0, n=90, d=12):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, d)) * (rng.random((n, d)) < 0.4), 3)
    y = (x @ rng.normal(size=d) + 0.4 * rng.normal(size=n) > 0).astype(int)
    return x, y, np.arange(n) % 3


def tables(spark, x, y, fold):
    weights = [(int(i), f"t{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    terms = linear.numbered(spark.createDataFrame([(f"t{j:02d}",) for j in range(x.shape[1])], "term string"))
    docs = spark.createDataFrame([(i, int(a), int(f)) for i, (a, f) in enumerate(zip(y, fold, strict=True))], "doc_id long, label int, fold int")
    weights = spark.createDataFrame(weights, "doc_id long, term string, weight double")
    return linear.vectors(weights, docs, terms).repartition(4), terms, weights


def dense(x, y, kind, c, steps=400):
    """Newton's method with halved steps on the whole matrix."""
    z, s = np.c_[x, np.ones(len(x))], 2.0 * y - 1
    ridge = np.r_[np.ones(x.shape[1]), 1.0 if kind == "svm" else 0.0]
    value = lambda w: 0.5 * (ridge * w * w).sum() + c * linear.loss(kind, s * (z @ w))[0].sum()
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        _, g, h = linear.loss(kind, s * (z @ w))
        step = np.linalg.solve(np.diag(ridge) + c * (z * h[:, None]).T @ z + 1e-12 * np.eye(len(w)), ridge * w + c * z.T @ (g * s))
        rate = 1.0
        while rate > 1e-10 and value(w - rate * step) > value(w):
            rate /= 2
        w = w - rate * step
    return w


@pytest.mark.parametrize(("kind", "c"), [("svm", 1.0), ("svm", 10.0), ("lr", 1.0)])
def test_fit_is_that_of_a_dense_solver(spark, kind, c):
    x, y, fold = made()
    rows, terms, _ = tables(spark, x, y, fold)
    model = linear.fit(rows, terms, kind, c)
    assert np.abs(model.coef[0] - dense(x, y, kind, c)).max() < 2e-3
    assert model.passes < 120


def test_calibrated_svm(spark):
    x, y, fold = made(1)
    rows, terms, weights = tables(spark, x, y, fold)
    model = linear.calibrated_svm(rows, terms)
    z, wanted = np.c_[x, np.ones(len(x))], np.zeros(len(x))
    for f in range(3):
        w = dense(x[fold != f], y[fold != f], "svm", 1.0)
        assert np.abs(model.coef[f] - w).max() < 2e-3
        m, t = z[fold == f] @ w, y[fold == f]
        target = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
        a, b = 0.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(a * m + b))
            g, h = np.array([((target - p) * m).sum(), (target - p).sum()]), p * (1 - p)
            step = np.linalg.solve([[(h * m * m).sum(), (h * m).sum()], [(h * m).sum(), h.sum()]], g)
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        wanted += 1 / (1 + np.exp(a * (z @ w) + b)) / 3
    found = {r.doc_id: (r.proba, r.pred) for r in linear.scores(rows, model, "svm").collect()}
    assert max(abs(found[i][0] - p) for i, p in enumerate(wanted)) < 5e-3
    assert all(pred == (p >= 0.5) for p, pred in found.values())
    # Contributions of the terms and the intercept make up the mean margin.
    coefs = linear.feature_weights(model, spark).select("term", F.lit(0.0).alias("lp0"), F.col("weight").alias("lp1"))
    sums = {r.doc_id: r.s for r in models.attribution(weights.withColumn("label", F.lit(1)), coefs, 99).groupBy("doc_id").agg(F.sum("contribution").alias("s")).collect()}
    for r in linear.margins(rows, model).collect():
        assert sums.get(r.doc_id, 0.0) + model.coef[:, -1].mean() == pytest.approx(np.mean(r.m), abs=1e-4)


def test_weights_of_other_models_are_an_error(spark):
    with pytest.raises(TypeError, match="no linear model"):
        linear.feature_weights(models.forest_pipeline(["a"]), spark)


def test_one_class_and_empty_rows(spark):
    x, _, fold = made(2, 12, 3)
    rows, terms, _ = tables(spark, x, np.ones(12, int), fold)
    model = linear.calibrated_svm(rows, terms)
    assert {r.pred for r in linear.scores(rows, model, "svm").collect()} == {1}
    assert linear.scores(rows.limit(0), model, "svm").count() == 0


def test_svm_query_labels(spark):
    row = catalogue.queries()["svm_eval"](spark, SF).first()
    test = catalogue.split(spark, SF).filter("split = 'test'").count()
    assert row.tp + row.fn + row.fp + row.tn == test and row.accuracy >= 0.6


# -- nested fits --------------------------------------------------------------


def test_candidates():
    grid = {"a": [1, 2, 3, 4], "b": [1, 2, 3], "c": [1, 2, 3, 4]}
    some, drawn = nested.candidates(grid, 40)
    assert drawn and len(some) == 40 and len({tuple(p.values()) for p in some}) == 40
    assert nested.candidates(grid, 40)[0] == some != nested.candidates(grid, 40, seed=1)[0]
    every, drawn = nested.candidates(grid, 48)
    assert not drawn and len(every) == 48 and all(p in every for p in some)


def test_drawn_search_is_part_of_the_whole(spark):
    terms = catalogue.eda.term_table(catalogue.corpus(spark, SF), True).withColumn("words", F.size(F.split("term", " ")))
    docs = catalogue._folds(spark, SF)
    grid = {"max_features": [20, 200], "ngrams": [1, 2], "min_df": [1, 2], "sublinear": [False, True], "alpha": [0.5, 1.0]}
    whole = {tuple(r) for r in nested.search(terms, docs, grid).collect()}
    some = {tuple(r) for r in nested.search(terms, docs, grid, most=7).collect()}
    assert len(whole) == 32 and len(some) == 7 and some <= whole
    points = {tuple(p.values()) for p in nested.candidates(grid, 7)[0]}
    assert {(r[1], r[2], r[3], r[4], r[5]) for r in some} == points


def test_growing_parts(spark):
    parts = [0.1, 0.5, 1.0]
    x = spark.range(20_000).select(nested.part_of("id", parts).alias("p")).groupBy("p").count().collect()
    assert {r.p: round(r["count"] / 20_000, 1) for r in x} == {0: 0.1, 1: 0.4, 2: 0.5}


@pytest.mark.parametrize("near", [4000, 15])
def test_ablation_fits_the_three_models_on_every_size(spark, monkeypatch, near):
    """Against dense solvers; before, naive Bayes alone was fitted.  Curvature of some documents gives the same models."""
    monkeypatch.setattr(nested, "NEAR", near)
    rng = np.random.default_rng(5)
    words = [f"w{i:02d}" for i in range(24)]
    label = rng.integers(0, 2, 150)
    lean = rng.normal(size=24)
    share = [q / q.sum() for q in (np.exp(-0.5 * lean), np.exp(0.5 * lean))]
    tokens = [[words[w] for w in rng.choice(24, rng.integers(0, 14), p=share[y])] for y in label]
    fold, inner = (rng.random(150) < 0.7).astype(int), np.arange(150) % 3
    kept = [[w for w in t if w != "w03"] for t in tokens]
    rows = [(i, int(y), int(f), int(n), k, t) for k, ts in enumerate((tokens, kept)) for i, (y, f, n, t) in enumerate(zip(label, fold, inner, ts, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id int, label int, fold int, inner int, kind int, tokens array<string>").repartition(3)
    found = {(r.view, r.model, r.max_features): r for r in nested.ablation(docs, ["raw", "stripped"], [3, 40]).collect()}
    assert set(found) == {(v, m, k) for v in ("raw", "stripped") for m in ("nb", "svm", "lr") for k in (3, 40)}
    train, test = fold == 1, fold == 0
    for view, ts in (("raw", tokens), ("stripped", kept)):
        bags = [[*t, *(f"{a} {b}" for a, b in zip(t, t[1:], strict=False))] for t in ts]
        terms = sorted({w for b in bags for w in b})
        x = np.array([[b.count(w) for w in terms] for b in bags], float)
        df, tf = (x[train] > 0).sum(0), x[train].sum(0)
        order = [i for i in sorted(range(len(terms)), key=lambda i: (-tf[i], terms[i])) if df[i] >= 2]
        for k in (3, 40):
            z = x[:, order[:k]] * (np.log((train.sum() + 1) / (df[order[:k]] + 1)) + 1)
            z /= np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-300)
            w = dense(z[train], label[train], "lr", 1.0)
            side = {"lr": np.c_[z, np.ones(150)] @ w >= 0}
            p = 0
            for f in range(3):
                w = dense(z[train & (inner != f)], label[train & (inner != f)], "svm", 1.0)
                m, t = np.c_[z, np.ones(150)] @ w, train & (inner == f)
                a, b = linear.sigmoids(spark.createDataFrame([(0, int(y), [float(v)]) for y, v in zip(label[t], m[t], strict=True)], "fold int, label int, m array<double>"), 1)[0]
                p = p + 1 / (1 + np.exp(a * m + b)) / 3
            side["svm"] = p >= 0.5
            for model, up in side.items():
                r, y = found[view, model, k], label[test] == 1
                assert r.n_features == min(k, len(order))
                assert r.accuracy == pytest.approx((up[test] == y).mean(), abs=1e-6)
                assert r.f1 == pytest.approx(2 * (up[test] & y).sum() / (up[test].sum() + y.sum()), abs=1e-6)

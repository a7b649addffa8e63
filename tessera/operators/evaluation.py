"""Evaluation on a long table (doc_id, system, label, pred, proba)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import holm, mcnemar, ratio
from tessera.operators import order


def _r(c: Column, name: str) -> Column:
    return F.round(c, 6).alias(name)


def confusion(scores: DataFrame) -> DataFrame:
    x = scores.groupBy("system").agg(*[F.count_if((F.col("label") == a) & (F.col("pred") == b)).cast("long").alias(k) for k, a, b in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))])
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    p, r, rf = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return x.select("system", "tp", "fn", "fp", "tn", _r(ratio(tp + tn, tp + fn + fp + tn), "accuracy"), _r(p, "precision"), _r(r, "recall"), _r(ratio(2 * tp, 2 * tp + fp + fn), "f1"), _r((r + rf) / 2, "balanced_accuracy"), _r(rf, "recall_fake"))


def corpus_drop(scores: DataFrame, corpus: str, home: str) -> DataFrame:
    """Accuracy and F1 for each value of ``corpus``, and what is lost against ``home``."""
    x = confusion(scores.withColumn("system", F.col(corpus))).select(F.col("system").alias("corpus"), (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("n"), "accuracy", "f1")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a corpus
    own = {c: F.max(F.when(F.col("corpus") == home, F.col(c))).over(every) for c in ("accuracy", "f1")}
    return x.select("corpus", "n", "accuracy", "f1", *[_r(v - F.col(c), f"{c}_drop") for c, v in own.items()])


def error_direction(scores: DataFrame) -> DataFrame:
    x = scores.groupBy("system").agg(F.count_if(F.expr("label = 0 and pred = 1")).cast("long").alias("false_real"), F.count_if(F.expr("label = 1 and pred = 0")).cast("long").alias("false_fake"), F.count_if(F.expr("label = 0")).alias("n0"), F.count_if(F.expr("label = 1")).alias("n1"))
    return x.select("system", "false_real", "false_fake", _r(ratio(F.col("false_real"), F.col("n0")), "false_real_rate"), _r(ratio(F.col("false_fake"), F.col("n1")), "false_fake_rate"))


def threshold_sweep(scores: DataFrame, low: int = 5, high: int = 95) -> DataFrame:
    """Precision, recall and F1 of class 1 at thresholds of whole percents.

    One scan counts rows by the highest threshold they reach; the rest is a
    running sum over at most 101 rows a system.
    """
    reach = F.least(F.floor(F.round(F.col("proba") * 100, 4)), F.lit(high)).cast("int")
    per = scores.groupBy("system", reach.alias("t")).agg(F.count_if(F.expr("label = 1")).alias("p"), F.count("*").alias("n"))
    total = per.groupBy("system").agg(F.sum("p").alias("all_p"))
    grid = total.select("system", "all_p", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("t"))
    sums = per.groupBy("system").agg(F.collect_list(F.struct("t", "p", "n")).alias("h"))
    x = grid.join(sums, "system")
    reached = F.filter("h", lambda s: s["t"] >= F.col("t"))
    x = x.withColumn("p", F.aggregate(F.transform(reached, lambda s: s["p"]), F.lit(0).cast("long"), lambda a, v: a + v))
    x = x.withColumn("n", F.aggregate(F.transform(reached, lambda s: s["n"]), F.lit(0).cast("long"), lambda a, v: a + v))
    pr, rc = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("p") / F.col("n")), ratio(F.col("p"), F.col("all_p"))
    return x.select("system", _r(F.col("t") / 100, "threshold"), _r(pr, "precision"), _r(rc, "recall"), _r(ratio(2 * F.col("p"), F.col("n") + F.col("all_p")), "f1"))


def _steps(scores: DataFrame) -> DataFrame:
    """One row per distinct score of a system: p and q of each class at it, tp and fp from the highest down to it, np and nq in all."""
    per = scores.groupBy("system", "proba").agg(F.count_if(F.expr("label = 1")).alias("p"), F.count_if(F.expr("label = 0")).alias("q"))
    x = order.running(per, "system", [F.desc("proba")], ["p", "q"])
    every = scores.groupBy("system").agg(F.count_if(F.expr("label = 1")).alias("np"), F.count_if(F.expr("label = 0")).alias("nq"))  # one row a system
    return x.join(F.broadcast(every), "system").withColumnsRenamed({"p_upto": "tp", "q_upto": "fp"})


def curve(scores: DataFrame) -> DataFrame:
    """ROC and PR points: one row per distinct score, from the highest."""
    x = _steps(scores)
    return x.select("system", "proba", ratio(F.col("fp"), F.col("nq")).alias("fpr"), ratio(F.col("tp"), F.col("np")).alias("tpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def areas(scores: DataFrame) -> DataFrame:
    """Area under the ROC curve, and average precision."""
    tp, fp, p, q = (F.col(c) for c in ("tp", "fp", "p", "q"))
    # The step before this one is what stands above it.
    wide, high = ratio(q, F.col("nq")), ratio(tp, F.col("np")) + ratio(tp - p, F.col("np"))
    return _steps(scores).groupBy("system").agg(_r(F.sum(wide * high / 2), "roc_auc"), _r(F.sum(ratio(p, F.col("np")) * ratio(tp, tp + fp)), "average_precision"))


def brier(scores: DataFrame) -> DataFrame:
    return scores.groupBy("system").agg(_r(F.avg((F.col("proba") - F.col("label")) * (F.col("proba") - F.col("label"))), "brier"))


def rates_by(scores: DataFrame, bucket: Column, labels: list[str]) -> DataFrame:
    """Errors by bucket; buckets without rows are kept, with a null rate."""
    per = scores.select("system", bucket.alias("bucket"), (F.col("label") != F.col("pred")).cast("int").alias("wrong")).groupBy("system", "bucket").agg(F.count("*").cast("long").alias("n"), F.sum("wrong").cast("long").alias("errors"))
    every = scores.select("system").distinct().select("system", F.explode(F.array(*[F.struct(F.lit(i).alias("bucket_ord"), F.lit(b).alias("bucket")) for i, b in enumerate(labels)])).alias("x")).select("system", "x.*")
    x = every.join(per, ["system", "bucket"], "left")
    return x.select("system", "bucket_ord", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("errors", F.lit(0)).cast("long").alias("errors"), _r(F.try_divide(F.col("errors").cast("double"), F.col("n")), "error_rate"))


def wide(scores: DataFrame) -> DataFrame:
    """One row a document: the sorted systems that are wrong on it."""
    return scores.groupBy("doc_id").agg(F.min("label").alias("label"), F.array_sort(F.collect_set(F.when(F.col("label") != F.col("pred"), F.col("system")))).alias("wrong"))


def model_overlap(scores: DataFrame) -> DataFrame:
    x = wide(scores).filter(F.size("wrong") > 0).groupBy(F.array_join("wrong", " + ").alias("systems")).agg(F.count("*").cast("long").alias("articles"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.withColumn("share", F.round(F.col("articles") / F.sum("articles").over(every), 6))


def agreement(scores: DataFrame, a: str, b: str) -> DataFrame:
    """The four cells of two systems on the same documents, and their rates."""
    x = wide(scores).select(F.array_contains("wrong", a).alias("wa"), F.array_contains("wrong", b).alias("wb")).agg(F.count("*").alias("n"), *[F.count_if(c).cast("long").alias(k) for k, c in (("both_right", ~F.col("wa") & ~F.col("wb")), ("only_a", ~F.col("wa") & F.col("wb")), ("only_b", F.col("wa") & ~F.col("wb")), ("both_wrong", F.col("wa") & F.col("wb")))])
    return x.select(F.lit(a).alias("a"), F.lit(b).alias("b"), "both_right", "only_a", "only_b", "both_wrong", _r(ratio(F.col("both_right") + F.col("both_wrong"), F.col("n")), "agree"))


def shared_and_unique(scores: DataFrame) -> DataFrame:
    """Errors of each system: in all, those that it makes alone, and those that all systems make."""
    k = scores.select("system").distinct().count()
    x = wide(scores).select(F.explode("wrong").alias("system"), F.size("wrong").alias("k"))
    return x.groupBy("system").agg(F.count("*").cast("long").alias("errors"), F.count_if(F.col("k") == 1).cast("long").alias("unique_errors"), F.count_if(F.col("k") == k).cast("long").alias("shared_by_all"))


def agreement_rates(scores: DataFrame, a: str, b: str) -> DataFrame:
    """The four cells of two systems and their agreement as shares of the documents."""
    x = agreement(scores, a, b)
    n = F.col("both_right") + F.col("only_a") + F.col("only_b") + F.col("both_wrong")
    return x.select("a", "b", *[_r(ratio(F.col(c), n), c) for c in ("both_right", "only_a", "only_b", "both_wrong")], "agree")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest F1 of each system, the lowest of equal ones."""
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("x")
    return sweep.groupBy("system").agg(best).select("system", (-F.col("x.t")).alias("threshold"), "x.f1")


def decide(scored: DataFrame, threshold: float = 0.5, few: int = 5, low: float = 0.7) -> DataFrame:
    """Verdicts from proba at a threshold, with warnings.

    ``scored`` has doc_id, proba, tokens (words left after cleaning) and matched
    (terms of the vocabulary).  Texts without words are UNUSABLE and have no
    probability; fewer than ``few`` matched terms, or a confidence below
    ``low``, are marked.
    """
    usable, p = F.col("tokens") > 0, F.col("proba")
    verdict = F.when(~usable, "UNUSABLE").when(p >= threshold, "REAL").otherwise("FAKE")
    return scored.select("doc_id", verdict.alias("verdict"), F.when(usable, p).alias("proba"), (F.col("matched") < few).alias("low_evidence"), F.when(usable, F.greatest(p, 1 - p) < low).alias("low_confidence"))


def mcnemar_counts(scores: DataFrame) -> DataFrame:
    """b, c and the corrected chi-square of every pair of systems."""
    w = scores.select("doc_id", "system", (F.col("label") == F.col("pred")).alias("ok"))
    x = w.alias("x").join(w.alias("y"), (F.col("x.doc_id") == F.col("y.doc_id")) & (F.col("x.system") < F.col("y.system")))
    y = x.groupBy(F.col("x.system").alias("a"), F.col("y.system").alias("b")).agg(F.count_if(F.col("x.ok") & ~F.col("y.ok")).cast("long").alias("only_a"), F.count_if(~F.col("x.ok") & F.col("y.ok")).cast("long").alias("only_b"))
    d = F.abs(F.col("only_a") - F.col("only_b")) - 1
    return y.withColumn("chi2", F.round(F.coalesce(F.try_divide((d * d).cast("double"), F.col("only_a") + F.col("only_b")), F.lit(0.0)), 6))


def top_errors(scores: DataFrame, top: int = 10) -> DataFrame:
    """The most confident errors of each system."""
    conf = F.greatest(F.col("proba"), 1 - F.col("proba"))
    w = Window.partitionBy("system").orderBy(F.desc("confidence"), "doc_id")
    x = scores.filter("label <> pred").withColumn("confidence", F.round(conf, 6)).withColumn("rank", F.row_number().over(w).cast("int"))
    return x.filter(F.col("rank") <= top).select("system", "rank", "doc_id", "label", "pred", "confidence")


def calibration(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Mean prediction and observed share by quantile bin; an edge belongs to the bin below it."""
    edges = order.quantiles(scores, "system", "proba", [i / bins for i in range(1, bins)]).select("system", F.transform("edges", lambda e: F.round(e, 9)).alias("edges"))  # one row a system
    x = scores.join(F.broadcast(edges), "system").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("proba"))))
    # Means are added up in billionths and rounded as whole numbers, so that they are alike in any order of the rows.
    y = x.groupBy("system", "bin").agg(F.count("*").cast("long").alias("n"), F.sum(F.round(F.col("proba") * 1e9).cast("long")).alias("s"), _r(F.avg("label"), "observed"))
    return y.select("system", "bin", "n", (F.expr("(2 * s + 1000 * n) div (2000 * n)") / 1e6).alias("mean_predicted"), "observed")


def bootstrap(scores: DataFrame, draws: int = 300, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Accuracy and F1 of each system with percentile intervals.

    Every system sees the same resample.  Documents with equal label and
    predictions are alike to all statistics, so a resample is one multinomial
    draw over these cells: the driver gets at most 2^(systems + 1) of them.
    """
    spark = scores.sparkSession
    per = scores.groupBy("doc_id").agg(F.first("label").alias("label"), F.array_sort(F.collect_list(F.struct("system", "pred"))).alias("preds"))
    cells = per.groupBy("label", "preds").agg(F.count("*").alias("n")).orderBy("label", "preds").collect()
    schema = "system string, accuracy double, accuracy_low double, accuracy_high double, f1 double, f1_low double, f1_high double"
    if not cells:
        return spark.createDataFrame([], schema)
    n, label = np.array([c["n"] for c in cells]), np.array([c["label"] for c in cells])
    resampled = np.vstack([n, np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), draws)])
    tail, rows = (1 - level) / 2, []
    for system in sorted({p["system"] for c in cells for p in c["preds"]}):
        pred = np.array([next((p["pred"] for p in c["preds"] if p["system"] == system), -1) for c in cells])
        hits = resampled @ (pred == label) / n.sum()
        both = resampled @ ((pred == 1) & (label == 1))
        size = resampled @ ((pred == 1).astype(int) + (label == 1))
        f1 = np.where(size > 0, 2 * both / np.maximum(size, 1), 0.0)
        rows.append((system, *(round(float(v), 6) for s in (hits, f1) for v in (s[0], *np.quantile(s[1:], (tail, 1 - tail))))))
    return spark.createDataFrame(rows, schema)


def any_wrong(scores: DataFrame) -> DataFrame:
    """doc_id, label, and whether any system is wrong on the document."""
    return wide(scores).select("doc_id", "label", (F.size("wrong") > 0).cast("int").alias("any_wrong"))


def marker_errors(wrong: DataFrame, markers: dict[str, str]) -> DataFrame:
    """Documents and errors by marker, class and presence; empty groups are kept, with a null rate."""
    keys = [(m, c, h) for m in markers for c in (0, 1) for h in (0, 1)]
    hits = wrong.select("label", "any_wrong", *[F.col("content").rlike(f"(?m){p}").cast("int").alias(f"m{i}") for i, p in enumerate(markers.values())])
    places = list(markers)
    sums = []
    for m, c, h in keys:
        here = (F.col("label") == c) & (F.col(f"m{places.index(m)}") == h)
        sums.append(F.struct(F.lit(m).alias("marker"), F.lit(c).alias("label"), F.lit(h).alias("present"), F.count_if(here).cast("long").alias("n"), F.count_if(here & (F.col("any_wrong") == 1)).cast("long").alias("errors")))
    x = hits.agg(F.array(*sums).alias("g")).select(F.explode("g").alias("g")).select("g.*")
    return x.withColumn("error_rate", F.round(F.try_divide(F.col("errors").cast("double"), F.col("n")), 6))


def marker_mismatch(scores: DataFrame, marker: str) -> DataFrame:
    """Where the errors fall: by system, those in the slice of class 0 with the marker and class 1 without.

    ``scores`` has content too.  ``concentration`` is the slice's share of the
    errors over its share of the documents; null for an empty slice.
    """
    odd = F.coalesce(F.col("content"), F.lit("")).rlike(marker) == (F.col("label") == 0)
    x = scores.select("system", odd.alias("odd"), (F.col("label") != F.col("pred")).alias("wrong"))
    y = x.groupBy("system").agg(F.count("*").alias("n"), F.count_if("odd").alias("k"), F.count_if("wrong").cast("long").alias("errors"), F.count_if(F.col("odd") & F.col("wrong")).cast("long").alias("in_slice"))
    share, base = F.col("in_slice") / F.greatest(F.col("errors"), F.lit(1)), F.col("k") / F.col("n")
    return y.select("system", "errors", "in_slice", _r(share, "share"), _r(base, "slice_share"), _r(F.try_divide(share, F.nullif(base, F.lit(0.0))), "concentration"))


def metric_drift(found: DataFrame, stored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Accuracies beside stored ones of the same systems: their distance, and whether it is within tolerance; the others are left out."""
    x = found.select("system", "accuracy").join(stored.select("system", F.col("accuracy").alias("stored")), "system")
    gap = F.abs(F.col("accuracy") - F.col("stored"))
    return x.filter("stored IS NOT NULL").select("system", "accuracy", "stored", gap.alias("drift"), (gap < tolerance).alias("same"))


def mcnemar_tests(scores: DataFrame) -> DataFrame:
    """Every pair of systems: counts, p-value, and Holm's p over the pairs; one row a pair comes to the driver."""
    rows = [(r["a"], r["b"], r["only_a"], r["only_b"], float(mcnemar(r["only_a"], r["only_b"])["p"])) for r in mcnemar_counts(scores).collect()]
    return holm(scores.sparkSession.createDataFrame(rows, "a string, b string, only_a long, only_b long, p double"), "p")

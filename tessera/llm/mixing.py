"""Mixing to target weights with soft membership of domains.

A classifier learned from a table of labelled documents gives every document a
posterior over domains; then nonnegative document rates are fitted whose
expected domain token totals match the targets:

    minimise  1/2 |sum_i w_i r_i p_i - t|^2 + ridge/2 sum_i w_i (r_i - 1)^2,  r >= 0

with w_i the document's share of all tokens, p_i its posterior and t the target
weights.  The classifier is a softmax regression on the presence of word stems
and marks of style, fitted on the labelled sample, so its posteriors add up to
the true numbers there.  Posteriors are kept to 1/1024; documents with equal
ones fall into one cell, and what has to be summed over all documents is summed
once, per cell, with partial sums before the shuffle.  Projected gradient steps
then run on the table of cells: each is one aggregate of a few numbers, scaled
by the inverse of the Hessian on the cells above zero (by the plain step 1/L
where that does not lower the objective).  A rate is a fold of its cell's
posterior over the steps taken, so it is a plain column of the document: no
join, no shuffle of texts, and no state to lose.

Only DataFrame and SQL functions touch the tables.  The coefficients, a few for
each stem, are fitted on the driver from the bounded sample.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, lowest, materialise

#: Posteriors are multiples of 1 / GRID.
GRID = 1024
#: Words stand for their first letters.
STEM = 5
#: Runs of ASCII marks.
_MARKS = r"[!-/:-@\[-^`{-~]{2,}"


def plain(text: str | Column) -> Column:
    """The text in lower case, empty for null."""
    return F.lower(F.coalesce(F.col(text).cast("string") if isinstance(text, str) else text, F.lit("")))


def words(text: str | Column) -> Column:
    """Lower-case words, cut at white space."""
    return F.filter(F.split(F.translate(plain(text), "\n\t\r\x0b\x0c", "     "), " "), lambda w: w != "")


def features(tokens: Column, text: Column) -> Column:
    """Distinct stems, and marks of style as words.

    The marks: the share of distinct stems, in tenths; the number of words, by
    powers of four; marks by word, by powers of two.
    """
    stems = F.array_distinct(F.transform(tokens, lambda w: F.substring(w, 1, STEM)))
    n = F.size(tokens)
    share = F.floor(F.size(stems) * 10 / F.greatest(n, F.lit(1)))
    length = F.floor(F.log2(n + F.lit(1)) / 2)
    marks = F.floor(F.log2(1 + 64 * F.regexp_count(text, F.lit(_MARKS)) / F.greatest(n, F.lit(1))))
    style = [F.concat(F.lit(f"\x01{k} "), v.cast("string")) for k, v in (("share", share), ("length", length), ("marks", marks))]
    return F.concat(stems, F.array(*style))


def softmax_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Weights (features and intercept, by domain) of a ridge softmax regression, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    (n, f), k = x.shape, y.shape[1]
    w, pull = np.zeros((f, k)), np.r_[np.full(f - 1, ridge), 1e-6]

    def look(w: np.ndarray) -> tuple[np.ndarray, float]:
        z = x @ w
        z -= z.max(1, keepdims=True)
        logs = z - np.log(np.exp(z).sum(1, keepdims=True))
        return np.exp(logs), float(-(y * logs).sum() + 0.5 * (pull[:, None] * w**2).sum())

    p, loss = look(w)
    for _ in range(steps):
        slope = x.T @ (p - y) + pull[:, None] * w
        hess = np.empty((k * f, k * f))
        for i in range(k):
            for j in range(i, k):
                part = x.T @ (x * (p[:, i] * ((i == j) - p[:, j]))[:, None]) + (np.diag(pull) if i == j else 0)
                hess[i * f : (i + 1) * f, j * f : (j + 1) * f] = hess[j * f : (j + 1) * f, i * f : (i + 1) * f] = part
        step, size = np.linalg.solve(hess, slope.T.ravel()).reshape(k, f).T, 1.0
        while size > 1e-4 and (found := look(w - size * step))[1] > loss:
            size /= 2
        before, w, (p, loss) = loss, w - size * step, found
        if before - loss < 1e-9 * max(1.0, abs(before)):
            break
    return w


class Classifier:
    """Softmax regression over the presence of a bounded list of terms."""

    def __init__(self, domains: list[str], start: list[float], terms: dict[str, list[float]]):
        self.domains, self.start, self.terms = domains, start, terms

    def posterior(self, found: Column) -> Column:
        """array<double>, one a domain, that sums to 1, from an array of features."""
        start = F.array(*[F.lit(float(p)) for p in self.start])
        if self.terms:
            table = F.create_map(*[x for t, w in self.terms.items() for x in (F.lit(t), F.array(*[F.lit(float(v)) for v in w]))])
            found = F.array_intersect(found, F.array(*[F.lit(t) for t in self.terms]))
            logs = F.aggregate(F.transform(found, lambda t: F.element_at(table, t)), start, lambda a, w: F.zip_with(a, w, lambda x, y: x + y))
        else:
            logs = start
        # Arrays of one bind a value: an expression inside a lambda is evaluated anew for every item.
        top = F.transform(F.array(logs), lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))
        total = F.transform(top, lambda a: F.transform(a, lambda x: F.round(x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y) * GRID)))
        return F.transform(total, lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y)))[0]


def fit(docs: DataFrame, labels: DataFrame, domain: Column, sample: int = 8000, n_terms: int = 512, lift: float = 1.5, ridge: float = 0.3, key: str = "doc_id", text: str = "text") -> Classifier:
    """Learn from up to ``sample`` labelled documents, the lowest by key's hash.

    ``domain`` is an expression over ``labels``; rows where it or the key is
    null are passed over, a key with several domains has the smallest, and one
    with several texts the smallest.  The terms are, for each domain, its share
    of ``n_terms``: those that tell most about domains among the stems at least
    ``lift`` times as frequent in it as overall and more so than in others; and
    all marks of style.  Ties go by term.  With no labelled documents there is
    one domain, "all".
    """
    marks = labels.select(F.col(key).cast("long").alias("_key"), domain.cast("string").alias("_domain")).dropna()
    marks = marks.groupBy("_key").agg(F.min("_domain").alias("_domain"))
    chosen = materialise(lowest(marks, F.xxhash64("_key"), sample, marks.count(), "_key"), "labelled")
    rows = docs.select(F.col(key).cast("long").alias("_key"), plain(text).alias("_text")).join(F.broadcast(chosen), "_key")
    rows = rows.groupBy("_key", "_domain").agg(F.min("_text").alias("_text"))
    rows = materialise(rows.select("_domain", features(words(F.col("_text")), F.col("_text")).alias("_terms")), "taught")
    size = {r["_domain"]: r["count"] for r in rows.groupBy("_domain").count().collect()}
    if not size:
        return Classifier(["all"], [0.0], {})
    domains, n = sorted(size), sum(size.values())
    if len(domains) == 1:
        return Classifier(domains, [0.0], {})
    seen = rows.select("_domain", F.explode("_terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), *[F.count_if(F.col("_domain") == d).alias(f"d{i}") for i, d in enumerate(domains)])
    seen = seen.filter(F.col("df").between(max(5, n // 1000), n - 1))
    # Terms that some domain is rich in; one that a domain only lacks is a common word of one language.
    lifts = F.array(*[F.col(f"d{i}") * n / (F.col("df") * size[d]) for i, d in enumerate(domains)])
    style = F.col("term").startswith("\x01")
    seen = seen.withColumn("lift", F.array_max(lifts)).withColumn("of", F.array_position(lifts, F.array_max(lifts))).filter((F.col("lift") >= lift) | style)
    gain = F.lit(0.0)
    for i, d in enumerate(domains):
        for k, of in ((F.col(f"d{i}"), F.col("df")), (F.lit(size[d]) - F.col(f"d{i}"), F.lit(n) - F.col("df"))):
            gain = gain + F.when(k > 0, k / n * F.log(k * n / (of * size[d]))).otherwise(0.0)
    rank = Window.partitionBy("of", style).orderBy(F.desc("gain"), "term")
    best = seen.withColumn("gain", gain).withColumn("rank", F.row_number().over(rank)).filter(style | (F.col("rank") <= max(1, n_terms // len(domains))))
    terms = [r["term"] for r in best.select("term").orderBy("term").collect()]
    if not terms:
        return Classifier(domains, [math.log(size[d] / n) for d in domains], {})
    place = {t: i for i, t in enumerate(terms)}
    taught = rows.select("_domain", F.array_intersect("_terms", F.array(*[F.lit(t) for t in terms])).alias("found")).collect()
    x, y = np.zeros((n, len(terms))), np.zeros((n, len(domains)))
    for i, r in enumerate(sorted(taught)):
        x[i, [place[t] for t in r["found"]]] = 1
        y[i, domains.index(r["_domain"])] = 1
    w = softmax_fit(x, y, ridge)
    return Classifier(domains, w[-1].tolist(), {t: w[i].tolist() for t, i in place.items()})


def _rate(p: Column, steps: list[list[float]], pull: list[float]) -> Column:
    """Rates of a posterior: 1, then every step in turn, each cut off at 0."""
    if not steps:
        return F.lit(1.0)
    moves = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in s]).alias("g"), F.lit(float(m)).alias("m")) for s, m in zip(steps, pull, strict=True)])

    def move(q: Column, r: Column, s: Column) -> Column:
        dot = F.aggregate(F.zip_with(q, s["g"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return F.greatest(F.lit(0.0), r - dot - s["m"] * (r - 1))

    # An array of one binds the posterior, which would be worked out again for every step.
    return F.transform(F.array(p), lambda q: F.aggregate(moves, F.lit(1.0), lambda r, s: move(q, r, s)))[0]


class Mix:
    """Fitted rates: the steps, and how near the totals came."""

    def __init__(self, steps, pull, totals, targets):
        self.steps, self.pull, self.totals, self.targets = steps, pull, totals, targets

    def rate(self, posterior: Column) -> Column:
        return _rate(posterior, self.steps, self.pull)


def fit_rates(cells: DataFrame, targets: list[float], ridge: float = 1e-3, steps: int = 24, tolerance: float = 1e-4) -> Mix:
    """Projected gradient on cells (p array<double>, tokens)."""
    d = len(targets)
    total = cells.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    t = np.array(targets, float)
    if not total:
        return Mix([], [], np.zeros(d), t)
    share = (F.col("tokens") / F.lit(float(total))).alias("w")

    def look(taken: list, pull: list) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected totals, Hessian on the cells above zero, spread of rates."""
        rows = cells.select("p", share, _rate(F.col("p"), taken, pull).alias("r"))
        up = F.when(F.col("r") > 0, F.col("w")).otherwise(0.0)
        sums = [F.sum(F.col("w") * F.col("r") * F.col("p")[i]) for i in range(d)]
        sums += [F.sum(up * F.col("p")[i] * F.col("p")[j]) for i in range(d) for j in range(d)]
        row = rows.agg(*sums, F.sum(F.col("w") * (F.col("r") - 1) ** 2)).first()
        return np.array(row[:d]), np.array(row[d:-1]).reshape(d, d), row[-1]

    def objective(totals: np.ndarray, spread: float) -> float:
        return 0.5 * float(((totals - t) ** 2).sum()) + 0.5 * ridge * spread

    taken: list[list[float]] = []
    pull: list[float] = []
    totals, hess, spread = look(taken, pull)
    value = objective(totals, spread)
    for _ in range(steps):
        slope = totals - t
        # The gradient scaled by (H + ridge)^-1 nearly solves the problem on the cells above zero; 1 / L is the plain step.
        lipschitz = np.linalg.norm(hess, 2) + ridge
        for g, m in ((np.linalg.solve(hess + ridge * np.eye(d), slope), 0.0), (slope / lipschitz, ridge / lipschitz)):
            found = look([*taken, g.tolist()], [*pull, m])
            if objective(found[0], found[2]) < value:
                break
        else:
            break
        taken.append(g.tolist())
        pull.append(m)
        before, (totals, hess, spread) = value, found
        value = objective(totals, spread)
        if before - value < tolerance * max(value, 1e-12):
            break
    return Mix(taken, pull, totals, t)


def mix(docs: DataFrame, classifier: Classifier, targets: dict[str, float], text: str = "text", ridge: float = 1e-3, prefix: str = "", keep_text: bool = True) -> tuple[DataFrame, Mix]:
    """``docs`` with columns tokens, posterior and rate (names after ``prefix``).

    ``targets`` are weights by domain; those of domains without labels are left
    out and the rest scaled to sum to 1; domains without a target have 0.
    Null and empty texts have 0 tokens and the posterior of a text without
    terms; texts of any length are read whole.  Every row has its own rate, a
    function of its text, so repeated rows agree.  An empty table gives an empty
    result.  Columns of ``docs`` with the three new names are replaced, all
    others are kept.  Without ``keep_text`` the texts are left out and read
    once: what is known of each row is written to the shared folder.
    """
    weights = np.array([max(0.0, targets.get(d, 0.0)) for d in classifier.domains])
    weights = weights / weights.sum() if weights.sum() > 0 else np.full(len(weights), 1 / len(weights))
    names = [f"{prefix}{k}" for k in ("tokens", "posterior", "rate")]
    lower, split = fresh(docs, "_lower", "_split")
    own = docs.withColumn(lower, plain(text)).withColumn(split, words(F.col(lower)))
    own = own.withColumns({names[0]: F.size(split).cast("long"), names[1]: classifier.posterior(features(F.col(split), F.col(lower)))}).drop(lower, split)
    if not keep_text:
        own = materialise(own.drop(text), "measured")
    cells = own.select(F.col(names[0]).alias("tokens"), F.col(names[1]).alias("p")).groupBy("p").agg(F.sum("tokens").alias("tokens"))
    fitted = fit_rates(materialise(cells, "cells"), weights.tolist(), ridge)
    return own.withColumn(names[2], fitted.rate(F.col(names[1]))), fitted


def resample(docs: DataFrame, rate: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole copies by rate: its floor, and one more with the rest's chance.

    The chance is decided by the hash of key and text, so the same rows come out
    again whenever a task is repeated, and of a key's different texts each has
    its own draw.  Rows whose key is null are told apart by their place in the
    partition as well, so that any number of them keeps the rate.
    """
    copy, place, draw = fresh(docs, "_copy", "_place", "_draw")
    rows = docs.withColumn(place, F.monotonically_increasing_id())
    drawn = F.when(F.col(key).isNull(), F.xxhash64(F.lit("copies"), text, place)).otherwise(F.xxhash64(F.lit("copies"), key, text))
    rows = rows.withColumn(draw, F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30)))
    chance = F.col(draw)
    # The number of copies stands once in the plan: a filter on it would work out the posterior a second time.
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(True), F.floor(F.col(rate) + chance).cast("int")))).drop(copy, rate, place, draw)

"""Statistics: column expressions, and closed forms on a few driver numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def verdict(value: Column, warn: float, fail: float) -> Column:
    """FAIL from ``fail`` on, WARN above ``warn``, else PASS."""
    return F.when(value >= fail, "FAIL").when(value > warn, "WARN").otherwise("PASS")


def worst(*statuses: Column) -> Column:
    """The gravest of several verdicts: FAIL, WARN, INFO, PASS."""
    ranks = F.array(F.lit("FAIL"), F.lit("WARN"), F.lit("INFO"), F.lit("PASS"))
    return F.element_at(ranks, F.array_min(F.array(*[F.array_position(ranks, s) for s in statuses])).cast("int"))


def js_distance(df: DataFrame, p: str, q: str) -> DataFrame:
    """Jensen-Shannon distance, base 2, of two columns of counts in a table of bounded size; null if one sums to 0."""
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a bounded table
    x = df.select(*[(F.col(c) / F.nullif(F.sum(c).over(every), F.lit(0))).alias(n) for n, c in (("p", p), ("q", q))])
    m = (F.col("p") + F.col("q")) / 2

    def part(c: Column) -> Column:
        return F.when(c > 0, c * F.log2(c / m)).otherwise(F.when(c.isNull(), None).otherwise(0.0))

    return x.agg((F.sum(part(F.col("p"))) / 2 + F.sum(part(F.col("q"))) / 2).alias("d")).select(F.when(F.col("d").isNotNull(), F.sqrt(F.greatest("d", F.lit(0.0)))).alias("js_distance"))


def ks_statistic(df: DataFrame, value: str, label: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic, over distinct values."""
    per = df.groupBy(value).agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b"))
    upto, every = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.abs(F.sum("a").over(upto) / F.nullif(F.sum("a").over(every), F.lit(0)) - F.sum("b").over(upto) / F.nullif(F.sum("b").over(every), F.lit(0)))
    return per.select(gap.alias("gap")).agg(F.max("gap").alias("ks_statistic"))


def holm(df: DataFrame, p: str) -> DataFrame:
    """``df`` with Holm's step-down p-values, as p_holm."""
    rank, n = Window.orderBy(p), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scaled = df.withColumn("_k", F.row_number().over(rank)).withColumn("_n", F.count("*").over(n)).withColumn("_s", (F.col("_n") - F.col("_k") + 1) * F.col(p))
    running = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return scaled.withColumn("p_holm", F.least(F.max("_s").over(running), F.lit(1.0))).drop("_k", "_n", "_s")


def chi2_sf(x: float) -> float:
    """Upper tail of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0.0) / 2))


def binomial_two_sided(b: int, c: int) -> float:
    """Exact two-sided p of b against c under a fair coin."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * math.fsum(map(math.exp, logs)))


def mcnemar(b: int, c: int, exact_max: int = 25) -> dict[str, float]:
    """Statistic with continuity correction, both p-values and the one to use."""
    n = b + c
    chi2 = (abs(b - c) - 1) ** 2 / n if n else 0.0
    exact, approx = binomial_two_sided(b, c), chi2_sf(chi2) if n else 1.0
    return {"b": b, "c": c, "chi2": chi2, "p_exact": exact, "p_chi2": approx, "p": exact if n <= exact_max else approx}


def ks_p(d: float, n: int, m: int) -> float:
    """Asymptotic p-value of the two-sample statistic."""
    x = math.sqrt(n * m / (n + m)) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * math.fsum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))

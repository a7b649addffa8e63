"""Order statistics of groups of any size: running sums and exact quantiles.

Rows are range-partitioned by group and order, so a group spreads over tasks.
Sums per group and partition, as many as there are partitions, are summed up
first and give each partition what stands before it; the rest is a running sum
within partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.kept import written


def running(df: DataFrame, group: str, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with x_upto for each x of ``sums``: its sum over the group's rows up to this one; rows that tie follow one another in any order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order]
    dealt = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_row", F.monotonically_increasing_id())
    x = written(dealt.withColumn("_part", F.shiftright("_row", 33)), "ordered")
    before = Window.partitionBy(group).orderBy("_part")
    totals = x.groupBy(group, "_part").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    ahead = totals.select(group, "_part", *[(F.sum(f"_{s}").over(before) - F.col(f"_{s}")).alias(f"_{s}") for s in sums])
    within = Window.partitionBy("_part", group).orderBy("_row")
    y = x.withColumns({f"{s}_upto": F.sum(s).over(within) for s in sums})
    # One row for each group and partition it is in: partitions and groups at most, one after another.
    y = y.join(F.broadcast(ahead), [group, "_part"])
    return y.withColumns({f"{s}_upto": F.col(f"{s}_upto") + F.col(f"_{s}") for s in sums}).drop("_row", "_part", *[f"_{s}" for s in sums])


def quantiles(df: DataFrame, group: str, value: str, shares: list[float]) -> DataFrame:
    """(group, edges): exact quantiles of the values that are not null, between two of them in proportion."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    x = running(counted, group, [F.col("v")], ["n"])
    totals = counted.groupBy(group).agg(F.sum("n").alias("rows"))
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("q"), (F.lit(float(s)) * (F.col("rows") - 1)).alias("place")) for i, s in enumerate(shares)])).alias("t")
    asked = totals.select(group, at).select(group, "t.q", "t.place")
    # A few rows a group.
    met = x.join(F.broadcast(asked), group).withColumn("from", F.col("n_upto") - F.col("n"))
    low, high = F.floor("place"), F.ceil("place")
    here = lambda i: (F.col("from") <= i) & (i < F.col("n_upto"))
    met = met.filter(here(low) | here(high)).groupBy(group, "q", "place").agg(F.max(F.when(here(low), F.col("v"))).alias("lo"), F.max(F.when(here(high), F.col("v"))).alias("hi"))
    edge = F.when(low == high, F.col("lo")).otherwise((high - F.col("place")) * F.col("lo") + (F.col("place") - low) * F.col("hi"))
    return met.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("q", edge.alias("e")))).alias("x")).select(group, F.col("x.e").alias("edges"))

"""Multidimensional clustered layout: rows in z-order, cut into files.

Every dimension is cut where the number of smaller rows passes an eighth of the
table, exactly.  The values and their counts are range-partitioned in order and
prefix-summed, first over the partitions and then within each; what the driver
learns is where the coordinates begin: at most eight values a dimension.

The rows are range-partitioned by (z, key), so a cell of any size is spread
over tasks.  Counts per z, prefix-summed, give each cell an interval of
positions, and counts per cell and partition place the partitions' stretches
in it.  A file is a stretch of positions, so a cell is an interval of files.

There are at most 8^4 = 4,096 cells and one query box for each.  ``files_matching``
joins each cell with its neighbours (nine at most) and merges their intervals of
files in order.  ``files_touched`` joins the boxes with the files' bounds.  A
file that lies in one cell has that cell as its bounds, and fewer files than
cells reach over the end of one, so there are fewer than 8,192 distinct bounds,
whatever the number of files.  These tables are bounded by the number of cells;
all that grows with the input stays in partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise

SIDES, DAYS, ROWS = 8, 365, 1000
DIMS = ("source", "lang", "length", "date")


def _numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in order, with ``_part`` ascending by range and ``_at``, the place within the part; written to the shared folder."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", row)
    return materialise(dealt.withColumn("_part", F.shiftright("_row", 33)).withColumn("_at", F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_row"), "ordered")


def _starts(base: DataFrame, n: int, sides: int) -> dict[str, list]:
    """By dimension, (coordinate, its smallest value) in order; a value is (is there, text, number)."""
    null = F.lit(None)
    value = {
        d: F.struct(F.lit(i).alias("dim"), F.col(d).isNotNull().alias("there"), (F.col(d) if i < 2 else null).cast("string").alias("text"), (F.col(d) if i > 1 else null).cast("long").alias("number"))
        for i, d in enumerate(DIMS)
    }
    counts = base.select(F.inline(F.array(*value.values()))).groupBy("dim", "there", "text", "number").agg(F.count("*").alias("n"))
    order = ["dim", "there", "text", "number"]
    counts = _numbered(counts, *order)
    # One number for each partition and dimension; partitions are a setting, not the input.
    ahead = counts.groupBy("dim", "_part").agg(F.sum("n").alias("n")).withColumn("ahead", F.sum("n").over(Window.partitionBy("dim").orderBy("_part")) - F.col("n")).drop("n")
    within = F.sum("n").over(Window.partitionBy("_part", "dim").orderBy("_at")) - F.col("n")
    smaller = counts.withColumn("within", within).join(F.broadcast(ahead), ["dim", "_part"]).withColumn("smaller", F.col("within") + F.col("ahead"))
    first = smaller.withColumn("side", F.expr(f"cast({sides} * smaller div {n} AS int)")).groupBy("dim", "side").agg(F.min(F.struct("there", "text", "number")).alias("v")).collect()
    return {d: sorted((r["side"], r["v"]) for r in first if r["dim"] == i) for i, d in enumerate(DIMS)}


def _side(d: str, starts: list) -> Column:
    """Coordinate of the value of ``d``: that of the last start which is not above it."""
    at = [(side, v["text"] if DIMS.index(d) < 2 else v["number"]) for side, v in starts]
    # Only the first start can be null, and it is below all values.
    reached = [F.lit(at[0][0])] + [F.when(F.col(d) >= F.lit(x), side) for side, x in at[1:]]
    return F.coalesce(*reached[::-1]).cast("int")


def interleave(sides: list[Column], bits: int) -> Column:
    """Binary digits of the coordinates, highest first, each round in order."""
    z = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in sides:
            z = F.shiftleft(z, 1).bitwiseOR(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1)))
    return z


def _near(*dims: str) -> Column:
    """Boxes around a cell: itself and its neighbours in the dimensions."""
    steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return reduce(lambda a, d: F.flatten(F.transform(a, lambda s: F.transform(steps, lambda k: s.withField(d, s[d] + k)))), dims, F.array(F.struct(*[F.col(c) for c in DIMS])))


def files_matching(cells: DataFrame) -> DataFrame:
    """(z, files_matching): distinct files of a cell and its neighbours; cells have z, coordinates, first_file, last_file."""
    asked = cells.select("z", F.inline(_near("length", "date")))
    met = asked.join(cells.select(*DIMS, "first_file", "last_file"), list(DIMS)).groupBy("z").agg(F.array_sort(F.collect_list(F.struct("first_file", "last_file"))).alias("spans"))
    # Spans in order: each adds its files beyond the last one seen.
    start = F.struct(F.lit(-1).cast("long").alias("seen"), F.lit(0).cast("long").alias("n"))
    merged = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct(F.greatest(a["seen"], s["last_file"]).alias("seen"), (a["n"] + F.greatest(F.lit(0).cast("long"), s["last_file"] - F.greatest(a["seen"] + 1, s["first_file"]) + 1)).alias("n")),
        lambda a: a["n"],
    )
    return met.select("z", merged.alias("files_matching"))


def files_touched(cells: DataFrame, files: DataFrame) -> DataFrame:
    """(z, files_touched): files whose bounds meet the box around each cell; files have lo_ and hi_ of each coordinate."""
    ends = [f"{e}_{d}" for d in DIMS for e in ("lo", "hi")]
    boxes = files.groupBy(*ends).agg(F.count("*").alias("n"))
    # Equal coordinates are a join key: a box stands once for each pair of theirs that it spans.
    for d in DIMS[:2]:
        boxes = boxes.withColumn(d, F.explode(F.sequence(f"lo_{d}", f"hi_{d}")))
    meet = [F.col("c.source") == F.col("b.source"), F.col("c.lang") == F.col("b.lang")]
    for d in DIMS[2:]:
        meet += [F.col(f"c.{d}") + 1 >= F.col(f"b.lo_{d}"), F.col(f"c.{d}") - 1 <= F.col(f"b.hi_{d}")]
    return cells.alias("c").join(boxes.alias("b"), reduce(Column.__and__, meet)).groupBy(F.col("c.z").alias("z")).agg(F.sum("b.n").alias("files_touched"))


def layout(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", sides: int = SIDES, rows: int = ROWS) -> DataFrame:
    """Per row: key, z, position, file, files_touched, files_matching, file_bounds.

    A null source or language, and the date of a null key, are smaller than any
    value; a null text has length -1, an empty one 0.  Texts of any length
    count by their bytes.  Rows with equal z and key, null keys among them, are
    placed in the order of a hash of their other values; equal rows are
    interchangeable and have a position each.  Other columns are not read.  An
    empty table gives an empty result.
    """
    bits = (sides - 1).bit_length()
    day = F.crc32(F.col(key).cast("long").cast("string").cast("binary")) % DAYS
    base = docs.select(
        F.col(key).cast("long").alias("key"),
        F.col(source).cast("string").alias("source"),
        F.col(lang).cast("string").alias("lang"),
        F.coalesce(F.octet_length(F.col(text).cast("string")).cast("long"), F.lit(-1).cast("long")).alias("length"),
        day.cast("long").alias("date"),
        F.xxhash64(F.col(text), F.col(source), F.col(lang)).alias("tie"),
    )
    base = materialise(base, "layout")
    n = base.count()
    starts = _starts(base, n, sides) if n else {d: [(0, {"text": None, "number": None})] for d in DIMS}
    placed = base.select("key", "tie", *[_side(d, starts[d]).alias(d) for d in DIMS])
    placed = placed.withColumn("z", interleave([F.col(d) for d in DIMS], bits))
    # Equal rows are told apart by where they stand, so that no number of them fills a task.
    placed = placed.withColumn("again", F.monotonically_increasing_id())
    placed = _numbered(placed, "z", F.col("key").asc_nulls_first(), "tie", "again").drop("tie", "again")
    # Cells: counts by z and partition, each at most (cells + partitions) rows.
    stretch = placed.groupBy("z", *DIMS, "_part").agg(F.count("*").alias("n"), F.min("_at").alias("begin"))
    stretch = materialise(stretch, "stretches")
    cells = stretch.groupBy("z", *DIMS).agg(F.sum("n").alias("n"))
    cells = cells.withColumn("start", F.sum("n").over(Window.orderBy("z")) - F.col("n"))
    cells = cells.withColumns({"first_file": F.floor(F.col("start") / rows), "last_file": F.floor((F.col("start") + F.col("n") - 1) / rows)})
    cells = materialise(cells, "cells")
    before = F.sum("n").over(Window.partitionBy("z").orderBy("_part")) - F.col("n")
    stretch = stretch.withColumn("before", before).join(F.broadcast(cells.select("z", "start")), "z").select("z", "_part", (F.col("start") + F.col("before") - F.col("begin")).alias("shift"))
    placed = placed.join(F.broadcast(stretch), ["z", "_part"]).withColumn("position", F.col("_at") + F.col("shift")).withColumn("file", F.expr(f"position div {rows}"))
    placed = materialise(placed.select("key", *DIMS, "z", "position", "file"), "placed")
    files = placed.groupBy("file").agg(*[f(d).alias(f"{e}_{d}") for d in DIMS for e, f in (("lo", F.min), ("hi", F.max))])
    files = materialise(files, "files")
    answers = materialise(files_touched(cells, files).join(files_matching(cells), "z"), "answers")
    bounds = F.concat_ws(",", *[F.col(f"{e}_{d}").cast("string") for d in DIMS for e in ("lo", "hi")])
    out = placed.select("key", "z", "position", "file").join(files.select("file", bounds.alias("file_bounds")), "file")
    out = out.join(F.broadcast(answers), "z")
    (name,) = fresh(out.drop("key"), key)
    return out.select(F.col("key").alias(name), "z", "position", "file", "files_touched", "files_matching", "file_bounds")

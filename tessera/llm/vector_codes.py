"""Vector code compression: product codes with exact integer distances.

Components become integers and vectors are cut into equal parts, each part with
its own codebook.  The nearest entry is found in two steps.  One float32 matrix
product gives ``|c|^2 - 2 x.c`` for all entries, with a bound on its rounding
error: a product of w terms, added in any order, is off by at most
``gamma(w) |x| |c|``, and turning integers into float32 and the last addition
add a few more roundings.  Every entry whose interval reaches down to the
smallest upper end stays, is evaluated again in int64, and the smallest
distance wins, ties by index.  So the codes are those of exact arithmetic,
whatever the order in which a matrix library adds.

A round of the codebooks is one pass: each task adds up what its vectors give
to each entry, in int64, and sends one table of ``parts x entries x (width + 1)``
numbers, however many vectors it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise
from .vectors import by_dim, matrix, usable

PARTS, ENTRIES, SCALE = 16, 64, 256.0
#: Components beyond this could overflow a distance in int64.
LARGEST = 1 << 27
#: Unit roundoff of float32.
_U = 2.0**-24
_BLOCK = 4096


def integers(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) as int64."""
    out = np.floor(scale * x)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale:g} are too large for exact distances in int64")
    return out.astype(np.int64)


def screen(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Which entries of ``book`` (entries x width) may be nearest to each row of ``x``, exactly evaluated or not.

    Both are int64.  True wherever float32 cannot rule an entry out.
    """
    width = x.shape[1]
    xf, cf = x.astype(np.float32), book.astype(np.float32)
    size_x, size_c = np.sqrt((x.astype(np.float64) ** 2).sum(1)), (book.astype(np.float64) ** 2).sum(1)
    found = (size_c.astype(np.float32)[None, :] - 2 * (xf @ cf.T)).astype(np.float64)
    # Two conversions, width products and sums, the square's conversion, the last sum; doubled for the roundings of this bound itself.
    gamma = (width + 4) * _U / (1 - (width + 4) * _U)
    slack = 2 * gamma * (2 * size_x[:, None] * np.sqrt(size_c)[None, :] + size_c[None, :])
    return found - slack <= (found + slack).min(1)[:, None]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry to each row, ties to the lower one, and the squared distance."""
    row, entry = np.nonzero(screen(x, book))
    exact = ((x[row] - book[entry]) ** 2).sum(1)
    # Rows are in order and every row has a candidate.
    start = np.searchsorted(row, np.arange(len(x)))
    best = np.minimum.reduceat(exact, start) if len(x) else exact
    hit = np.flatnonzero(exact == best[row])
    first = hit[np.searchsorted(row[hit], np.arange(len(x)))]
    return entry[first], best


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and distances (rows x parts); books: parts x entries x width."""
    parts, _, width = books.shape
    codes, errors = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64)
    for a in range(0, len(x), _BLOCK):
        for p in range(parts):
            codes[a : a + _BLOCK, p], errors[a : a + _BLOCK, p] = nearest(x[a : a + _BLOCK, p * width : (p + 1) * width], books[p])
    return codes, errors


def _sums(shared):
    """Per task: for each length of vectors, part and entry, the sums of the components and the count, laid out flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {d: np.zeros((*b.shape[:2], b.shape[2] + 1), np.int64) for d, b in shared.value.items()}
        for dim, batch in by_dim(batches, 0):
            books, total = shared.value[dim], totals[dim]
            x = matrix(batch.column(0), dim).astype(np.int64)
            codes, _ = encode(x, books)
            for p in range(len(books)):
                part = np.c_[x[:, p * books.shape[2] : (p + 1) * books.shape[2]], np.ones(len(x), np.int64)]
                np.add.at(total[p], codes[:, p], part)
        for d, t in totals.items():
            flat = t.ravel()
            some = np.flatnonzero(flat)
            yield pa.record_batch([pa.array(np.full(len(some), d), pa.int32()), pa.array(some, pa.int64()), pa.array(flat[some], pa.int64())], ["dim", "slot", "total"])

    return run


def _codes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch in by_dim(batches, 2):
            codes, errors = encode(matrix(batch.column(2), dim).astype(np.int64), shared.value[dim])
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(errors.sum(1))], ["key", "label", "code", "error"])

    return run


class Codebooks:
    """``books``: parts x entries x width, by length of the vectors."""

    def __init__(self, books: dict[int, np.ndarray]):
        self.books = books

    def sha256(self) -> str:
        """Digest of the components in decimal, by length, part, entry and position."""
        return hashlib.sha256(",".join(str(c) for d in sorted(self.books) for c in self.books[d].ravel().tolist()).encode()).hexdigest()

    def decode(self, code: str, dim: int) -> list[int]:
        """The integer vector that a code stands for."""
        book = self.books[dim]
        return [c for p in range(len(book)) for c in book[p, int(code[2 * p : 2 * p + 2], 16)].tolist()]


def _whole(scale: float):
    @F.arrow_udf("array<long>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), scale)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))

    return run


def kept(vectors: DataFrame, key: str, vector: str, label: str | None, parts: int = PARTS, scale: float = SCALE) -> DataFrame:
    """key, label, q (integers): rows whose vector is whole and cuts into ``parts``, written to the shared folder."""
    mark: Column = F.lit(None).cast("string") if label is None else F.col(label)
    rows = vectors.select(F.col(key).cast("long").alias("key"), mark.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(usable("v") & (F.size("v") > 0) & (F.size("v") % parts == 0))
    return materialise(rows.select("key", "label", _whole(scale)("v").alias("q")), "vectors")


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = 2) -> Codebooks:
    """Codebooks of ``kept`` rows: the vectors of the smallest keys, moved ``rounds`` times.

    The driver holds ``entries`` vectors of each length and the sums of each
    entry, never more.  A table has vectors of one length or of a few.
    """
    if entries > 256:
        raise ValueError("an index has two hex digits: at most 256 entries")
    spark, books = rows.sparkSession, {}
    for (dim,) in sorted(rows.select(F.size("q")).distinct().collect()):
        first = rows.filter(F.size("q") == dim).orderBy(F.col("key").asc_nulls_last(), "q").limit(entries).select("q").collect()
        start = np.array([r["q"] for r in first], np.int64)
        books[dim] = np.ascontiguousarray(start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2))
    for _ in range(rounds if books else 0):
        shared = spark.sparkContext.broadcast(books)
        found = rows.select("q").mapInArrow(_sums(shared), "dim int, slot long, total long").groupBy("dim", "slot").agg(F.sum("total").alias("total"))
        moved = {d: np.zeros(b.size // b.shape[2] * (b.shape[2] + 1), np.int64) for d, b in books.items()}
        for r in found.collect():
            moved[r["dim"]][r["slot"]] = r["total"]
        for d, old in books.items():
            sums = moved[d].reshape(*old.shape[:2], old.shape[2] + 1)
            n = sums[..., -1:]
            books[d] = np.where(n > 0, np.floor_divide(sums[..., :-1], np.maximum(n, 1)), old)
        shared.unpersist()
    return Codebooks(books)


def code_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = 2, scale: float = SCALE) -> DataFrame:
    """Per kept row: key, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty, of a length that ``parts`` does not
    divide, or holds a null or non-finite component are dropped.  Vectors of
    different lengths have codebooks of their own.  Null keys are coded, are the
    last to start a codebook and stay null; rows that repeat a key are rows
    each, and of equal keys the smaller vector starts first.  With fewer rows
    than entries the codebooks are shorter.  Null labels are one label.  Other
    columns are not read, an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, key, vector, label, parts, scale)
    books = fit(rows, parts, entries, rounds)
    kind = rows.schema["label"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(books.books)
    coded = rows.select("key", "label", "q").mapInArrow(_codes(shared), f"key long, label {kind}, code string, error long")
    coded = materialise(coded, "coded")
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    # Fewer than a thousand labels can have more than a thousandth of the rows each; those are broadcast, so no label fills a task.
    total = sums.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") > total / 1000
    hot, cold = (sums.filter(c).select(F.col("label").alias("_label"), F.col("label_error").alias(name)) for c, name in ((often, "hot"), (~often, "cold")))
    same = F.col("label").eqNullSafe(F.col("_label"))
    met = coded.join(F.broadcast(hot), same, "left").drop("_label")
    some = met.filter("hot is not null").select("key", "code", "error", F.col("hot").alias("label_error"))
    rest = met.filter("hot is null").join(cold, same).select("key", "code", "error", F.col("cold").alias("label_error"))
    (name,) = fresh(some.drop("key"), key)
    return some.unionByName(rest).select(F.col("key").alias(name), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

"""Terms of documents, counted where the documents are.

``totals`` adds up the terms of each batch of documents and ``bags`` looks them
up in a vocabulary, so what is shuffled are counts by term, never an entry of a
document.  A bag is a row a document: the numbers ``i`` of its terms in rising
order and how often each occurs (``n``) or what it weighs (``w``).  Sums by
document stay within the row, sums by term are added up in each task first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens that a task looks at together.
TOKENS = 1 << 20


def slices(batch: pa.RecordBatch, column: str, most: int = TOKENS) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` items of a list column; a single row is never cut."""
    ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    a = 0
    while a < batch.num_rows:
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def entries(tokens: pa.Array, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, term and count of every term of a list column, and the names of the terms; with ``pairs`` also of neighbours."""
    row = np.repeat(np.arange(len(tokens)), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    words = tokens.flatten().dictionary_encode()
    key, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    size = len(names)
    if not pairs:
        both, n = np.unique(row * max(size, 1) + key, return_counts=True)
        return both // max(size, 1), both % max(size, 1), n, names
    if len(key):
        near = np.flatnonzero(row[1:] == row[:-1])
        key, row = np.r_[key, size + key[near] * size + key[near + 1]], np.r_[row, row[near]]
    terms, code = np.unique(key, return_inverse=True)
    two = terms[terms >= size] - size
    if len(two):
        names = pa.concat_arrays([names, pc.binary_join_element_wise(names.take(pa.array(two // size)), names.take(pa.array(two % size)), " ")])
    size = max(len(terms), 1)
    both, n = np.unique(row * size + code, return_counts=True)
    return both // size, both % size, n, names


def totals(docs: DataFrame, tokens: Column, group: Column, pairs: bool) -> DataFrame:
    """(grp, term, tf, df) of the documents of each ``group`` (a small int), in parts: to be added up by group and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "tokens"):
                row, code, n, names = entries(b.column("tokens"), pairs)
                kind = b.column("grp").to_numpy(zero_copy_only=False).astype(np.int64)[row]
                size = max(len(names), 1)
                key, at = np.unique(kind * size + code, return_inverse=True)
                tf, df = np.bincount(at, n, len(key)).astype(np.int64), np.bincount(at, minlength=len(key))
                yield pa.record_batch([pa.array(key // size, pa.int32()), names.take(pa.array(key % size)), pa.array(tf), pa.array(df)], ["grp", "term", "tf", "df"])

    return docs.select(F.coalesce(group.cast("int"), F.lit(-1)).alias("grp"), tokens.alias("tokens")).mapInArrow(run, "grp int, term string, tf long, df long")


def bags(docs: DataFrame, keep: list[str], tokens: Column, terms: list[str], pairs: bool, idf: list[float] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with arrays i and n: places in ``terms`` of the document's terms that are there, and their counts.

    With ``idf`` w instead of n: the weights count * idf, each document of
    length 1.  Documents without any such term have empty arrays.
    """
    shared = docs.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scale = pa.array(shared.value[0], pa.string()), shared.value[1]
        scale = None if scale is None else np.array(scale)
        for batch in batches:
            for b in slices(batch, "_tokens"):
                row, code, n, names = entries(b.column("_tokens"), pairs)
                place = pc.index_in(names, known).fill_null(-1).to_numpy(zero_copy_only=False)[code] if len(code) else code
                on = place >= 0
                row, place, n = row[on], place[on], n[on]
                order = np.lexsort((place, row))
                row, place, n = row[order], place[order], n[order]
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))], pa.int32())
                if scale is None:
                    value = pa.array(n, pa.int32())
                else:
                    raw = n * scale[place]
                    value = pa.array(raw / np.sqrt(np.bincount(row, raw * raw, b.num_rows))[row], pa.float64())
                yield pa.record_batch([*[b.column(c) for c in keep], pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, value)], [*keep, "i", last])

    last = "n" if idf is None else "w"
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema], "i array<int>", f"{last} array<{'int' if idf is None else 'double'}>"])
    return docs.select(*keep, tokens.alias("_tokens")).mapInArrow(run, schema)

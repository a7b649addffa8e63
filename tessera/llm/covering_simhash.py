"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position has a vector in GF(2)^(r+1), none of them zero.  For each of
the 2^(r+1)-1 nonzero vectors v there is one table, whose mask keeps the bits
whose vector has odd product with v.  Any r positions leave some v orthogonal
to all of their vectors, so two fingerprints that differ in at most r bits are
equal under that mask: every pair within the radius meets in some table, for
certain.

Equal fingerprints are one vertex.  A bucket of up to ``cap`` fingerprints is
compared in one task, which returns spanning edges only.  The fingerprints of
larger buckets take an exact way without large groups: each is sent to itself
and its one-bit neighbours, where at most 65 can meet and all who meet are
within two bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import fresh, from_files, lower_words, materialise, slices
from .components import components, forest

RADIUS, SHINGLE, SEED = 2, 3, 42


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; no words: 0."""
    words = lower_words(text)
    if not words:
        return 0
    if len(words) < width:
        words = [b" ".join(words)]
        width = 1
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    digests = map(xxh64_intdigest, grams, repeat(SEED))
    for start in range(0, n, 32768):
        h = np.fromiter(digests, np.uint64, min(32768, n - start))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks: position i has the vector i % (2^(r+1)-1) + 1."""
    kinds = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % kinds + 1) & v).bit_count() & 1) for v in range(1, kinds + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", *more: Column) -> DataFrame:
    """(_key, fp, and ``more`` columns) per row: fp as a signed 64-bit integer, null texts are empty."""
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("text"), *more)
    names = ["_key", "fp", *rows.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for _, _, texts in slices(b.column(1)) for t in texts], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names)

    return rows.mapInArrow(run, ", ".join(["_key long, fp long", *(f"{n} {t}" for n, t in rows.dtypes[2:])]))


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the pairs within the radius, bucket by bucket."""
    for b in batches:
        out: list[tuple[int, int]] = []
        for own in b.column(0).to_pylist():
            fps = np.sort(np.array(own, np.int64))
            near = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= RADIUS
            x, y = np.nonzero(np.triu(near, 1))
            out += [(int(fps[r]), int(fps[v])) for r, v in forest(len(fps), x.tolist(), y.tolist())]
        yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])


def edges(distinct: DataFrame, cap: int = 128) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within the radius."""
    cells = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("cell")) for t, m in enumerate(masks())])).alias("c")).select("fp", "c.*")
    sizes = cells.groupBy("t", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    cells = materialise(cells.join(sizes, ["t", "cell"]), "cells")
    small = cells.filter(F.col("n") <= cap).groupBy("t", "cell").agg(F.collect_list("fp").alias("fps"))
    found = small.select("fps").mapInArrow(_bucket_edges, "a long, b long")
    # Members of large buckets meet at most 65 at a time, whatever the bucket's size.
    large = cells.filter(F.col("n") > cap).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    meet = large.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("at"))
    met = meet.groupBy("at").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")
    star = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    return found.unionByName(star.filter("a <> b"))


def _components(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp and other columns, a row a fingerprint) with top: its component's smallest fingerprint."""
    label = components(edges(distinct.select("fp")))
    return distinct.join(label, distinct.fp == label.node, "left").withColumn("top", F.coalesce("component", "fp")).drop("node", "component")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key in reach over links of at most two
    differing bits, the row's own included.  Null, empty and blank texts have
    fingerprint zero and link as any other.  Null keys are passed over when the
    smallest is taken; a component of null keys only has a null id.  Repeated
    rows share a fingerprint and so a component.  An empty table gives an empty
    result; other columns are not read.
    """
    fps = materialise(fingerprints(docs, key, text), "fingerprints")
    named = _components(materialise(fps.groupBy("fp").agg(F.min("_key").alias("rep")), "distinct"))
    least = named.groupBy("top").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "top").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 300_000) -> DataFrame:
    """One row of ``docs`` for each component, all columns kept.

    It is the row with the smallest key, null keys last; of several such rows
    the one with the smallest fingerprint, then the first by file and place.
    Rows are told apart by their file and place in it, so null, shared and
    repeated keys lose no component.  Columns of any name are kept as they are;
    an empty table gives an empty result.

    A table that is not just as a reader of files gives it is written to the
    shared folder first.  The kept rows are marked by
    one bit each, 64 rows to a word.  Up to ``most`` words, 60 MB or so, are
    broadcast and no text is moved; beyond it both
    sides meet by a sort-merge join on file and word.
    """
    if not from_files(docs):
        docs = materialise(docs, "documents")
    place = docs.metadataColumn("_metadata")
    fps = materialise(fingerprints(docs, key, text, place["file_path"].alias("file"), place["row_index"].alias("row")), "fingerprints")
    # The first row of each fingerprint, then of each component; both combine before they are sent.
    order = F.struct(F.col("_key").isNull().alias("none"), "_key", "fp", "file", "row")
    first = materialise(fps.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    kept = _components(first).groupBy("top").agg(F.min("first").alias("first")).select("first.file", "first.row")
    words = kept.groupBy("file", F.shiftright("row", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(row & 63 AS INT))")).alias("bits"))
    words = materialise(words, "kept")
    file, word, bits, own, row = fresh(docs, "_file", "_word", "_bits", "_own_file", "_row")
    marks = words.select(F.col("file").alias(file), F.col("word").alias(word), F.col("bits").alias(bits))
    marks = F.broadcast(marks) if words.count() <= most else marks.hint("merge")
    rows = docs.select("*", place["file_path"].alias(own), place["row_index"].alias(row))
    rows = rows.join(marks, (F.col(own) == F.col(file)) & (F.shiftright(row, 6) == F.col(word)))
    return rows.filter(F.expr(f"shiftright({bits}, CAST({row} & 63 AS INT)) & 1 = 1")).drop(file, word, bits, own, row)

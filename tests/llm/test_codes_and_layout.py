import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes, zorder_layout

NAN, INF = float("nan"), float("inf")


def brute_codes(rows, entries, rounds):
    """rows: (key, vector, label) as kept; plain integers throughout."""
    rows = sorted(((k, [int(np.floor(256 * x)) for x in v], c) for k, v, c in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // 16

    def cut(v):
        return [v[p * width : (p + 1) * width] for p in range(16)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), i) for i, entry in enumerate(book))

    books = [[cut(v)[p] for _, v, _ in rows[:entries]] for p in range(16)]
    for _ in range(rounds):
        for p in range(16):
            groups = defaultdict(list)
            for _, v, _ in rows:
                groups[near(cut(v)[p], books[p])[1]].append(cut(v)[p])
            books[p] = [[sum(col) // len(groups[i]) for col in zip(*groups[i], strict=True)] if i in groups else e for i, e in enumerate(books[p])]
    out = []
    for k, v, c in rows:
        best = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((k, "".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), c))
    errors = defaultdict(int)
    for _, _, e, c in out:
        errors[c] += e
    return [(k, code, e, errors[c]) for k, code, e, c in out], books


def test_vector_codes(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(150, 32)), 1).tolist()
    vectors[40:60] = [vectors[7]] * 20
    rows = [(i // 2 if i > 100 else i, v, None if i % 5 == 0 else i % 3, 1, 2.0) for i, v in enumerate(vectors)]
    rows += [(None, vectors[3], 1, 1, 2.0), (500, None, 1, 1, 2.0), (501, [], 1, 1, 2.0), (502, [1.0] * 31, 1, 1, 2.0), (503, [NAN] + [0.0] * 31, 1, 1, 2.0), (504, [None] + [0.0] * 31, None, 1, 2.0), (505, [-INF] + [0.0] * 31, 1, 1, 2.0)]
    rows.append((506, [-0.001] * 32, 7, 1, 2.0))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, error int, code double").repartition(5)
    own = [r[:3] for r in rows if r[1] and len(r[1]) == 32 and all(x is not None and np.isfinite(x) for x in r[1])]
    wanted, books = brute_codes(own, 24, 2)
    found = vector_codes.code_vectors(table, entries=24)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = [tuple(r) for r in found.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([r[:4] for r in got], key=order) == sorted(wanted, key=order)
    digest = vector_codes.Codebooks({32: np.array(books).reshape(16, 24, 2)}).sha256()
    assert {r[4] for r in got} == {digest}
    assert vector_codes.code_vectors(table.limit(0)).count() == 0


def test_vector_codes_of_two_lengths_and_many_labels(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16 if i % 3 else 48).tolist(), f"label {i}") for i in range(90)]
    found = {r.vec_id: tuple(r)[1:4] for r in vector_codes.code_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string"), entries=8).collect()}
    exact = [(k, np.float32(v).astype(float).tolist(), c) for k, v, c in rows]
    for kind in (lambda i: i % 3, lambda i: not i % 3):
        wanted, _ = brute_codes([r for r in exact if kind(r[0])], 8, 2)
        assert {k: v for k, *v in wanted} == {k: list(v) for k, v in found.items() if kind(k)}


@pytest.mark.parametrize("size", [1, 1000, 1 << 20, 1 << 26])
def test_screening_never_rules_out_the_nearest(size):
    rng = np.random.default_rng(size)
    x, book = rng.integers(-size, size + 1, (3000, 4)), rng.integers(-size, size + 1, (64, 4))
    # Entries that float32 cannot tell apart, and exact ties.
    book[33:40] = book[3] + rng.integers(-1, 2, (7, 4))
    book[50:] = book[:14]
    x[:500] = book[rng.integers(0, 64, 500)] + rng.integers(-2, 3, (500, 4))
    wanted = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(2)
    code, error = vector_codes.nearest(x, book)
    assert error.tolist() == wanted.min(1).tolist() and code.tolist() == [r.tolist().index(m) for r, m in zip(wanted, wanted.min(1), strict=True)]
    kept = vector_codes.screen(x, book).sum(1)
    assert kept.min() >= 1
    if size == 1000:
        assert kept.mean() < 4


def test_codes_decode(spark):
    rows = [(i, [float(i % 4)] * 16) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = vector_codes.kept(table, "vec_id", "embedding", None)
    books = vector_codes.fit(kept, entries=4)
    codes = vector_codes.code_vectors(table.withColumn("label", F.lit(1)), entries=4).collect()
    assert all(books.decode(r.code, 16) == [256 * (r.vec_id % 4)] * 16 and r.error == 0 for r in codes)


def test_too_large_components_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e30] * 16, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large for exact distances"):
        vector_codes.code_vectors(table).count()


def brute_layout(rows, size):
    """rows: (doc_id, source, lang, text)."""
    def key(v):
        return (v is not None, v)

    values = [
        (s if s is None else s.encode(), g if g is None else g.encode(), -1 if t is None else len(t.encode()), None if i is None else zlib.crc32(str(i).encode()) % 365)
        for i, s, g, t in rows
    ]
    n, sides = len(rows), []
    for d in range(4):
        column = sorted(key(v[d]) for v in values)
        first = {}
        for s, v in enumerate(column):
            first.setdefault(v, s)
        sides.append([8 * first[key(v[d])] // n for v in values])
    cells = list(zip(*sides, strict=True))
    z = [int("".join(str(c >> b & 1) for b in (2, 1, 0) for c in cell), 2) for cell in cells]
    order = sorted(range(n), key=lambda i: (z[i], key(rows[i][0])))
    file = {i: at // size for at, i in enumerate(order)}
    held = defaultdict(set)
    for i in range(n):
        held[file[i]].add(cells[i])
    bounds = {f: [(min(c[d] for c in own), max(c[d] for c in own)) for d in range(4)] for f, own in held.items()}
    out = []
    for at, i in enumerate(order):
        a, b, c, d = cells[i]
        box = [(a, a), (b, b), (c - 1, c + 1), (d - 1, d + 1)]
        touched = sum(all(lo <= y and hi >= x for (x, y), (lo, hi) in zip(box, own, strict=True)) for own in bounds.values())
        matching = sum(any(all(x <= v <= y for (x, y), v in zip(box, cell, strict=True)) for cell in own) for own in held.values())
        out.append((rows[i][0], z[i], at, file[i], touched, matching, ",".join(f"{x},{y}" for x, y in bounds[file[i]])))
    return out


def test_layout(spark):
    rng = np.random.default_rng(5)
    sources, langs = ["web", None, "", "Ünic", "a'b", "zz", "web", "web"], ["en", "en", "de", None]
    rows = [(int(i) if i % 7 else int(i) * 1000, sources[rng.integers(8)], langs[rng.integers(4)], None if i % 11 == 0 else "é" * int(rng.integers(0, 9) ** 2)) for i in range(1, 700)]
    rows.append((5000, "web", "en", "x" * 300_000))
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").withColumns({"z": F.lit(1), "file": F.lit("x"), "_part": F.lit(2), "length": F.lit(3)})
    for size in (1000, 20, 1):
        found = zorder_layout.layout(table, rows=size)
        assert found.columns == ["doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds"]
        assert sorted(map(tuple, found.collect())) == sorted(brute_layout(rows, size))
    assert zorder_layout.layout(table.limit(0)).count() == 0


def test_layout_of_null_and_repeated_keys(spark):
    rows = [(None, None, None, None)] * 30 + [(7, "s", "en", "same")] * 30 + [(None, "s", "en", "other"), (3, None, "de", "")]
    found = [tuple(r) for r in zorder_layout.layout(spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), rows=10).collect()]
    # Equal rows are interchangeable, so positions are compared as a whole and the rest by position.
    wanted = brute_layout(rows, 10)
    by = lambda r: r[2]
    assert sorted(found, key=by) == sorted(wanted, key=by)


def test_one_cell_takes_all_rows(spark):
    table = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit("t").alias("text"))
    found = zorder_layout.layout(table).groupBy("file").agg(F.min("position"), F.max("position"), F.countDistinct("position"))
    assert sorted(map(tuple, found.collect())) == [(0, 0, 999, 1000), (1, 1000, 1999, 1000), (2, 2000, 2499, 500)]

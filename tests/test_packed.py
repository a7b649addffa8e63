import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import linear, nested, packed
from tessera.plans import catalogue, kept

SF = "/root/testdata/sf0.001"
DOCS = [(1, 0, ["b", "a", "b", "a", "b"]), (2, 1, []), (3, None, ["a"]), (4, 1, ["c", "a", "b"]), (5, 0, ["c"])]


def terms_of(tokens, pairs):
    return Counter([*tokens, *([f"{x} {y}" for x, y in zip(tokens, tokens[1:], strict=False)] if pairs else [])])


@pytest.mark.parametrize("pairs", [False, True])
def test_totals_and_bags_are_plain_counts(spark, pairs):
    docs = spark.createDataFrame(DOCS, "doc_id int, label int, tokens array<string>").repartition(3)
    found = Counter()
    for r in packed.totals(docs, F.col("tokens"), F.col("label"), pairs).collect():
        found[(r.grp, r.term, "tf")] += r.tf
        found[(r.grp, r.term, "df")] += r.df
    wanted = Counter()
    for _, label, tokens in DOCS:
        for t, n in terms_of(tokens, pairs).items():
            wanted[(-1 if label is None else label, t, "tf")] += n
            wanted[(-1 if label is None else label, t, "df")] += 1
    assert found == wanted
    terms = ["a", "a b", "b", "b a"]
    rows = {r.doc_id: r for r in packed.bags(docs, ["doc_id"], F.col("tokens"), terms, pairs).collect()}
    for key, _, tokens in DOCS:
        have = terms_of(tokens, pairs)
        assert dict(zip(rows[key].i, rows[key].n, strict=True)) == {j: have[t] for j, t in enumerate(terms) if have[t]}
        assert rows[key].i == sorted(rows[key].i)
    idf = [1.0, 2.0, 3.0, 4.0]
    for r in packed.bags(docs, ["doc_id"], F.col("tokens"), terms, pairs, idf).collect():
        raw = [n * idf[j] for j, n in zip(rows[r.doc_id].i, rows[r.doc_id].n, strict=True)]
        assert r.w == pytest.approx([v / sum(x * x for x in raw) ** 0.5 for v in raw])


def test_slices_keep_rows_whole():
    batch = pa.record_batch([pa.array([["a"] * 5, [], ["b"] * 9, ["c"], None, ["d"] * 2])], ["t"])
    parts = [b.column("t").to_pylist() for b in packed.slices(batch, "t", 4)]
    assert sum(parts, []) == batch.column("t").to_pylist() and len(parts) > 2


def moved(spark, run):
    """Exchanges of rows that the plan of what ``run`` gives has, kept tables apart."""
    run().collect()
    plan = run()._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "SortMergeJoin" in line]


def test_weights_and_coverage_move_no_entries(spark):
    kept.forget()
    assert not moved(spark, lambda: catalogue.tfidf_weights(spark, SF))
    assert not moved(spark, lambda: catalogue.coverage(spark, SF))


def test_views_share_one_bag_a_document(spark, monkeypatch):
    """12 views of a search write and read one row a document; before, each view had its own rows of every term."""
    words = "red green blue cat dog house tree".split()
    docs = [(i, i % 2, i % 3, [words[(i * i + j * (1 + i % 2)) % 7] for j in range(4 + i % 5)]) for i in range(60)]
    seen = []
    real = nested.written
    monkeypatch.setattr(nested, "written", lambda df, name: seen.append(real(df, name)) or seen[-1])
    grid = {"max_features": [3, 9], "ngrams": [1, 2], "min_df": [2, 5], "sublinear": [False, True], "alpha": [0.1, 1.0]}
    table = spark.createDataFrame(docs, "doc_id int, label int, fold int, tokens array<string>").repartition(3)
    found = {tuple(r)[1:6]: r.cv_f1 for r in nested.search_tokens(table, grid).collect()}
    assert len(seen) == 1 and seen[0].count() == len(docs)
    for (k, g, d, s, a), f1 in found.items():
        assert f1 == pytest.approx(plain_f1(docs, k, g == 2, d, s, a), abs=2e-6)
    assert len(found) == 32


def plain_f1(docs, size, pairs, min_df, sublinear, alpha):
    got = []
    for held in range(3):
        bags = [(y, f == held, terms_of(t, pairs)) for _, y, f, t in docs]
        train = [(y, b) for y, out, b in bags if not out]
        tf, df = sum((b for _, b in train), Counter()), Counter(t for _, b in train for t in b)
        vocab = sorted((t for t in tf if df[t] >= min_df), key=lambda t: (-tf[t], t))[:size]
        idf = {t: math.log((len(train) + 1) / (df[t] + 1)) + 1 for t in vocab}

        def weigh(b, idf=idf):
            raw = {t: (math.log(n) + 1 if sublinear else n) * idf[t] for t, n in b.items() if t in idf}
            norm = math.sqrt(sum(v * v for v in raw.values())) or 1.0
            return {t: v / norm for t, v in raw.items()}

        sums = [dict.fromkeys(vocab, alpha) for _ in range(2)]
        for y, b in train:
            for t, w in weigh(b).items():
                sums[y][t] += w
        total = [sum(c.values()) for c in sums]
        prior = math.log(sum(y for y, _ in train)) - math.log(sum(1 - y for y, _ in train))
        hits = Counter()
        for y, out, b in bags:
            if out:
                z = prior + sum(w * (math.log(sums[1][t] / total[1]) - math.log(sums[0][t] / total[0])) for t, w in weigh(b).items())
                hits[y, z >= 0] += 1
        both = 2 * hits[1, True]
        got.append(both / (both + hits[0, True] + hits[1, False]) if both else 0.0)
    return sum(got) / 3


def test_logistic_regression_reads_bags(spark, monkeypatch):
    """Before, every step of the fit read the texts' token arrays by way of pyspark.ml."""
    monkeypatch.setattr("pyspark.ml.Pipeline.fit", None)
    row = catalogue.queries()["lr_eval"](spark, SF).first()
    test = catalogue.split(spark, SF).filter("split = 'test'").count()
    assert row.tp + row.fn + row.fp + row.tn == test


def test_passes_read_blocks(spark):
    """Before, each pass of a fit turned every row's lists into Arrow again."""
    rows = spark.createDataFrame([([0, 2], [0.5, 1.5], 1, 0), ([], [], 0, 1), ([1], [2.0], 1, 2)], "i array<int>, w array<double>, label int, fold int").coalesce(1)
    (b,) = linear.blocks(rows).collect()
    found = {k: np.frombuffer(b[k], t).tolist() for k, t in linear.BLOCK.items()}
    assert found == {"sizes": [2, 0, 1], "i": [0, 2, 1], "w": [0.5, 1.5, 2.0], "label": [1, 0, 1], "fold": [0, 1, 2]}

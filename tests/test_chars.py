import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chars, models
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
ODD = ["a", "", "  a  bb\tccc\x0bdddd\n", "naïve \U0001f600\U0001f600 x y", None, "ab" * 40, "a a a bb"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(rows)], "doc_id long, content string, label int").repartition(3)


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
@pytest.mark.parametrize("far", [0, 10**6])
def test_cells(most, far):
    """Any size of run, n-grams side by side or far apart."""
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 30 * 20, 150))
    row, word, n = key // 20, key % 20, rng.integers(1, 4, len(key))
    sizes, x = rng.integers(0, 6, 20), np.zeros((30, 9))
    gram = rng.integers(0, 9, sizes.sum())
    of = np.repeat(np.arange(20), sizes)
    for r, w, times in zip(row, word, n, strict=True):
        np.add.at(x[r], gram[of == w], times)
    found = [c for run in chars.cells(row, word, n, sizes, gram + far, most) for c in zip(*run, strict=True)]
    assert sorted(found) == [(r, g + far, x[r, g]) for r, g in zip(*np.nonzero(x), strict=True)]


def test_counts_are_those_of_the_listed_ngrams(spark):
    docs = table(spark, ODD * 2)
    each = docs.select("doc_id", F.explode(text.char_ngrams(F.col("content"), most=1 << 30)).alias("term"))
    wanted = {r.term: (r.tf, r.df) for r in each.groupBy("term").agg(F.count("*").alias("tf"), F.countDistinct("doc_id").alias("df")).collect()}
    found = chars.vocabulary(docs, 1 << 20).collect()
    assert {r.term: (r.tf, r.df) for r in found} == wanted and [r.i for r in sorted(found, key=lambda r: r.term)] == list(range(len(wanted)))
    first = chars.vocabulary(docs, 7).collect()
    assert {r.term for r in first} == set(sorted(wanted, key=lambda t: (-wanted[t][0], t))[:7])


def test_is_the_model_over_token_arrays(spark):
    docs = table(spark, [r.content for r in catalogue._parts_of(spark, SF).orderBy("doc_id").select(F.substring("content", 1, 150).alias("content")).limit(40).collect()] + ODD)
    train, test = docs.filter("doc_id % 4 > 0"), docs.filter("doc_id % 4 = 0")
    model = chars.fit(train, 1 << 20)
    found = {r.doc_id: r for r in chars.scores(test, model).collect()}
    tokens = F.coalesce(text.char_ngrams(F.col("content"), most=1 << 30), F.array().cast("array<string>"))
    plain = models.linear_pipeline("lr", 1 << 18, n=train.count())
    wanted = {r.doc_id: r for r in models.ml_scores(train.withColumn("tokens", tokens), test.withColumn("tokens", tokens), plain, "lr").collect()}
    assert found.keys() == wanted.keys() and found
    assert max(abs(found[k].proba - wanted[k].proba) for k in wanted) < 2e-3
    assert all(found[k].label == wanted[k].label and found[k].pred == (found[k].proba > 0.5) for k in wanted)
    assert model.passes < 200


def test_a_block_has_the_ngrams_of_a_word_once(spark):
    """A hundred documents of the same words: entries by word grow, n-grams do not."""
    words = [f"word{i}" for i in range(50)]
    size = {n: {k: len(v) for k, v in chars._block(pa.array([words] * n), pa.array([" wo", "wor"]), np.ones(2))[0].items()} for n in (1, 100)}
    assert size[1]["gram"] == size[100]["gram"] == 100 and size[100]["word"] == 100 * size[1]["word"]


@pytest.mark.parametrize("rows", [[], [None, ""], ["abc abc", "xyz abc"]])
def test_few_documents(spark, rows):
    model = chars.fit(table(spark, rows), 100)
    assert np.isfinite(model.coef).all() and len(model.coef) == len(model.terms) + 1
    assert chars.scores(table(spark, rows), model).count() == len(rows)


def test_query_forms_no_arrays_of_ngrams(spark, monkeypatch):
    monkeypatch.setattr(text, "char_ngrams", None)
    monkeypatch.setattr(models, "ml_scores", None)
    (row,) = catalogue.queries()["char_lr_eval"](spark, SF).collect()
    test = catalogue._parts_of(spark, SF).filter("split = 'test'").count()
    assert row.system == "lr" and row.tp + row.fp + row.fn + row.tn == test


def test_few_passes_whatever_curvature_is_seen(spark, monkeypatch):
    """15 passes before; that of some documents turns the steps, the weights at the end are those of all."""
    train = catalogue._parts_of(spark, SF).filter("split = 'train'")
    model = chars.fit(train, 30_000)
    assert model.passes <= 10
    monkeypatch.setattr(chars, "NEAR", 9)
    other = chars.fit(train, 30_000)
    assert other.terms == model.terms and np.abs(other.coef - model.coef).max() < 1e-3


def test_ngrams_of_odd_words():
    words = ["a", "", "bb", "ccc", "naïve", "\U0001f600\U0001f600", "x\x00y", "\x00", None, "ab" * 40]
    sizes, gram, names = chars.grams(pa.array(words))
    names, ends = names.to_pylist(), np.cumsum(sizes)
    for w, a, b in zip(words, ends - sizes, ends, strict=True):
        p = f" {w} "
        wanted = [p[k : k + n] for n in (3, 4, 5) for k in range(max(len(p) - n + 1, 1))] if w else []
        assert sorted(names[g] for g in gram[a:b]) == sorted(wanted)


def test_the_longest_ngrams_stand_for_all():
    """A third of what a pass read before; sums both ways are those of all n-grams, also where shorter ones are not known."""
    rng = np.random.default_rng(4)
    words = pa.array([["a", "abc", "ab", "abcab", "cabba"], ["ab", "ab", "a", "bcaab"], ["", "x"], None])
    every = sorted(chars.grams(words.flatten())[2].to_pylist())
    for terms in (every, [t for t in every if rng.random() < 0.6]):
        known, idf, w = pa.array(terms), rng.random(len(terms)) + 1, rng.normal(size=len(terms) + 1)
        (all_of, square), (some, same) = chars._block(words, known, idf), chars._block(words, known, idf, True)
        assert len(some["gram"]) < len(all_of["gram"]) and np.array_equal(square, same)
        stand = chars.Prefixes(terms)
        assert np.allclose(chars._margins(some, stand.up(w))[0], chars._margins(all_of, w)[0])
        sums = [np.bincount(b["gram"], np.repeat(np.bincount(b["word"], b["n"], len(b["sizes"])), b["sizes"]), len(terms)) for b in (all_of, some)]
        assert np.allclose(stand.down(sums[1]), sums[0])

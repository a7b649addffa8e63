from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, subsequence_svm as svm
from tessera.llm.common import fold

INSULTS = ("blockhead", "nitwit", "scoundrel", "dimbulb")
CLEAN = "the quick report on weather and trade was sent to every town by the old clerk who knew them all well".split()


def made(rng, n, share=0.3):
    """Texts of common words; toxic ones hold one or two insults somewhere."""
    texts, toxic = [], []
    for _ in range(n):
        words = rng.choice(CLEAN, rng.integers(3, 60)).tolist()
        bad = rng.random() < share
        for _ in range(int(bad) * rng.integers(1, 3)):
            words.insert(rng.integers(0, len(words) + 1), str(rng.choice(INSULTS)))
        text = "".join(w + (". " if rng.random() < 0.1 else " ") for w in words)
        texts.append(text.capitalize())
        toxic.append(bad)
    return texts, np.array(toxic, bool)


@pytest.fixture(scope="module")
def model():
    texts, toxic = made(np.random.default_rng(0), 400)
    return svm.learn(texts, toxic, 0.3)


def brute_features(text, alphabet):
    """Weights of all subsequences of three, from the definition."""
    c = [int(alphabet.table[ord(x)]) for x in text]
    out = {}
    for i, j, k in combinations(range(len(c)), 3):
        if k - i < svm.SPAN:
            weight = np.prod([svm.DECAY if c[m] > svm.SIGN else svm.EASY for m in range(i + 1, k) if m != j])
            out.setdefault(i, {}).setdefault((c[i], c[j], c[k]), 0.0)
            out[i][c[i], c[j], c[k]] += weight
    return out


def test_kernel_by_brute_force():
    alphabet = svm.Alphabet(["abcdé ab ab"])
    words = [" abca", " é.b-cd", " dcba"]
    columns, z = svm.features(words, alphabet)
    for w, row in zip(words, z, strict=True):
        own = {}
        for per in brute_features(w, alphabet).values():
            for t, v in per.items():
                own[t] = own.get(t, 0) + v
        norm = np.sqrt(sum(v * v for v in own.values()))
        n = alphabet.size
        wanted = {(x * n + y) * n + q: v / norm for (x, y, q), v in own.items()}
        assert {int(c): v for c, v in zip(columns, row, strict=True) if v} == pytest.approx(wanted)


def test_windows_by_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    alphabet = svm.Alphabet(["abcdefg"])
    n = alphabet.size
    table = np.zeros((n, n, n), np.float32)
    table[1:, 1:, 1:] = rng.normal(size=(n - 1,) * 3)
    texts = ["".join(rng.choice(list("abcdefg .é𝒳"), k)) for k in (0, 1, 2, 3, 40, 300)]
    wanted = []
    for t in texts:
        per = brute_features(t.replace("𝒳", "ʯ"), alphabet)  # both are rare letters of the first class
        at = [sum(table[k] * v for k, v in per.get(i, {}).items()) for i in range(len(t) + svm.WINDOW)]
        wanted.append(max([0.0, *(sum(at[i : i + m]) for i in range(len(t)) for m in svm.LENGTHS)]))
    assert alphabet.table[0x2AF] == svm.RARE
    for step in (64, 1 << 18):
        monkeypatch.setattr(svm, "_STEP", step)
        codes, starts = alphabet.codes(texts)
        found = np.maximum.reduceat(svm.windows(codes, table.ravel(), n), starts)
        assert found.tolist() == pytest.approx(wanted, rel=1e-4, abs=1e-4)


def test_folded_table_is_the_machine():
    rng = np.random.default_rng(2)
    alphabet = svm.Alphabet(CLEAN)
    strings = svm.Strings([" " + w for w in CLEAN[:9]], alphabet)
    codes, starts = alphabet.codes(["the old town", "weather"])
    weights = rng.normal(size=strings.root.shape[1])
    n, table = alphabet.size, strings.fold(weights)
    for length in svm.LENGTHS:
        row, triple, weight = svm.triples(codes, n, starts, length)
        direct = np.bincount(row, weight * table[triple], 2)
        assert (strings.coordinates(codes, starts, length) @ weights).tolist() == pytest.approx(direct.tolist(), rel=1e-3, abs=1e-3)


def test_insults_with_gaps_and_inserted_characters(model):
    texts, toxic = made(np.random.default_rng(7), 400)
    scores = model.scores(model.values(texts))
    assert (scores[toxic] >= 0.5).mean() > 0.98 and (scores[~toxic] < 0.5).mean() > 0.98
    clean = model.scores(model.values(["the report was sent to town", "w e a t h e r", "r.e.p.o.r.t", "trxade", ""]))
    for insult in ("blockhead", "nitwit", "scoundrel"):
        forms = [insult, insult.upper(), insult[:3] + "*" + insult[3:], "-".join(insult), " ".join(insult), insult[:4] + "x" + insult[4:], insult[:-1]]
        found = model.scores(model.values([f"the old {f} was sent" for f in forms]))
        assert found.min() > clean.max(), (insult, found, clean)


def test_one_place_in_a_long_text_counts(model):
    long = " ".join(CLEAN * 3000)
    scores = model.scores(model.values([long, long + " nitwit " + long]))
    assert scores[0] < 0.5 <= scores[1]


def test_few_labels():
    assert svm.learn(["a", "b"], np.array([True, True]), 0.9).table is None
    model = svm.learn(["nitwit nitwit", "the town"], np.array([True, False]), 0.5)
    assert np.isfinite(model.scores(model.values(["", "x", "nitwit"]))).all()
    assert np.isfinite(svm.learn(["", ""], np.array([True, False]), 0.5).scores(np.zeros(1))).all()


def test_toxicity_on_odd_tables(spark):
    texts, toxic = made(np.random.default_rng(3), 300)
    rows = [(i, t, "kept", i) for i, t in enumerate(texts)]
    rows += [(None, "nitwit", "kept", 1), (None, None, None, None), (900, None, "kept", 1), (901, "", "kept", 1), (902, "nitwit " * 50_000, "kept", 1), (0, texts[0], "kept", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, h long")
    marks = [(i, int(y)) for i, y in enumerate(toxic)] + [(5, 0), (5, 1), (6, None), (None, 1), (7, 3), (5000, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = svm.fit(docs, labels)
    out = svm.score(docs, model)
    assert out.columns == docs.columns and out.count() == len(rows)
    by = {(r.doc_id, r.text): r.score for r in out.collect()}
    assert by[None, "nitwit"] > 0.5 and by[902, "nitwit " * 50_000] > 0.5 and by[900, None] == by[901, ""] == by[None, None] < 0.5
    again = svm.fit(docs.repartition(7), labels.repartition(3))
    assert (again.table == model.table).all() and (again.curve == model.curve).all()
    assert svm.score(docs.limit(0), model).count() == 0
    one = svm.fit(docs, labels.filter("toxic = 1"))
    assert {r.score for r in svm.score(docs, one).collect()} == {1.0}
    assert {r.score for r in svm.score(docs, svm.fit(docs.limit(0), labels.limit(0))).collect()} == {0.5}


def test_long_texts_teach_by_a_stretch(spark):
    texts, toxic = made(np.random.default_rng(4), 60, 0.5)
    docs = spark.createDataFrame([(i, " ".join([t] * 40)) for i, t in enumerate(texts)], "doc_id long, text string")
    model = svm.fit(docs, spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int"), longest=500)
    found = np.array([r.score for r in svm.score(docs, model).orderBy("doc_id").collect()])
    assert (found[toxic].mean() - found[~toxic].mean()) > 0.3


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op13_subsequence_svm(spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = found.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    rank = rows.score.rank()
    bad = rows.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.93 and (rows.predicted == rows.toxic).mean() > 0.93
    assert found.filter(F.col("held_out") != (fold("doc_id", 5) == 0)).count() == 0 and found.count() == 10_000

import inspect
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import normalise
from tessera.operators import eda, evaluation, models, neardup, predlog, quality
from tessera.plans import catalogue
from tessera.sources import archive, pages, reports


def test_article_text():
    body = "word " * 20
    page = f"<html><head><title>Big news</title></head><body><nav><p>menu</p></nav><article><p>{body}<p>second &amp; last<script>x()</script></article><p>outside</p></body></html>"
    assert pages.article_text(page) == f"Big news. {body}second & last"
    assert pages.article_text("<body><div>only this</div><footer>no</footer></body>") == "only this"
    assert pages.article_text(None) == pages.article_text("") == ""
    assert pages.article_text(f"<main><p>{body}</p></main><p>other</p>") == body.strip()


def test_long_pages_are_whole(spark):
    body = " ".join(f"word{i}" for i in range(10_000))
    page = f"<article><p>{body}</p><p>the end</p></article>"
    assert len(body) > 50_000 and pages.article_text(page) == f"{body} the end"
    assert pages.article_text(page, 50_000) == body[:50_000]
    out = pages.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [r.text for r in out] == [f"{body} the end"]


def test_minhash(spark):
    words = [f"w{i}" for i in range(200)]
    near = words.copy()
    near[100] = "other"
    texts = [" ".join(words), " ".join(words), " ".join(near), "short one", "", None, " ".join(reversed(words))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    assert {r.doc_id: r.class_id for r in neardup.classes(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6}
    found = neardup.pairs(docs).collect()
    sigs = {r[0]: r[1] for r in docs.select("doc_id", neardup.signature(F.col("content"))).collect()}
    wanted = {(a, b) for a in (0, 2, 3, 4, 6) for b in (0, 2, 3, 4, 6) if a < b and sum(x == y for x, y in zip(sigs[a], sigs[b], strict=True)) / 64 >= 0.8}
    assert wanted == {(0, 2)} == {(r.a, r.b) for r in found}
    assert found[0].n_a == 2 and docs.select(normalise(F.col("content"))).count() == 7
    assert neardup.pairs(docs.limit(0)).count() == 0


def test_bootstrap(spark):
    rows = [(i, s, i % 2, (i % 2) if (s == "a") == (i % 3 == 0) else 1 - i % 2, 0.5) for i in range(300) for s in "ab"]
    scores = spark.createDataFrame(rows, "doc_id long, system string, label int, pred int, proba double")
    a, b = sorted(evaluation.bootstrap(scores).collect())
    assert a.accuracy == pytest.approx(1 / 3, abs=1e-6) and b.accuracy == pytest.approx(2 / 3, abs=1e-6)
    assert a.accuracy_low < a.accuracy < a.accuracy_high and a.accuracy_low + b.accuracy_high == pytest.approx(1)
    assert evaluation.bootstrap(scores.limit(0)).count() == 0


def test_corpus_drop(spark):
    rows = [(1, "a", 1, 1), (2, "a", 0, 0), (3, "a", 1, 1), (4, "a", 0, 1), (5, "b", 1, 0), (6, "b", 0, 0)]
    scores = spark.createDataFrame(rows, "doc_id long, corpus string, label int, pred int")
    found = {r.corpus: r for r in evaluation.corpus_drop(scores, "corpus", "a").collect()}
    assert found["a"].n == 4 and found["a"].accuracy == 0.75 and found["a"].accuracy_drop == 0 and found["a"].f1 == 0.8
    assert found["b"].accuracy_drop == 0.25 and found["b"].f1 == 0 and found["b"].f1_drop == 0.8
    assert evaluation.corpus_drop(scores, "corpus", "none").filter("accuracy_drop IS NULL").count() == 2


def test_smooth_idf_and_saved_models(spark, tmp_path):
    docs = [(1, 0, ["a", "b", "a"]), (2, 1, ["a", "c"]), (3, 1, ["b", "c", "c"]), (4, 0, [])]
    df = spark.createDataFrame(docs, "doc_id long, label int, tokens array<string>")
    model = models.linear_pipeline("nb", 10).fit(df)
    vocab = model.stages[0].vocabulary
    for r in model.transform(df).collect():
        raw = [r.tokens.count(t) * (math.log(5 / (1 + sum(t in d[2] for d in docs))) + 1) for t in vocab]
        norm = math.sqrt(sum(x * x for x in raw)) or 1.0
        assert r.features.toArray() == pytest.approx([x / norm for x in raw])
    models.save(model, str(tmp_path / "m"))
    again = models.load(str(tmp_path / "m"))
    assert [r.probability for r in again.transform(df).collect()] == [r.probability for r in model.transform(df).collect()]
    with pytest.raises(FileNotFoundError, match="none_here"):
        models.load(str(tmp_path / "none_here"))


def test_folds_have_a_row_each(spark):
    rows = [(None if i % 7 == 0 else i % 90, i % 2 if i % 5 else None, "t" * i) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, label int, content string")
    out = eda.stratified_folds(df, 4).collect()
    assert sorted((r.doc_id or -1, r.label is None, r.content) for r in out) == sorted((k or -1, c is None, t) for k, c, t in rows)
    for c in (0, 1, None):
        sizes = [sum(r.label == c and r.fold == f for r in out) for f in range(4)]
        assert max(sizes) - min(sizes) <= 1
    assert eda.stratified_folds(df.limit(0)).count() == eda.stratified_split(df.limit(0)).count() == 0


def test_metric_drift(spark):
    found = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 1.0)], "system string, accuracy double")
    stored = spark.createDataFrame([("a", 0.5), ("b", 0.75), ("d", 0.1), ("c", None)], "system string, accuracy double")
    assert [tuple(r) for r in evaluation.metric_drift(found, stored).orderBy("system").collect()] == [("a", 0.5, 0.5, 0.0, True), ("b", 0.25, 0.75, 0.5, False)]


def test_shuffled_columns_are_permutations(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") * 3).cast("double").alias("v"), (F.col("id") % 7).cast("double").alias("w"), F.lit(1).alias("label"))
    out = models.shuffled_columns(df, ["v", "w"], 2, size=50)
    assert sorted(out.columns) == ["column", "doc_id", "label", "repeat", "v", "w"] and out.count() == 500 * 5
    for column, repeat, v_moves, w_moves in ((-1, 0, False, False), (0, 0, True, False), (0, 1, True, False), (1, 0, False, True)):
        rows = out.filter((F.col("column") == column) & (F.col("repeat") == repeat)).collect()
        assert sorted(r.v for r in rows) == [3.0 * i for i in range(500)] and sorted(r.w for r in rows) == sorted(float(i % 7) for i in range(500))
        assert (sum(r.v == 3 * r.doc_id for r in rows) < 20) == v_moves and (sum(r.w == r.doc_id % 7 for r in rows) < 200) == w_moves


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, None), ("c", float("nan"), 2)], "k string, x double, n int")
    assert reports.markdown_table(df, 2, "-") == "| k | x | n |\n| --- | --- | --- |\n| a\\|b | 1.50 | - |\n| c | - | 2 |"
    assert json.loads(reports.json_report({"t": df}))["t"][1] == {"k": "c", "x": None, "n": 2}
    reports.write_csv(df, str(tmp_path / "out"), one_file=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_registered_models_have_the_reference_parameters(spark, monkeypatch):
    made = []
    monkeypatch.setattr(models, "ml_scores", lambda train, test, pipeline, system: made.append((train, pipeline)))
    monkeypatch.setattr(evaluation, "confusion", lambda scores: scores)
    for name in ("lr_eval", "char_lr_eval", "forest_eval"):
        catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    (train, words), (_, chars), (_, forest) = made
    assert [p.getStages()[0].getVocabSize() for p in (words, chars)] == [5000, 30_000] and words.getStages()[-1].getMaxIter() == 1000
    assert any(" " in t for r in train.limit(20).collect() for t in r.tokens)
    assert forest.getStages()[-1].getNumTrees() == 300
    assert inspect.signature(models.permutation_importance).parameters["repeats"].default == 5


def test_file_checks(spark):
    def files(*rows):
        return spark.createDataFrame(list(rows), "file string, sha256 string")

    def found(now, before=None, have="a string, b int"):
        t = spark.createDataFrame([], have)
        return {r.check_id: (r.value, r.status) for r in quality.file_checks(now, {"t": t}, {"t": {"a": "string", "b": "int"}}, before).collect()}

    now = files(("x", "1"), ("y", "2"))
    first = found(now)
    assert first == {"integrity.fingerprint": (2.0, "PASS"), "integrity.unchanged": (None, "INFO"), "schema.columns": (0.0, "PASS"), "schema.label_provenance": (None, "WARN")}
    states = [found(now, files(*b))["integrity.unchanged"] for b in ((("x", "1"), ("y", "2")), (("x", "1"),), (("x", "0"),))]
    assert states == [(0.0, "PASS"), (1.0, "WARN"), (2.0, "FAIL")]
    schemas = [found(now, None, h)["schema.columns"] for h in ("a string, b int, c int", "a string", "a string, b string")]
    assert schemas == [(1.0, "WARN"), (1.0, "FAIL"), (1.0, "FAIL")]


def test_log_ids_and_terms(spark):
    rows = spark.range(300).select(F.col("id"), F.concat(F.lit("t"), "id").alias("t"), (F.col("id") / 300).alias("proba"))
    log = predlog.entries(rows, "t", "nb", F.lit("cli"), F.current_timestamp())
    a = predlog.numbered(log)
    assert sorted(r.id for r in a.collect()) == list(range(1, 301)) and predlog.last_id(a) == 300
    assert sorted(r.id for r in predlog.numbered(log, predlog.last_id(a)).collect()) == list(range(301, 601))
    assert predlog.last_id(log.limit(0)) == 0 and predlog.numbered(log.limit(0)).count() == 0
    terms = spark.createDataFrame([(5, 2, 'b"', -0.25), (5, 1, "a", 1.5), (5, 3, "c", 1e-7)], "doc_id long, rank int, term string, contribution double")
    out = {r.id: r.top_terms for r in predlog.with_top_terms(log, terms, 2).collect()}
    assert json.loads(out[5]) == [["a", 1.5], ['b"', -0.25]] and out[6] is None and len(out) == 300


def test_run_files(spark, tmp_path):
    assert [reports.format_p(p) for p in (None, float("nan"), 0.00001, 0.25)] == ["", "", "1.00e-05", "0.2500"]
    assert [reports.percent(v) for v in (None, 0.123)] == ["", "12.3%"]
    assert [reports.scored_path(p) for p in ("/d/a.csv", "a.csv", "hdfs://n/d/a.b.csv")] == ["/d/a_scored.csv", "a_scored.csv", "hdfs://n/d/a.b_scored.csv"]
    run, results, base = {"seed": 42}, {"nb": {"accuracy": 0.9, "f1": 0.8}, "lr": {"accuracy": 0.95}}, {"majority": 0.5}
    reports.write_run(spark, str(tmp_path), run, results, base)
    text = spark.read.text(str(tmp_path / "metrics.json"), wholetext=True).first()[0]
    assert json.loads(text) == {"run": run, "models": results, "baselines": base}
    card = reports.model_card(run, results, base, True)
    assert "| nb | 0.9000 | 0.8000 |" in card and "| lr | 0.9500 |  |" in card and "| majority | 0.5000 |" in card and "was stripped" in card
    assert "  accuracy: 0.9000" in reports.metrics_text(run, results, base)
    assert {p.name for p in tmp_path.iterdir()} == {"metrics.json", "metrics.txt", "run_metadata.json", "MODEL_CARD.md"}


def test_archive(tmp_path):
    path, folder = str(tmp_path / "z.zip"), tmp_path / "data"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("top/a.csv", "one")
        z.writestr("b.csv", "two")
    with pytest.raises(KeyError):
        archive.extract(path, ["a.csv", "c.csv"], str(folder))
    assert not folder.exists()
    assert archive.extract(path, ["a.csv", "b.csv"], str(folder)) == [str(folder / "a.csv"), str(folder / "b.csv")]
    (folder / "a.csv").write_text("changed")
    assert archive.extract(path, ["a.csv"], str(folder)) == [] and (folder / "a.csv").read_text() == "changed"
    archive.extract(path, ["a.csv"], str(folder), force=True)
    assert (folder / "a.csv").read_text() == "one"

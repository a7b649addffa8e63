import datetime

import pytest
from pyspark.sql import functions as F

from tessera.config import CONFIDENCE_BINS, DATE_FORMATS, LENGTH_BINS
from tessera.functions import stats, text
from tessera.operators import eda, evaluation, models, neardup, predlog, quality
from tessera.sources import corpus


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("raw,clean", [("Hello, WORLD!!!", "hello world"), ("", ""), ("   ", ""), (None, ""), ("123", ""), ("!!! ??? ...", ""), ("a b c", "")])
def test_clean(spark, raw, clean):
    assert one(spark, raw, lambda c: F.array_join(text.clean_tokens(c), " ")) == clean


def test_boilerplate(spark):
    out = one(spark, "WASHINGTON (Reuters) - The Senate voted today. Reporting by A B; Editing by C.", text.strip_boilerplate)
    assert "Reuters" not in out and "WASHINGTON" not in out and "Senate voted" in out
    assert one(spark, "Ordinary prose stays.", text.strip_boilerplate) == "Ordinary prose stays."


def test_text_stats(spark):
    s = text.text_stats(F.col("x"))
    r = spark.createDataFrame([("THIS is HUGE!! Really?",), ("",)], "x string").select(*[c.alias(k) for k, c in s.items()]).collect()
    assert (r[0].n_words, r[0].exclamation_count, r[0].question_count, r[0].allcaps_words) == (4, 2, 1, 2)
    assert (r[1].n_words, r[1].allcaps_ratio, r[1].n_sentences) == (0, 0.0, 1)


def test_dates_and_bins(spark):
    def day(v):
        d = one(spark, v, lambda c: text.parse_date(c, DATE_FORMATS))
        return d and d.date()

    assert day("December 31, 2017 ") == datetime.date(2017, 12, 31) and day("31-Dec-17") == datetime.date(2017, 12, 31) and day("http://x") is None
    assert [one(spark, v, lambda c: text.bucket(c, LENGTH_BINS), "int") for v in (0, 49, 50, 999, 5000)] == ["<50", "<50", "50-199", "500-999", "1000+"]
    assert [one(spark, v, lambda c: text.bucket_upper(c, CONFIDENCE_BINS), "double") for v in (0.5, 0.6, 0.61, 1.0)] == ["0.5-0.6", "0.5-0.6", "0.6-0.7", "0.9-1.0"]
    assert one(spark, "ab c", lambda c: text.char_ngrams(c, 3, 3)) == [" ab", "ab ", " c "]
    assert one(spark, "a b c d e f", lambda c: text.shingles(F.split(c, " "))) == ["a b c d e", "b c d e f"]


def test_statistics(spark):
    m = stats.mcnemar(3, 1)
    assert (m["b"], m["c"], m["chi2"]) == (3, 1, 0.25) and m["p"] == pytest.approx(0.625)
    assert stats.mcnemar(0, 0)["p"] == 1.0 and stats.mcnemar(5, 5)["chi2"] == pytest.approx(0.1)
    df = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.04,)], "p double")
    assert [round(r.p_holm, 6) for r in stats.holm(df, "p").orderBy("p").collect()] == [0.04, 0.06, 0.06, 0.06]
    same = spark.createDataFrame([(1, 1), (2, 2)], "p long, q long")
    assert stats.js_distance(same, "p", "q").first()[0] == pytest.approx(0.0)
    apart = spark.createDataFrame([(1, 0), (0, 2)], "p long, q long")
    assert stats.js_distance(apart, "p", "q").first()[0] == pytest.approx(1.0)
    assert stats.js_distance(spark.createDataFrame([(0, 1)], "p long, q long"), "p", "q").first()[0] is None
    ks = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "v int, label int")
    assert stats.ks_statistic(ks, "v", "label").first()[0] == 1.0
    assert [one(spark, v, lambda c: stats.verdict(c, 0.01, 0.05), "double") for v in (0.01, 0.02, 0.05)] == ["PASS", "WARN", "FAIL"]


def test_quality_score(spark):
    t = spark.createDataFrame([("a", 1.0, "PASS"), ("b", 1.0, "WARN"), ("c", 2.0, "FAIL"), ("d", 5.0, "INFO")], "check_id string, weight double, status string")
    assert quality.score(t).first()[0] == 37.5 and not quality.gate(t)


def test_quality_near_duplicates(spark):
    words = [[f"{c}{i}" for i in range(200)] for c in "abcdefgh"]
    texts = [" ".join(w) for w in words]

    def near(label, other):
        changed = " ".join(["other", *words[0][1:]])
        rows = [(i, t, i % 2, "s", "https://x.org" if i < 2 else f"t{i}", "June 1, 2016") for i, t in enumerate(texts)]
        rows += [(100, changed, label, "s", "t100", "not a date"), (101, texts[1], other, "s", "t101", "July 1, 2017")]
        df = spark.createDataFrame(rows, "doc_id long, content string, label int, subject string, title string, date string")
        return {r.check_id: (r.value, r.status) for r in quality.checks(df).collect()}

    found = near(0, 1)
    assert len(found) == 17 and found["uniqueness.near_duplicates"] == (round(2 / 9, 6), "FAIL")
    assert found["uniqueness.duplicate_titles"] == (0.1, "FAIL") and found["validity.title_is_url"] == (0.2, "FAIL")
    assert found["validity.dates"] == (0.1, "FAIL") and found["consistency.date_label"] == (0.1, "WARN") and found["drift.dates"][1] == "FAIL"


def test_quality_vocabulary(spark):
    """Equal to the vocabulary of the long table, repeated and null keys too, without shuffling the terms of a document."""
    rows = [(i, " ".join(f"word{chr(97 + (i * j) % 7)}" for j in range(9)), i % 2) for i in range(40)]
    rows += [(3, "worda wordb again", 1), (3, "again more", 1), (3, "again", 0), (None, "again worda", 0), (None, "again", 0), (50, None, 1), (51, "again more", None), (51, "more", None)]
    df = spark.createDataFrame(rows, "doc_id long, content string, label int").repartition(3)
    for least in (1, 3):
        wanted = [tuple(r) for r in eda.vocabulary(eda.term_table(df), least, 5).collect()]
        assert [tuple(r) for r in quality.vocabulary(df, least, 5).select("term", "tf", "df", "df_fake", "df_real").collect()] == wanted and len(wanted) == 5
    assert "MapInArrow" in quality.vocabulary(df, 1, 5)._jdf.queryExecution().toString()


def test_near_copies_across_labels(spark):
    words = [f"w{i}" for i in range(200)]
    far = [(i, " ".join(f"x{i}y{j}" for j in range(50)), i % 2) for i in range(200)]
    copies = [" ".join(words), " ".join(["other", *words[1:]]), " ".join(words).upper()]
    for labels, cross in (((0, 0, 0), 0), ((0, 1, 0), 2), ((0, 0, 1), 2)):
        df = spark.createDataFrame([*far, *((1000 + i, t, y) for i, (t, y) in enumerate(zip(copies, labels, strict=True)))], "doc_id long, content string, label int")
        assert neardup.involvement(df).first() == (203, 3, cross)
    full = spark.createDataFrame([(i, t, y, "s") for i, t, y in [*far, (1000, copies[0], 0), (1001, copies[1], 1)]], "doc_id long, content string, label int, subject string")
    found = {r.check_id: r for r in quality.checks(full).collect()}["uniqueness.near_duplicates"]
    assert (found.value, found.status) == (round(2 / 202, 6), "FAIL")
    assert neardup.involvement(full.limit(0)).first() == (None, None, 0)


def test_labelled_documents_have_titles(spark):
    rows = corpus.labelled_documents(spark, "/root/testdata/sf0.001").select("content", "title").collect()
    assert rows and all(r.title == r.content.split("\n")[0].strip() for r in rows)


def test_date_stump(spark):
    d = [("2015-04-01", 0), ("2015-05-01", 0), ("2016-06-01", 1), ("2016-07-01", 1)]
    df = spark.createDataFrame(d, "d string, label int").withColumn("d", F.to_timestamp("d"))
    r = eda.date_stump(df, "d", F.col("label")).first()
    assert r.accuracy == 1.0 and "2015-05-01" < r.cutoff <= "2016-06-01" and r.direction == "fake first"
    flat = spark.createDataFrame([("2015-04-01", i % 2) for i in range(4)], "d string, label int").withColumn("d", F.to_timestamp("d"))
    assert eda.date_stump(flat, "d", F.col("label")).first().accuracy <= 0.75


def test_evaluation(spark):
    s = spark.createDataFrame([(1, "a", 1, 1, 0.9), (2, "a", 0, 0, 0.1), (3, "a", 1, 1, 0.8), (4, "a", 0, 0, 0.2)], "doc_id long, system string, label int, pred int, proba double")
    assert evaluation.areas(s).first()[1:] == (1.0, 1.0)
    assert evaluation.confusion(s).first().accuracy == 1.0
    assert models.stump(s.select("label", F.col("pred").alias("f")), "f").filter("f = 1").first().pred == 1


def test_models(spark):
    rows = [(f"good fine nice word{i % 3}".split(), 1) for i in range(20)] + [(f"bad poor awful word{i % 3}".split(), 0) for i in range(20)]
    df = spark.createDataFrame(rows, "tokens array<string>, label int")
    for kind in ("lr", "svm", "nb"):
        out = models.linear_pipeline(kind, n=len(rows)).fit(df).transform(df)
        assert out.filter(F.col("prediction") == F.col("label")).count() == len(rows)


def test_log(spark):
    x = spark.createDataFrame([(1, "one text", 0.05, "text"), (2, "two", 0.6, "url"), (3, "two", 0.9, "url")], "id long, t string, proba double, source string")
    log = predlog.entries(x, "t", "nb", F.col("source"), F.current_timestamp())
    events = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (2, 1, 1)], "id long, event_ts long, true_label int")
    s = predlog.summary(predlog.resolved(log, events)).first()
    assert (s.total, s.low_confidence, s.repeated_inputs, s.reviewed, s.observed_accuracy) == (3, 1, 1, 2, 1.0)
    assert [r.id for r in predlog.fetch(log, limit=2).collect()] == [3, 2]
    assert predlog.feedback(1, correct=False) == (0, "incorrect")
    with pytest.raises(ValueError):
        predlog.feedback(1)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,text,subject,date\nT,"line\none ""q""",s,d\n,  ,s,d\nT,"line\none ""q""",s,d\n')
    (tmp_path / "b.csv").write_text("title,text,subject,date\nU,body,s,d\n")
    df = corpus.labelled_files(spark, {str(tmp_path / "a.csv"): 0, str(tmp_path / "b.csv"): 1})
    assert sorted((r.content, r.label) for r in df.collect()) == [('T line\none "q"', 0), ("U body", 1)]
    odd = spark.createDataFrame([("x", "1"), ("y", "7"), ("z", "0.0")], "Content string, Class string")
    assert sorted((r.content, r.label) for r in corpus.second_corpus(odd).collect()) == [("x", 1), ("z", 0)]
    assert corpus.text_column(spark.createDataFrame([("a", "long text")], "id string, note string")) == "note"


def test_worst_verdict(spark):
    cases = [("PASS", "WARN", "WARN"), ("FAIL", "PASS", "FAIL"), ("INFO", "PASS", "INFO"), ("PASS", "PASS", "PASS")]
    rows = spark.createDataFrame(cases, "a string, b string, want string").select(stats.worst(F.col("a"), F.col("b")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows)


def test_log_is_emptied(spark, tmp_path):
    path = str(tmp_path / "log")
    spark.range(7).write.parquet(path)
    assert predlog.delete_all(spark.read.parquet(path), path) == 7 and spark.read.parquet(path).count() == 0

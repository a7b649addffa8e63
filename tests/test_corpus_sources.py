import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import eda
from tessera.sources import corpus

HEAD = "title,text,subject,date\n"


def test_first_of_equal_rows_stays(spark, tmp_path):
    """By order of the files, also where their labels differ or their names sort otherwise."""
    rows = [f"t,body {i},first{i},d\n" for i in range(300)]
    again = [f"t,body {i},again{i},d\n" for i in range(300)]
    (tmp_path / "z.csv").write_text(HEAD + "".join(rows) + "".join(reversed(again)))
    (tmp_path / "a.csv").write_text(HEAD + "".join(again) + "t,other,s,d\n")
    df = corpus.labelled_files(spark, {str(tmp_path / "z.csv"): 0, str(tmp_path / "a.csv"): 1})
    found = {r.content: (r.label, r.subject) for r in df.collect()}
    assert found == {f"t body {i}": (0, f"first{i}") for i in range(300)} | {"t other": (1, "s")}
    assert df.columns == ["content", "label", "title", "body", "subject", "date"]
    every = corpus.labelled_files(spark, {str(tmp_path / "z.csv"): 0, str(tmp_path / "a.csv"): 1}, drop_duplicates=False)
    assert every.count() == 901


def test_missing_files_are_all_named(spark, tmp_path):
    (tmp_path / "there.csv").write_text(HEAD)
    with pytest.raises(FileNotFoundError, match="one.csv.*two.csv"):
        corpus.labelled_files(spark, {str(tmp_path / "one.csv"): 0, str(tmp_path / "there.csv"): 0, str(tmp_path / "two.csv"): 1})
    with pytest.raises(ValueError):
        corpus.labelled_files(spark, {})
    assert corpus.labelled_files(spark, {str(tmp_path / "there.csv"): 0}).count() == 0


def test_boilerplate_goes_before_equal_rows_are_found(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + ",WASHINGTON (Reuters) - The Senate voted.,s,d\n,The Senate voted.,s,d\n")
    files = {str(tmp_path / "a.csv"): 1}
    assert corpus.labelled_files(spark, files).count() == 2
    assert [r.content for r in corpus.labelled_files(spark, files, strip=True).collect()] == ["The Senate voted."]


def test_second_corpus_sample(spark):
    rows = [(f"text {i}", str(i % 3)) for i in range(200)]
    one, other = (spark.createDataFrame(r, "content string, target string").repartition(p) for r, p in ((rows, 3), (rows[::-1], 7)))
    pick = lambda df, n, seed=42: sorted(r.content for r in corpus.second_corpus(df, sample=n, seed=seed).collect())
    assert pick(one, 20) == pick(other, 20) and len(pick(one, 20)) == 20
    assert pick(one, 20) != pick(one, 20, 7)
    assert len(pick(one, 1000)) == corpus.second_corpus(one).count() == 134


def test_fingerprints_of_small_and_large_files(spark, tmp_path):
    """Files beyond the bound are hashed in blocks: one block and a bit, several, exactly one; empty files are not listed."""
    sizes = {"a b.bin": corpus.BLOCK + 7, "b.bin": 3 * corpus.BLOCK, "c.bin": corpus.BLOCK, "d.bin": 0, "e.bin": 11}
    data = {k: (hashlib.sha256(k.encode()).digest() * (n // 32 + 1))[:n] for k, n in sizes.items()}
    for k, v in data.items():
        (tmp_path / k).write_bytes(v)
    want = sorted((hashlib.sha256(v).hexdigest(), len(v)) for v in data.values() if v)
    for whole in (-1, 11, corpus.BLOCK, 1 << 30):
        found = corpus.fingerprints(spark, str(tmp_path), whole)
        assert found.columns == ["file", "sha256", "bytes", "modified"]
        rows = found.collect()
        assert sorted((r.sha256, r.bytes) for r in rows) == want
        assert all(r.modified for r in rows)
    streamed = corpus.fingerprints(spark, str(tmp_path), -1)
    assert corpus.compare_runs(streamed, corpus.fingerprints(spark, str(tmp_path))).filter("state <> 'unchanged'").isEmpty()


def test_temporal_parts(spark):
    rows = [(dt.datetime(2015, m, 1), m % 2) for m in range(1, 9)] + [(None, 1)]
    df = spark.createDataFrame(rows, "d timestamp, label int")
    train, test = eda.temporal_parts(df, "d", "2015-05-01")
    assert (train.count(), test.count()) == (4, 4) and train.columns == ["d", "label"]
    for cutoff in ("2014-01-01", "2016-01-01"):
        with pytest.raises(ValueError, match="empty.*2015-01-01"):
            eda.temporal_parts(df, "d", cutoff)
    with pytest.raises(ValueError, match="one class"):
        eda.temporal_parts(df, "d", "2015-02-01")


def test_excerpt(spark):
    long = "a" * 200 + "\n\n the   end " + "b" * 300
    rows = [(0, long), (1, "the start"), (2, "no match " * 40), (3, ""), (4, None), (5, "\U0001f600" * 150 + " the x")]
    found = {r.i: r.e for r in spark.createDataFrame(rows, "i int, t string").select("i", text.excerpt(F.col("t"), r"\bthe\b").alias("e")).collect()}
    one = "a" * 200 + " the end " + "b" * 300
    assert found == {0: "..." + one[91:311] + "...", 1: "the start...", 2: ("no match " * 40)[:220] + "...", 3: "...", 4: "...", 5: "..." + ("\U0001f600" * 150 + " the x")[41:261] + "..."}

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.operators import logstore, predlog
from tessera.streaming import log as stream

SCHEMA = "id long, created_at timestamp, model string, input_hash string, confidence double, prediction int"


def batch(spark, start, n, model="nb"):
    return spark.range(start, start + n).select("id", F.timestamp_seconds(F.col("id")).alias("created_at"), F.lit(model).alias("model"), F.col("id").cast("string").alias("input_hash"), F.lit(0.5).alias("confidence"), F.lit(1).alias("prediction"))


def test_batches_at_once_get_ids_of_their_own(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    sizes = [30, 1, 25, 40, 7, 12]
    with ThreadPoolExecutor(6) as pool:
        firsts = list(pool.map(lambda i: logstore.append(batch(spark, 100 * i, sizes[i], f"m{i}"), path), range(6)))
    assert sorted(firsts)[0][0] == 1 and logstore.append(batch(spark, 0, 0), path) == (0, 0)
    log = logstore.read(spark, path)
    ids = sorted(r.id for r in log.collect())
    assert ids == list(range(1, sum(sizes) + 1))
    for i, (first, n) in enumerate(firsts):
        assert n == sizes[i] and sorted(r.id for r in log.filter(f"model = 'm{i}'").collect()) == list(range(first, first + n))
    # Claims alone: many writers, no batch.
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda n: (logstore.claim(spark, path, n), n), [3] * 24))
    taken = [k for first, n in got for k in range(first, first + n)]
    assert len(set(taken)) == 72 and min(taken) == sum(sizes) + 1


def test_unfinished_batches_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    with pytest.raises(FileNotFoundError, match="no finished batch"):
        logstore.read(spark, path)
    assert logstore.read(spark, path, SCHEMA).count() == 0
    logstore.append(batch(spark, 0, 5), path)
    first = logstore.claim(spark, path, 10)
    (tmp_path / "log" / "batches" / f"{first:019d}").mkdir()
    logstore.append(batch(spark, 0, 5), path)
    assert sorted(r.id for r in logstore.read(spark, path).collect()) == [1, 2, 3, 4, 5, 16, 17, 18, 19, 20]


def test_feedback_on_unknown_ids(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    logstore.append(batch(spark, 0, 5), path)
    log = logstore.read(spark, path)
    events = spark.createDataFrame([(1, 1, 1), (9, 0, 1), (9, 1, 2)], "id long, true_label int, event_ts long")
    assert [tuple(r) for r in logstore.unknown(events, log).collect()] == [(9, 2)]
    with pytest.raises(KeyError, match="9"):
        logstore.give_feedback(events, log)
    assert logstore.give_feedback(events.filter("id = 1"), log).filter("user_feedback = 'correct'").count() == 1


def at(hour, minute):
    return dt.datetime(2024, 1, 1, hour, minute)


def feed(spark, folder, rows):
    spark.createDataFrame([(i, t, m, h, c, 1) for i, (t, m, h, c) in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(df, path, checkpoint, mode="append"):
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def test_hourly_counts_late_rows_and_restarts(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    counts = lambda: {(r.window.start.hour, r.model): (r.n, round(r.avg_confidence, 3)) for r in spark.read.parquet(out).collect()}
    start = lambda: drain(stream.hourly(spark.readStream.schema(SCHEMA).parquet(source)), out, check)
    feed(spark, source, [(at(1, 5), "nb", "a", 0.6), (at(1, 50), "nb", "b", 0.8), (at(1, 10), "lr", "c", 0.9), (at(2, 5), "nb", "d", 0.7)])
    start()
    # Five minutes late: still counted, after a restart from the checkpoint.
    feed(spark, source, [(at(1, 55), "nb", "e", 1.0), (at(3, 30), "nb", "f", 0.5)])
    start()
    assert counts() == {(1, "nb"): (3, 0.8), (1, "lr"): (1, 0.9), (2, "nb"): (1, 0.7)}
    # Hours late: the window is closed, and the row is left out.
    feed(spark, source, [(at(1, 30), "nb", "g", 0.1), (at(5, 0), "lr", "h", 0.5)])
    start()
    assert counts() == {(1, "nb"): (3, 0.8), (1, "lr"): (1, 0.9), (2, "nb"): (1, 0.7), (3, "nb"): (1, 0.5)}


def test_repeats_pass_once_within_the_watermark(spark, tmp_path):
    source, out, check = (f"file://{tmp_path}/{x}" for x in ("in", "out", "check"))
    start = lambda: drain(stream.once(spark.readStream.schema(SCHEMA).parquet(source)), out, check)
    hashes = lambda: sorted(r.input_hash for r in spark.read.parquet(out).collect())
    feed(spark, source, [(at(1, 0), "nb", "a", 0.5), (at(1, 1), "nb", "a", 0.5), (at(1, 2), "nb", "b", 0.5)])
    start()
    assert hashes() == ["a", "b"]
    # The same inputs again after a restart, one far later than the watermark.
    feed(spark, source, [(at(1, 20), "nb", "b", 0.5), (at(1, 30), "nb", "c", 0.5)])
    start()
    assert hashes() == ["a", "b", "c"]
    feed(spark, source, [(at(9, 0), "nb", "x", 0.5)])
    start()
    feed(spark, source, [(at(9, 5), "nb", "a", 0.5)])
    start()
    assert hashes() == ["a", "a", "b", "c", "x"]

"""Prediction log: an append-only table of predictions and one of feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import n_words
from tessera.operators import eda


def entries(scored: DataFrame, text: str, model: str, source: Column, created: Column, key: str = "id") -> DataFrame:
    """Log rows of scored texts: hash, preview, counts, label, confidence."""
    t, p = F.col(text), F.col("proba")
    return scored.select(F.col(key).alias("id"), created.alias("created_at"), source.alias("source"), F.lit(model).alias("model"), F.sha2(t.cast("binary"), 256).alias("input_hash"), F.substring(t, 1, 500).alias("text_preview"), F.length(t).alias("char_count"), n_words(t).cast("int").alias("word_count"), F.when(p >= 0.5, 1).otherwise(0).alias("prediction"), F.when(p >= 0.5, "REAL").otherwise("FAKE").alias("label"), F.round(F.greatest(p, 1 - p), 6).alias("confidence"), F.round(1 - p, 6).alias("proba_fake"), F.round(p, 6).alias("proba_real"))


def numbered(rows: DataFrame, last: int = 0, key: str = "id") -> DataFrame:
    """``rows`` with ids of their own, from ``last`` + 1 on without gaps.

    The order within a batch is that of a hash of ``key``, so that no task sorts
    the whole batch; later batches have greater ids.  ``last`` is the greatest
    id of the log (``last_id``).  Batches must not be numbered at once.
    """
    x = eda.ranked(rows.withColumn("_l1", F.lit(1)).withColumn("_h", eda.shuffled(key)), "_l1", "_h", key)
    return x.withColumn(key, (F.col("_r") + F.lit(last)).cast("long")).drop("_l1", "_h", "_r")


def last_id(log: DataFrame) -> int:
    return log.agg(F.max("id")).first()[0] or 0


def with_top_terms(rows: DataFrame, contributions: DataFrame, most: int = 10) -> DataFrame:
    """``rows`` with top_terms: JSON list of [term, contribution], largest first; null without terms.

    ``contributions``: doc_id (the id of a row), rank, term, contribution, as ``models.attribution`` gives them.
    """
    pair = F.concat(F.lit("["), F.to_json(F.array("term")).substr(F.lit(2), F.length(F.to_json(F.array("term"))) - 2), F.lit(", "), F.round("contribution", 5).cast("decimal(20,5)").cast("string"), F.lit("]"))
    kept = contributions.filter(F.col("rank") <= most).select(F.col("doc_id").alias("id"), F.struct("rank", pair.alias("p")).alias("x"))
    terms = kept.groupBy("id").agg(F.array_sort(F.collect_list("x")).getField("p").alias("t"))
    return rows.join(terms.select("id", F.concat(F.lit("["), F.array_join("t", ", "), F.lit("]")).alias("top_terms")), "id", "left")


def append(rows: DataFrame, path: str) -> None:
    """Add rows to the log; readers prune by model."""
    rows.write.mode("append").partitionBy("model").parquet(path)


def delete_all(log: DataFrame, path: str) -> int:
    """Empty the log at ``path``, read as ``log``; the number of rows it had."""
    n = log.count()
    log.sparkSession.createDataFrame([], log.schema).write.mode("overwrite").parquet(path)
    return n


def fetch(log: DataFrame, model: str | None = None, label: str | None = None, since=None, limit: int = 50) -> DataFrame:
    """Newest first; a limit of 0 is none."""
    for column, value in (("model", model), ("label", label)):
        if value is not None:
            log = log.filter(F.col(column) == value)
    if since is not None:
        log = log.filter(F.col("created_at") >= F.lit(since))
    log = log.orderBy(F.desc("id"))
    return log.limit(limit) if limit else log


def feedback(prediction: int, true_label: int | None = None, correct: bool | None = None) -> tuple[int, str]:
    """(true label, 'correct' or 'incorrect') from either of the two."""
    if true_label is None and correct is None:
        raise ValueError("feedback needs a true label or whether it was correct")
    if true_label is None:
        true_label = prediction if correct else 1 - prediction
    return true_label, "correct" if true_label == prediction else "incorrect"


def latest_feedback(events: DataFrame) -> DataFrame:
    """The last event of each id."""
    last = F.max_by(F.struct("true_label", "event_ts"), F.struct("event_ts", "true_label"))
    return events.groupBy("id").agg(last.alias("x")).select("id", "x.true_label")


def resolved(log: DataFrame, events: DataFrame) -> DataFrame:
    x = log.join(latest_feedback(events), "id", "left")
    return x.withColumn("user_feedback", F.when(F.col("true_label") == F.col("prediction"), "correct").when(F.col("true_label").isNotNull(), "incorrect"))


def summary(log: DataFrame, low: float = 0.7) -> DataFrame:
    """Totals, low confidence, feedback, and inputs that came more than once."""
    repeated = log.groupBy("input_hash").agg(F.count("*").alias("c")).agg(F.count_if(F.expr("c > 1")).cast("long").alias("repeated_inputs"))
    x = log.agg(F.count("*").cast("long").alias("total"), F.count_if(F.expr("label = 'FAKE'")).cast("long").alias("fake"), F.count_if(F.expr("label = 'REAL'")).cast("long").alias("real"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count_if(F.col("confidence") < low).cast("long").alias("low_confidence"), F.count_if(F.expr("user_feedback is not null")).cast("long").alias("reviewed"), F.round(F.avg(F.when(F.col("user_feedback").isNotNull(), (F.col("user_feedback") == "correct").cast("int"))), 6).alias("observed_accuracy"))
    return x.withColumn("one", F.lit(1)).join(repeated.withColumn("one", F.lit(1)), "one").drop("one")


def by(log: DataFrame) -> DataFrame:
    """Rows by label, by model and by source, from one pass."""
    x = log.groupingSets([["label"], ["model"], ["source"]], "label", "model", "source").agg(F.count("*").cast("long").alias("n"))
    kind = F.when(F.col("label").isNotNull(), "label").when(F.col("model").isNotNull(), "model").otherwise("source")
    return x.select(kind.alias("kind"), F.coalesce("label", "model", "source").alias("value"), "n")


def corrections(log: DataFrame) -> DataFrame:
    return log.filter("true_label is not null").select(F.col("text_preview").alias("text"), F.col("true_label").alias("label"), "model", "created_at")


def newest_per_model(log: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("model").orderBy(F.desc("created_at"), F.desc("id"))
    return log.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)

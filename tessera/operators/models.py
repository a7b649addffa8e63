"""Closed-form classifiers as queries, and pyspark.ml pipelines."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml.feature import IDF, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nb_fit(weights: DataFrame, vocab: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(term, lp0, lp1): multinomial naive Bayes log probabilities, smoothed."""
    per = weights.groupBy("term").agg(*[F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)).alias(f"w{c}") for c in (0, 1)])
    x = vocab.select("term").join(per, "term", "left").select("term", F.coalesce("w0", F.lit(0.0)).alias("w0"), F.coalesce("w1", F.lit(0.0)).alias("w1"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.select("term", *[(F.log(F.col(f"w{c}") + alpha) - F.log(F.sum(F.col(f"w{c}") + alpha).over(every))).alias(f"lp{c}") for c in (0, 1)])


def nb_predict(docs: DataFrame, weights: DataFrame, model: DataFrame, priors: tuple[float, float]) -> DataFrame:
    """(doc_id, label, pred, proba): probability of class 1; documents without terms have the prior; the model is broadcast."""
    gap = weights.join(F.broadcast(model), "term").groupBy("doc_id").agg(F.sum(F.col("weight") * (F.col("lp1") - F.col("lp0"))).alias("gap"))
    x = docs.select("doc_id", "label").join(gap, "doc_id", "left").withColumn("z", F.coalesce("gap", F.lit(0.0)) + F.lit(priors[1] - priors[0]))
    p = F.round(1 / (1 + F.exp(-F.col("z"))), 6)
    return x.select("doc_id", "label", p.alias("proba"), (p >= 0.5).cast("int").alias("pred"))


def attribution(weights: DataFrame, model: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` contributions of each document by size, with their direction."""
    x = weights.join(F.broadcast(model.select("term", (F.col("lp1") - F.col("lp0")).alias("coef"))), "term").withColumn("contribution", F.round(F.col("weight") * F.col("coef"), 6))
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.abs("contribution")), "term")
    y = x.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= top)
    return y.select("doc_id", "rank", "term", "contribution", F.when(F.col("contribution") >= 0, "REAL").otherwise("FAKE").alias("pushes"))


class SmoothIDF(Estimator):
    """Learns ln((1 + n) / (1 + df)) + 1 on the column tf; its model scales tf by that into idf."""

    def _fit(self, dataset: DataFrame) -> ElementwiseProduct:
        idf = IDF(inputCol="tf", outputCol="idf").fit(dataset).idf
        return ElementwiseProduct(scalingVec=Vectors.dense(idf.toArray() + 1.0), inputCol="tf", outputCol="idf")


def attribution_totals(weights: DataFrame, model: DataFrame, kept: DataFrame) -> DataFrame:
    """For each row of ``kept`` (doc_id, words_kept): the sums that push to REAL and to FAKE (both positive), and the matched terms."""
    x = weights.join(F.broadcast(model.select("term", (F.col("lp1") - F.col("lp0")).alias("coef"))), "term").withColumn("c", F.col("weight") * F.col("coef"))
    per = x.groupBy("doc_id").agg(F.sum(F.greatest("c", F.lit(0.0))).alias("to_real"), F.sum(F.greatest(-F.col("c"), F.lit(0.0))).alias("to_fake"), F.count("*").cast("long").alias("terms_matched"))
    y = kept.join(per, "doc_id", "left")
    return y.select("doc_id", "words_kept", F.coalesce("terms_matched", F.lit(0)).cast("long").alias("terms_matched"), *[F.round(F.coalesce(k, F.lit(0.0)), 6).alias(k) for k in ("to_real", "to_fake")])


def linear_pipeline(kind: str = "lr", features: int = 1 << 12, c: float = 1.0, n: int = 1):
    """TF-IDF pipeline over an array<string> column ``tokens``: lr, svm or nb."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
    from pyspark.ml.feature import CountVectorizer, Normalizer

    stages = [CountVectorizer(inputCol="tokens", outputCol="tf", vocabSize=features, minDF=2.0), SmoothIDF(), Normalizer(inputCol="idf", outputCol="features")]
    models = {
        "lr": LogisticRegression(regParam=1 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=1000),
        "svm": LinearSVC(regParam=1 / (c * max(n, 1)), maxIter=50, standardization=False),
        "nb": NaiveBayes(smoothing=1.0),
    }
    return Pipeline(stages=[*stages, models[kind]])


def forest_pipeline(columns: list[str], trees: int = 300, depth: int = 12, leaf: int = 5, seed: int = 42):
    """Random forest on stylometric columns."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)])


def stump(df: DataFrame, feature: str) -> DataFrame:
    """Majority label per value of one feature; ties go to class 0."""
    per = df.groupBy(feature).agg(F.count_if(F.expr("label = 0")).alias("_f"), F.count_if(F.expr("label = 1")).alias("_r"))
    return per.select(feature, (F.col("_r") > F.col("_f")).cast("int").alias("pred"), F.greatest("_f", "_r").cast("long").alias("hits"), (F.col("_f") + F.col("_r")).cast("long").alias("n"))


def save(model, path: str) -> None:
    """Write a fitted pipeline, replacing what is there."""
    model.write().overwrite().save(path)


def load(path: str):
    """A fitted pipeline as ``save`` wrote it; an error that names the path if there is none."""
    from pyspark.errors import AnalysisException
    from pyspark.ml import PipelineModel

    try:
        return PipelineModel.load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no model at {path}") from e


def ml_scores(train: DataFrame, test: DataFrame, pipeline, system: str) -> DataFrame:
    """(doc_id, system, label, pred, proba) of a fitted pipeline; margins pass through a sigmoid."""
    from pyspark.ml.functions import vector_to_array

    out = pipeline.fit(train).transform(test)
    margin = vector_to_array("rawPrediction")[1]
    proba = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-margin))
    return out.select("doc_id", F.lit(system).alias("system"), "label", F.col("prediction").cast("int").alias("pred"), proba.alias("proba"))


def shuffled_columns(df: DataFrame, columns: list[str], repeats: int, size: int = 1000, key: str = "doc_id") -> DataFrame:
    """``df`` once as it is (column -1) and ``repeats`` times for each column with its values dealt to other rows.

    The new columns ``column`` and ``repeat`` tell the copies apart.  Rows fall
    into random groups of about ``size`` by their key's hash, and in each the
    values move on by one row in random order: a permutation without any global
    order.
    """
    groups = max(1, -(-df.count() // size))
    copies = [(-1, 0), *((i, s) for i in range(len(columns)) for s in range(repeats))]
    x = df.select(*[c for c in df.columns if c not in columns], F.array(*columns).alias("_all"), F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.lit(s).alias("repeat")) for i, s in copies])).alias("_copy"))
    x = x.select("*", "_copy.column", "_copy.repeat").withColumn("_group", F.pmod(F.xxhash64("repeat", key), F.lit(groups)))
    w = Window.partitionBy("column", "repeat", "_group").orderBy(F.md5(F.concat_ws("-", key, "repeat")), key)
    own = F.element_at("_all", F.greatest("column", F.lit(0)) + 1)
    moved = F.coalesce(F.lead(own).over(w), F.first(own).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    x = x.withColumn("_moved", moved)
    return x.select("*", *[F.when(F.col("column") == i, F.col("_moved")).otherwise(F.col("_all")[i]).alias(c) for i, c in enumerate(columns)]).drop("_all", "_copy", "_group", "_moved")


def permutation_importance(train: DataFrame, test: DataFrame, columns: list[str], pipeline, repeats: int = 5) -> DataFrame:
    """Mean loss of accuracy when one column is shuffled; all shuffles are scored in one job."""
    model, spark = pipeline.fit(train), train.sparkSession
    hit = (F.col("prediction") == F.col("label")).cast("double")
    found = {(r["column"], r["repeat"]): r["a"] for r in model.transform(shuffled_columns(test, columns, repeats)).groupBy("column", "repeat").agg(F.avg(hit).alias("a")).collect()}
    base = found.get((-1, 0), 0.0)
    rows = [(c, round(base - sum(found.get((i, s), 0.0) for s in range(repeats)) / repeats, 6)) for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "feature string, importance double")


def parameter_effects(results: DataFrame, parameters=("features", "strength"), score: str = "cv_f1") -> DataFrame:
    """Best, worst and spread of the mean score by value; parameters with one value are left out.

    Means are taken in millionths and cut down, so that they are alike in any
    order of the rows; of values with equal means the larger text is the best,
    the smaller the worst.
    """
    long = results.select(F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value"), F.round(F.col(score) * 1e6).cast("long").alias("s")) for p in parameters])).alias("x")).select("x.*")
    mean = long.groupBy("parameter", "value").agg(F.expr("sum(s) div count(*)").alias("s"))
    order = F.struct("s", "value")
    x = mean.groupBy("parameter").agg(F.count("*").alias("n"), F.max_by("value", order).alias("best"), F.min_by("value", order).alias("worst"), F.round((F.max("s") - F.min("s")) / 1e6, 6).alias("spread"))
    return x.filter("n > 1").drop("n")

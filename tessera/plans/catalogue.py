"""All queries of the library by name, with their SQL.

``corpus`` is documents joined with labels (quality is the class); the
evaluation queries share three closed-form systems on it: the majority class,
a one-rule marker, and naive Bayes on TF-IDF weights, fitted on the training
part of a stratified split and judged on its test part.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import BOILERPLATE, CONFIDENCE_BINS, COVERAGE_BINS, LENGTH_BINS, MARKERS, STOP_WORDS
from tessera.functions import stats, text
from tessera.operators import chars, eda, evaluation, linear, logstore, models, neardup, nested, packed, predlog, quality, svd
from tessera.plans.kept import kept, written
from tessera.sources import pages
from tessera.sources.corpus import fingerprints
from tessera.sources.corpus import labelled_documents as corpus

RULE = r"(?i)\bthe\b"
#: Terms and least documents of the models' vocabulary, of words and pairs of neighbours.
FEATURES, MIN_DF = 5000, 2
# Vocabulary sizes of the ablation, growing parts of the learning curve, grid of the search.
ABLATION = [50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000]
PARTS = [0.05 + 0.95 * i / 7 for i in range(8)]
GRID = {"max_features": [5000, 20000], "ngrams": [1, 2], "min_df": [2, 5], "sublinear": [False, True], "alpha": [0.1, 1.0]}
KNOWN = [f"src{i}" for i in range(10)]
STRICT = 0.6
CUTOFF = "1995-06-17 00:00:00"
#: Columns and types that the tables of the corpus should have.
SCHEMA = {"documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}, "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"}}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "lang", F.col("source").alias("subject"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderstatus") != "F").cast("int").alias("label"))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eda.stratified_split(corpus(spark, sf_dir))


def _parts_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with split and fold; worked out once in a session."""
    return kept(spark, sf_dir, "split", lambda s, d: eda.stratified_folds(split(s, d)))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models' vocabulary: the most frequent words and pairs of the training part, numbered by term (i)."""

    def make(s: SparkSession, d: str) -> DataFrame:
        train = _parts_of(s, d).filter("split = 'train'")
        found = packed.totals(train, text.clean_tokens(F.col("content")), F.col("label"), True)
        return linear.numbered(eda.ranked_vocabulary(found, MIN_DF, FEATURES), "tf", "df", "df_fake", "df_real")

    return kept(spark, sf_dir, "vocabulary", make)


def _bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, split, fold of the corpus with arrays i and w: numbers and weights of the document's terms of the vocabulary."""

    def make(s: SparkSession, d: str) -> DataFrame:
        parts = _parts_of(s, d)
        n = parts.filter("split = 'train'").count()
        vocab = _vocabulary(s, d).orderBy("i").collect()  # at most FEATURES rows
        idf = [math.log((n + 1.0) / (r["df"] + 1.0)) + 1.0 for r in vocab]
        return packed.bags(parts, ["doc_id", "label", "split", "fold"], text.clean_tokens(F.col("content")), [r["term"] for r in vocab], True, idf)

    return kept(spark, sf_dir, "bags", make)


def _weights(spark: SparkSession, sf_dir: str):
    """Split corpus, weights of all its documents, vocabulary of the training part."""
    vocab = _vocabulary(spark, sf_dir)
    entry = F.explode(F.arrays_zip("i", "w")).alias("e")
    weights = _bags(spark, sf_dir).select("doc_id", "label", "split", "fold", entry).select("doc_id", "label", "split", "fold", "e.i", F.col("e.w").alias("weight"))
    # At most FEATURES terms.
    weights = weights.join(F.broadcast(vocab.select("i", "term")), "i").select("doc_id", "label", "term", "weight", "split", "fold")
    return _parts_of(spark, sf_dir), weights, vocab


def nb_model(spark: SparkSession, sf_dir: str):
    parts, weights, vocab = _weights(spark, sf_dir)
    return parts, weights, models.nb_fit(weights.filter("split = 'train'"), vocab)


def nb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, weights, model = nb_model(spark, sf_dir)
    sizes = {r["label"]: r["count"] for r in parts.filter("split = 'train'").groupBy("label").count().collect()}
    priors = tuple(math.log(max(sizes.get(c, 0), 1) / max(sum(sizes.values()), 1)) for c in (0, 1))
    return models.nb_predict(parts.filter("split = 'test'"), weights.filter("split = 'test'"), model, priors)


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, system, label, pred, proba) of the three systems; worked out once in a session."""
    return kept(spark, sf_dir, "scores", _eval_scores)


def _eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = _parts_of(spark, sf_dir).filter("split = 'test'").select("doc_id", "label", "content")
    rule = F.col("content").rlike(RULE).cast("int")
    fixed = test.select("doc_id", F.lit("majority").alias("system"), "label", F.lit(1).alias("pred"), F.lit(1.0).alias("proba"))
    ruled = test.select("doc_id", F.lit("rule").alias("system"), "label", rule.alias("pred"), F.when(rule == 1, 0.9).otherwise(0.1).cast("double").alias("proba"))
    nb = kept(spark, sf_dir, "nb", nb_scores).select("doc_id", F.lit("nb").alias("system"), "label", "pred", "proba")
    return fixed.unionByName(ruled).unionByName(nb)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log of the conversation turns, with a confidence made from their length."""
    c = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    scored = c.withColumn("proba", (F.length("text") % 101) / 100.0)
    rows = predlog.entries(scored, "text", "nb", F.col("role"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")))
    return predlog.resolved(rows, log_events(rows))


def log_events(rows: DataFrame) -> DataFrame:
    """Two events for every third id; the later one counts."""
    x = rows.filter("id % 3 = 0").select("id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("event_ts"))
    return x.withColumn("true_label", ((F.col("id") + F.col("event_ts")) % 2).cast("int"))


def _terms(spark: SparkSession, sf_dir: str, pairs: bool = False) -> DataFrame:
    return eda.term_table(corpus(spark, sf_dir), pairs)


def _with(f):
    return lambda spark, sf_dir: f(corpus(spark, sf_dir))


def _scores(f):
    return lambda spark, sf_dir: f(eval_scores(spark, sf_dir))


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(text.clean_tokens(F.col("content")), " ").alias("clean"))


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", *[(F.round(c, 6) if "ratio" in k or "avg" in k else c).alias(k) for k, c in text.text_stats(F.col("content")).items()])


def _count(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").cast("long").alias("n"))


def error_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", text.n_words(F.col("content")).alias("w"))
    return evaluation.rates_by(eval_scores(spark, sf_dir).join(words, "doc_id"), text.bucket(F.col("w"), LENGTH_BINS), [b for _, b in LENGTH_BINS])


def error_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = F.round(F.greatest(F.col("proba"), 1 - F.col("proba")), 6)
    return evaluation.rates_by(eval_scores(spark, sf_dir), text.bucket_upper(conf, CONFIDENCE_BINS), [b for _, b in CONFIDENCE_BINS])


def ks_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = corpus(spark, sf_dir).select(F.least(text.n_words(F.col("content")), F.lit(2000)).alias("w"), "label")
    return stats.ks_statistic(x, "w", "label").select(F.round("ks_statistic", 6).alias("ks_statistic"))


def js_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = eda.vocabulary(_terms(spark, sf_dir), 3, 20000)
    return stats.js_distance(v, "df_fake", "df_real").select(F.round("js_distance", 6).alias("js_distance"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, weights, _ = _weights(spark, sf_dir)
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def nb_log_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, model = nb_model(spark, sf_dir)
    return model.select("term", F.round("lp0", 6).alias("lp0"), F.round("lp1", 6).alias("lp1"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, matched: vocabulary terms in each test document."""
    return _bags(spark, sf_dir).filter("split = 'test'").select("doc_id", F.size("i").cast("long").alias("matched"))


def term_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = corpus(spark, sf_dir).agg(F.count_if(F.expr("label = 0")).alias("n0"), F.count_if(F.expr("label = 1")).alias("n1"))
    return eda.term_rates(_terms(spark, sf_dir), sizes)


def attribution_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, weights, model = nb_model(spark, sf_dir)
    kept = corpus(spark, sf_dir).select("doc_id", F.size(text.clean_tokens(F.col("content"))).cast("long").alias("words_kept"))
    return models.attribution_totals(weights, model, kept)


def batch_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes' verdicts on the test documents at a threshold of its own, with warnings."""
    tokens = documents(spark, sf_dir).select("doc_id", F.size(text.clean_tokens(F.col("content"))).alias("tokens"))
    scored = nb_scores(spark, sf_dir).join(coverage(spark, sf_dir), "doc_id").join(tokens, "doc_id")
    return evaluation.decide(scored, STRICT)


def error_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = eval_scores(spark, sf_dir).join(coverage(spark, sf_dir), "doc_id")
    return evaluation.rates_by(x, text.bucket(F.col("matched"), COVERAGE_BINS), [b for _, b in COVERAGE_BINS])


def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = coverage(spark, sf_dir)
    return x.agg(F.count("*").cast("long").alias("rows"), F.expr("percentile(matched, 0.5)").alias("median_matched"), F.round(F.avg((F.col("matched") < 5).cast("int")), 6).alias("low_share"))


def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", text.n_words(F.col("content")).alias("w"))
    x = evaluation.any_wrong(eval_scores(spark, sf_dir)).join(coverage(spark, sf_dir), "doc_id").join(words, "doc_id")
    return x.agg(F.round(F.corr("matched", "any_wrong"), 6).alias("matched_wrong"), F.round(F.corr("matched", "w"), 6).alias("matched_words"))


def marker_class_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = evaluation.any_wrong(eval_scores(spark, sf_dir)).join(documents(spark, sf_dir).select("doc_id", "content"), "doc_id")
    return evaluation.marker_errors(wrong, MARKERS)


def marker_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_of = documents(spark, sf_dir).select("doc_id", "content")
    return evaluation.marker_mismatch(eval_scores(spark, sf_dir).join(text_of, "doc_id"), RULE)


def style_of_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean style of wrong and right documents within each class."""
    style = text.text_stats(F.col("content"))
    x = evaluation.any_wrong(eval_scores(spark, sf_dir)).join(documents(spark, sf_dir).select("doc_id", "content"), "doc_id")
    per = x.select("label", "any_wrong", *[c.cast("double").alias(k) for k, c in style.items()]).groupBy("label").agg(*[F.avg(F.when(F.col("any_wrong") == w, F.col(k))).alias(f"{k}_{w}") for k in style for w in (0, 1)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"{k}_1").alias("w"), F.col(f"{k}_0").alias("r")) for k in style]))
    y = per.select("label", each.alias("x")).select("label", "x.*")
    return y.select("label", "feature", F.round("w", 6).alias("wrong"), F.round("r", 6).alias("right"), F.round(F.try_divide(F.col("w"), F.nullif(F.col("r"), F.lit(0.0))), 6).alias("ratio"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """TF-IDF vectors of all documents with label, split and fold, and the numbered terms."""
    return _bags(spark, sf_dir), _vocabulary(spark, sf_dir).select("term", "i")


def svm_model(spark: SparkSession, sf_dir: str) -> tuple[linear.Linear, DataFrame]:
    """The calibrated support vector machine on TF-IDF weights (C = 1), and the vectors of all documents."""
    rows, terms = _vectors(spark, sf_dir)
    return linear.calibrated_svm(rows.filter("split = 'train'"), terms), rows


def svm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = svm_model(spark, sf_dir)
    return linear.scores(rows.filter("split = 'test'"), model, "svm")


def svm_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that the support vector machine leans on most, for each class."""
    return linear.top_features(linear.feature_weights(svm_model(spark, sf_dir)[0], spark))


def svm_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest contributions of each document to the margin of the support vector machine."""
    model, _ = svm_model(spark, sf_dir)
    coefs = linear.feature_weights(model, spark).select("term", F.lit(0.0).alias("lp0"), F.col("weight").alias("lp1"))
    return models.attribution(_weights(spark, sf_dir)[1], coefs, 10)


def char_lr_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression (C = 1) on TF-IDF weights of the 30,000 most frequent character n-grams."""
    docs = _parts_of(spark, sf_dir)
    model = chars.fit(docs.filter("split = 'train'"), 30_000)
    return evaluation.confusion(chars.scores(docs.filter("split = 'test'"), model))


def lr_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression (C = 1) on the TF-IDF weights."""
    rows, terms = _vectors(spark, sf_dir)
    model = linear.fit(rows.filter("split = 'train'"), terms, "lr")
    return evaluation.confusion(linear.scores(rows.filter("split = 'test'"), model, "lr"))


def svd_model(spark: SparkSession, sf_dir: str) -> tuple[svd.SVD, DataFrame]:
    """250 components of the training part's TF-IDF weights, and the vectors of all documents."""
    rows, terms = _vectors(spark, sf_dir)
    return svd.fit(rows.filter("split = 'train'"), max(terms.count(), 1)), rows


def svd_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The singular values of the training part and the share of the variance that each explains."""
    return svd.spectrum(svd_model(spark, sf_dir)[0], spark)


def boosted_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees on those components."""
    model, rows = svd_model(spark, sf_dir)
    x = written(svd.project(rows.select("doc_id", "label", "split", "i", "w"), model), "components").withColumn("features", array_to_vector("components"))
    return evaluation.confusion(models.ml_scores(x.filter("split = 'train'"), x.filter("split = 'test'"), svd.boosted(), "boosted"))


def _style_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    style = text.text_stats(F.col("content"))
    x = written(split(spark, sf_dir).select("doc_id", "label", "split", *[c.cast("double").alias(k) for k, c in style.items()]), "style")
    return x.filter("split = 'train'"), x.filter("split = 'test'"), list(style)


def forest_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, columns = _style_parts(spark, sf_dir)
    return evaluation.confusion(models.ml_scores(train, test, models.forest_pipeline(columns), "forest"))


def style_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, columns = _style_parts(spark, sf_dir)
    return models.permutation_importance(train, test, columns, models.forest_pipeline(columns))


def stump_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.stump(corpus(spark, sf_dir).withColumn("hit", F.col("content").rlike(RULE).cast("int")), "hit")


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes, support vector machine and logistic regression on every vocabulary size, with and without publisher boilerplate."""
    views = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("content")) for k, c in enumerate((F.col("content"), text.strip_boilerplate(F.col("content"))))])).alias("v")
    docs = _parts_of(spark, sf_dir).select("doc_id", "label", (F.col("split") == "train").cast("int").alias("fold"), F.col("fold").alias("inner"), views)
    # The passes read the tokens twice; stripping is most of their cost.
    docs = written(docs.select("doc_id", "label", "fold", "inner", "v.kind", text.clean_tokens(F.col("v.content")).alias("tokens")), "ablation")
    return nested.ablation(docs, ["raw", "stripped"], ABLATION).withColumnRenamed("view", "variant")


def _folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training documents with their fold."""
    return _parts_of(spark, sf_dir).filter("split = 'train'").select("doc_id", "label", "fold")


def learning_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes on growing parts of the training documents, for each fold; the terms' weights are those of all of them."""
    _, weights, _ = _weights(spark, sf_dir)
    part = nested.part_of("doc_id", PARTS)
    return nested.learning_curve(weights.filter("split = 'train'").withColumn("part", part), _folds(spark, sf_dir).withColumn("part", part), PARTS)


def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean F1 over the folds of the training documents, for every candidate of the grid."""
    docs = _parts_of(spark, sf_dir).filter("split = 'train'")
    return nested.search_tokens(docs.select("doc_id", "label", "fold", text.clean_tokens(F.col("content")).alias("tokens")), GRID)


def file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and columns of the two tables of the corpus; no earlier run."""
    files = fingerprints(spark, f"{sf_dir}/documents.parquet").unionByName(fingerprints(spark, f"{sf_dir}/labels.parquet"))
    return quality.file_checks(files, {k: table(spark, sf_dir, k) for k in SCHEMA}, SCHEMA)


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.checks(corpus(spark, sf_dir)).unionByName(file_checks(spark, sf_dir))


def date_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of dates on the orders, whose dates are written out, one in 97 not as a date; label 1 ends a year early."""
    x = table(spark, sf_dir, "orders")
    day = F.when(F.expr("o_orderstatus = 'F'"), F.col("o_orderdate")).otherwise(F.add_months("o_orderdate", -12))
    written_out = F.when(F.col("o_orderkey") % 97 == 0, F.lit("not known")).when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "MMMM d, yyyy")).otherwise(F.date_format(day, "MMM d, yyyy"))
    return quality.date_checks(x.select((F.col("o_orderstatus") != "F").cast("int").alias("label"), written_out.alias("date")))


def log_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 entries with the label REAL since a given time."""
    return predlog.fetch(log(spark, sf_dir), label="REAL", since="2024-01-01 00:10:00").select("id", "label", "confidence", "source")


def log_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback on ids that the log does not have: events of every third turn, one id in seven off by half a million."""
    rows = log(spark, sf_dir)
    events = log_events(rows).withColumn("id", F.when(F.col("id") % 7 == 0, F.col("id") + 500_000_000).otherwise(F.col("id")))
    return logstore.unknown(events, rows)


def log_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows under ids of the log's own, after an earlier batch of 1,000."""
    rows = log(spark, sf_dir).withColumn("turn_id", F.col("id"))
    return predlog.numbered(rows, 1000).select("id", "turn_id", "label", "proba_fake", "proba_real")


def cross_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes learned on English, judged on its test part and on all documents of each other language."""
    lang = documents(spark, sf_dir).select("doc_id", "lang")
    docs = _parts_of(spark, sf_dir).join(lang, "doc_id").filter("lang is not null")
    train = (F.col("split") == "train") & (F.col("lang") == "en")
    docs = docs.select("doc_id", "label", F.lit(0).alias("kind"), train.cast("int").alias("fold"), text.clean_tokens(F.col("content")).alias("tokens"))
    scores, _ = nested.naive_bayes(docs, [nested.View("all")], [FEATURES])
    scores = scores.select("doc_id", "label", (F.col("z0") >= 0).cast("int").alias("pred"))
    return evaluation.corpus_drop(scores.join(lang, "doc_id"), "lang", "en")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "leakage_audit": _with(eda.leakage_audit),
        "class_overview": _with(eda.class_overview),
        "text_stats": text_stats,
        "clean_tokens": clean_tokens,
        "strip_boilerplate": lambda s, d: documents(s, d).select("doc_id", text.strip_boilerplate(F.col("content")).alias("stripped")),
        "style_by_class": _with(eda.style_by_class),
        "exact_duplicates": lambda s, d: eda.duplicates(documents(s, d), F.col("content")),
        "normalised_duplicates": lambda s, d: eda.duplicates(documents(s, d), text.normalise(F.col("content"))),
        "keep_first": lambda s, d: eda.keep_first(documents(s, d)),
        "cross_label_texts": _with(eda.cross_label_texts),
        "shared_openings": lambda s, d: eda.shared_openings(documents(s, d)),
        "subject_crosstab": _with(eda.subject_crosstab),
        "subject_rule": _with(eda.subject_rule),
        "null_blank_profile": lambda s, d: eda.null_profile(table(s, d, "documents"), "documents").unionByName(eda.null_profile(table(s, d, "conversations"), "conversations")),
        "encoding_profile": lambda s, d: quality.encoding_profile(table(s, d, "documents").select("text", "lang", "source"), "documents"),
        "length_checks": lambda s, d: quality.length_checks(documents(s, d)),
        "formatting_checks": lambda s, d: quality.formatting_checks(documents(s, d)),
        "class_balance": _with(quality.class_balance),
        "monthly_timeline": lambda s, d: eda.monthly_timeline(orders(s, d), "o_orderdate", F.col("label")),
        "single_class_months": lambda s, d: eda.single_class_months(orders(s, d), "o_orderdate", F.col("label")),
        "date_stump": lambda s, d: eda.date_stump(orders(s, d), "o_orderdate", F.col("label")),
        "date_window": lambda s, d: eda.outside_window(orders(s, d), "o_orderdate", F.col("label")),
        "temporal_split_counts": lambda s, d: _count(eda.temporal_split(orders(s, d), "o_orderdate", CUTOFF), "split", "label"),
        "stratified_split": lambda s, d: split(s, d).select("doc_id", "label", "split"),
        "stratified_folds": lambda s, d: eda.stratified_folds(corpus(s, d)).select("doc_id", "label", "fold"),
        "excerpts": lambda s, d: documents(s, d).select("doc_id", text.excerpt(F.col("content"), RULE).alias("excerpt")),
        "seeded_sample": lambda s, d: eda.seeded_sample(documents(s, d), 100).select("doc_id"),
        "balanced_subsample": lambda s, d: eda.balanced_subsample(corpus(s, d)).select("doc_id", "label"),
        "vocabulary_ranking": lambda s, d: eda.vocabulary(_terms(s, d), 2, 500),
        "discriminative_terms": lambda s, d: eda.discriminative_terms(_terms(s, d)),
        "discriminative_pairs": lambda s, d: eda.discriminative_terms(_terms(s, d, True)),
        "vocabulary_pairs": lambda s, d: eda.vocabulary(_terms(s, d, True), 2, 5000),
        "term_rates": term_rates,
        "vocabulary_overlap": lambda s, d: eda.vocabulary_overlap(_terms(s, d)),
        "length_histogram": _with(eda.length_histogram),
        "ks_length": ks_length,
        "js_vocabulary": js_vocabulary,
        "tfidf_weights": tfidf_weights,
        "nb_log_probs": nb_log_probs,
        "nb_predictions": lambda s, d: nb_scores(s, d),
        "linear_attribution": lambda s, d: models.attribution(*nb_model(s, d)[1:], 10),
        "attribution_totals": attribution_totals,
        "confusion_metrics": _scores(evaluation.confusion),
        "error_direction": _scores(evaluation.error_direction),
        "threshold_sweep": _scores(evaluation.threshold_sweep),
        "roc_pr_areas": _scores(evaluation.areas),
        "brier": _scores(evaluation.brier),
        "error_by_length": error_by_length,
        "error_by_confidence": error_by_confidence,
        "model_overlap": _scores(evaluation.model_overlap),
        "agreement_cells": lambda s, d: evaluation.agreement(eval_scores(s, d), "nb", "rule"),
        "mcnemar_counts": _scores(evaluation.mcnemar_counts),
        "shared_and_unique": _scores(evaluation.shared_and_unique),
        "agreement_rates": lambda s, d: evaluation.agreement_rates(eval_scores(s, d), "nb", "rule"),
        "best_threshold": lambda s, d: evaluation.best_threshold(evaluation.threshold_sweep(eval_scores(s, d))),
        "batch_verdicts": batch_verdicts,
        "unknown_subjects": lambda s, d: quality.unknown_subjects(documents(s, d), KNOWN),
        "usable_documents": lambda s, d: documents(s, d).filter(F.size(text.clean_tokens(F.col("content"))) > 0).select("doc_id"),
        "top_errors": _scores(evaluation.top_errors),
        "error_by_coverage": error_by_coverage,
        "coverage_stats": coverage_stats,
        "feature_correlation": feature_correlation,
        "marker_class_errors": marker_class_errors,
        "marker_mismatch": marker_mismatch,
        "style_of_errors": style_of_errors,
        "roc_points": lambda s, d: evaluation.curve(eval_scores(s, d)).select("system", "proba", *[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "precision")]),
        "calibration_bins": _scores(evaluation.calibration),
        "mcnemar_tests": _scores(evaluation.mcnemar_tests),
        "bootstrap_ci": _scores(evaluation.bootstrap),
        "minhash_classes": lambda s, d: neardup.classes(documents(s, d)),
        "minhash_pairs": lambda s, d: neardup.pairs(documents(s, d)),
        "html_extract": lambda s, d: pages.extract(table(s, d, "pages")),
        "lr_eval": lr_eval,
        "char_lr_eval": char_lr_eval,
        "svm_eval": lambda s, d: evaluation.confusion(svm_scores(s, d)),
        "svm_terms": svm_terms,
        "svm_attribution": svm_attribution,
        "boosted_eval": boosted_eval,
        "svd_spectrum": svd_spectrum,
        "forest_eval": forest_eval,
        "style_importance": style_importance,
        "stump_eval": stump_eval,
        "ablation": ablation,
        "learning_curve": learning_curve,
        "cross_corpus": cross_corpus,
        "grid_search": grid_search,
        "parameter_effects": lambda s, d: models.parameter_effects(grid_search(s, d), tuple(GRID)),
        "quality_checks": quality_checks,
        "quality_score": lambda s, d: quality.score(quality_checks(s, d)),
        "file_checks": file_checks,
        "log_ids": log_ids,
        "date_checks": date_checks,
        "log_fetch": log_fetch,
        "log_unknown": log_unknown,
        "log_summary": lambda s, d: predlog.summary(log(s, d)),
        "log_groups": lambda s, d: predlog.by(log(s, d)),
        "log_corrections": lambda s, d: predlog.corrections(log(s, d)).select("text", "label", "model"),
    }


# -- SQL -------------------------------------------------------------------

_W = r"'[\p{L}\p{N}_]+'"
_CORPUS = "corpus AS (SELECT d.doc_id, d.text AS content, l.quality AS label, d.source AS subject FROM documents d JOIN labels l USING (doc_id))"
_DOCS = "docs AS (SELECT doc_id, text AS content FROM documents)"


def _words(c: str = "content") -> str:
    return f"len(regexp_extract_all({c}, {_W}))"


def _norm(c: str = "content") -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"


def _clean(c: str = "content") -> str:
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(STOP_WORDS))
    t = f"lower({c})"
    for p in (r"http\S+|www\.\S+", "<.*?>", r"[^a-z\s]"):
        t = f"regexp_replace({t}, '{p}', ' ', 'g')"
    return rf"list_filter(string_split(trim(regexp_replace({t}, '\s+', ' ', 'g')), ' '), lambda w: len(w) > 2 AND NOT list_contains([{stops}], w))"


def _stripped() -> str:
    """The patterns without the one lookahead, which DuckDB's engine does not have."""
    t = "content"
    for _, p in BOILERPLATE:
        flags = "gi" if p.startswith("(?i)") else "g"
        p = p.removeprefix("(?i)").replace(r"read more:.*?(?=\s[A-Z]|$)|", "").replace("'", "''")
        t = f"regexp_replace({t}, '{p}', ' ', '{flags}')"
    return rf"regexp_replace(regexp_replace({t}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _dups(key: str) -> str:
    return f"WITH {_DOCS}, p AS (SELECT {key} AS t, count(*) AS c FROM docs GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_texts, CAST(sum(c - 1) AS BIGINT) AS extra, count(*) FILTER (c > 1) AS \"groups\" FROM p"


def _stats_sql(c: str = "content") -> dict[str, str]:
    chars, words = f"length({c})", _words(c)

    def count(p: str) -> str:
        return f"len(regexp_extract_all({c}, '{p}'))"

    def share(a: str, b: str) -> str:
        return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"

    caps = f"len(list_filter(regexp_extract_all({c}, {_W}), lambda w: regexp_full_match(w, '[A-Z]{{2,}}')))"
    return {
        "n_chars": chars, "n_words": words, "n_sentences": f"greatest({count('[.!?]')}, 1)", "avg_word_len": share(f"length(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'))", words),
        "exclamation_count": count("!"), "question_count": count(r"\?"), "quote_count": count('"'), "allcaps_words": caps, "allcaps_ratio": share(caps, words),
        "digit_ratio": share(count(r"\p{Nd}"), chars), "upper_char_ratio": share(count(r"\p{Lu}"), chars),
    }


def _split_sql() -> str:
    return f"{_CORPUS}, parts AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '-42'), doc_id) <= round(count(*) OVER (PARTITION BY label) * 0.2) THEN 'test' ELSE 'train' END AS split FROM corpus)"


def _terms_sql(source: str) -> str:
    return f"words AS (SELECT doc_id, label, unnest({_clean()}) AS term FROM {source}), terms AS (SELECT doc_id, label, term, count(*) AS tf FROM words GROUP BY ALL)"


def _pairs_sql(source: str) -> str:
    return f"kept AS (SELECT doc_id, label, {_clean()} AS w FROM {source}), words AS (SELECT doc_id, label, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM kept), terms AS (SELECT doc_id, label, term, count(*) AS tf FROM words GROUP BY ALL)"


def _ratios_sql(terms: str) -> str:
    return f"WITH {_CORPUS}, {terms}, {_vocab_sql(5, 40000)}, x AS (SELECT term, df, round(ln(((df_fake + 1) / sum(df_fake + 1) OVER ()) / ((df_real + 1) / sum(df_real + 1) OVER ())), 6) AS log_ratio FROM vocab), y AS (SELECT *, row_number() OVER (ORDER BY log_ratio DESC, term) AS a, row_number() OVER (ORDER BY log_ratio, term) AS b FROM x) SELECT CASE WHEN a <= 20 THEN 'fake' ELSE 'real' END AS side, term, log_ratio, df AS docs FROM y WHERE a <= 20 OR b <= 20"


def _vocab_sql(min_df: int, size: int, source: str = "terms") -> str:
    return f"vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df, count(*) FILTER (label = 0) AS df_fake, count(*) FILTER (label = 1) AS df_real FROM {source} GROUP BY term HAVING count(*) >= {min_df} ORDER BY 2 DESC, term LIMIT {size})"


def _nb_sql() -> str:
    return (
        f"WITH {_split_sql()}, {_pairs_sql('parts')}, trained AS (SELECT terms.* FROM terms JOIN parts USING (doc_id) WHERE split = 'train'), {_vocab_sql(MIN_DF, FEATURES, 'trained')}, "
        "ntrain AS (SELECT count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM parts WHERE split = 'train'), "
        "raw AS (SELECT t.doc_id, t.label, t.term, t.tf * (ln((n + 1.0) / (v.df + 1.0)) + 1.0) AS raw FROM terms t JOIN vocab v USING (term) CROSS JOIN ntrain), "
        "weights AS (SELECT raw.doc_id, raw.label, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY raw.doc_id)) AS weight, split FROM raw JOIN parts USING (doc_id)), "
        "per AS (SELECT v.term, coalesce(sum(weight) FILTER (label = 0), 0) AS w0, coalesce(sum(weight) FILTER (label = 1), 0) AS w1 FROM vocab v LEFT JOIN (SELECT * FROM weights WHERE split = 'train') w USING (term) GROUP BY v.term), "
        "model AS (SELECT term, ln(w0 + 1) - ln(sum(w0 + 1) OVER ()) AS lp0, ln(w1 + 1) - ln(sum(w1 + 1) OVER ()) AS lp1 FROM per), "
        "gap AS (SELECT doc_id, sum(weight * (lp1 - lp0)) AS gap FROM weights JOIN model USING (term) GROUP BY doc_id), "
        "nb AS (SELECT p.doc_id, p.label, round(1 / (1 + exp(-(coalesce(gap, 0) + ln(n1 / n) - ln(n0 / n)))), 6) AS proba FROM parts p LEFT JOIN gap USING (doc_id) CROSS JOIN ntrain WHERE split = 'test'), "
    )


def _view_terms_sql() -> str:
    """CTEs words and terms of rows (view, doc_id, label, train, content)."""
    pairs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"kept AS (SELECT view, doc_id, label, train, {_clean()} AS w FROM rows), words AS (SELECT view, doc_id, label, train, unnest({pairs}) AS term FROM kept), terms AS MATERIALIZED (SELECT view, doc_id, label, train, term, count(*) AS tf FROM words GROUP BY ALL)"


def _fits_sql(sizes: list[int], sublinear=(False,), alphas=(1.0,), min_df: str = "2") -> str:
    """CTEs up to scored (view, k, s, alpha, doc_id, label, z), from terms and docs (view, doc_id, label, train): every fit by itself."""
    values = lambda xs: ", ".join(f"({x})" for x in xs)
    return (
        f"ranked AS (SELECT view, term, count(*) AS df, row_number() OVER (PARTITION BY view ORDER BY sum(tf) DESC, term) AS rank FROM terms WHERE train GROUP BY view, term HAVING count(*) >= {min_df}), "
        f"size(k) AS (VALUES {values(sizes)}), way(s) AS (VALUES {values(sublinear)}), smooth(alpha) AS (VALUES {values(f'{a}::DOUBLE' for a in alphas)}), "
        "held AS (SELECT view, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM docs WHERE train GROUP BY view), "
        "raw AS (SELECT k, s, t.view, doc_id, label, train, t.term, (CASE WHEN s THEN ln(tf) + 1.0 ELSE tf END) * (ln((n + 1.0) / (df + 1.0)) + 1.0) AS raw FROM terms t JOIN ranked r ON r.view = t.view AND r.term = t.term JOIN held ON held.view = t.view JOIN size ON rank <= k CROSS JOIN way), "
        "weighed AS MATERIALIZED (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY k, s, view, doc_id)) AS weight FROM raw), "
        "class AS (SELECT k, s, view, term, coalesce(sum(weight) FILTER (label = 0), 0) AS w0, coalesce(sum(weight) FILTER (label = 1), 0) AS w1 FROM weighed WHERE train GROUP BY ALL), "
        "fitted AS MATERIALIZED (SELECT k, s, alpha, view, term, ln(w1 + alpha) - ln(sum(w1 + alpha) OVER p) - ln(w0 + alpha) + ln(sum(w0 + alpha) OVER p) AS d FROM class CROSS JOIN smooth WINDOW p AS (PARTITION BY k, s, alpha, view)), "
        "gaps AS (SELECT k, s, alpha, view, doc_id, sum(weight * d) AS gap FROM weighed JOIN fitted USING (k, s, view, term) WHERE NOT train GROUP BY ALL), "
        "scored AS (SELECT d.view, k, s, alpha, d.doc_id, d.label, coalesce(gap, 0) + ln(greatest(n1, 1)) - ln(greatest(n0, 1)) AS z FROM docs d JOIN held USING (view) CROSS JOIN size CROSS JOIN way CROSS JOIN smooth LEFT JOIN gaps g USING (k, s, alpha, view, doc_id) WHERE NOT d.train), "
        "fits AS (SELECT view, k, s, alpha, count(*) AS n, count(*) FILTER ((label = 1) = (z >= 0)) / count(*) AS accuracy, coalesce(2.0 * count(*) FILTER (label = 1 AND z >= 0) / nullif(count(*) FILTER (label = 1) + count(*) FILTER (z >= 0), 0), 0) AS f1 FROM scored GROUP BY ALL)"
    )


def _machines_sql(steps: int = 5000, bends: int = 2000) -> str:
    """CTEs up to sides (view, k, model, doc_id, label, z), from weighed, docs and folded: every support vector machine (m is the fold that it leaves out) and logistic regression (m = 3) by itself.

    Weights are sums over the training documents, so a model is a number for
    each of them (a; p before), found from all inner products by accelerated
    descent; b is the intercept of the regression, the machines have it within.
    A sigmoid's two numbers are found by steps that bound the curvature.
    """
    return (
        "trn AS MATERIALIZED (SELECT d.view, d.doc_id, row_number() OVER (PARTITION BY d.view ORDER BY d.doc_id) AS nth, count(*) OVER (PARTITION BY d.view) AS n, f.fold FROM docs d JOIN folded f USING (doc_id) WHERE d.train), "
        "dots AS MATERIALIZED (SELECT a.view, a.k, a.doc_id, b.doc_id AS other, sum(a.weight * b.weight) AS dot FROM weighed a JOIN weighed b ON a.view = b.view AND a.k = b.k AND a.term = b.term WHERE b.train GROUP BY ALL), "
        "kern AS MATERIALIZED (SELECT d.view, size.k, d.doc_id, any_value(d.label) AS label, any_value(d.train) AS train, any_value(o.nth) AS nth, any_value(o.fold) AS fold, list(coalesce(dot, 0.0::DOUBLE) ORDER BY t.nth) AS row FROM docs d JOIN trn t ON t.view = d.view CROSS JOIN size LEFT JOIN trn o ON o.view = d.view AND o.doc_id = d.doc_id LEFT JOIN dots g ON g.view = d.view AND g.k = size.k AND g.doc_id = d.doc_id AND g.other = t.doc_id GROUP BY d.view, size.k, d.doc_id), "
        "model(m) AS (VALUES (0), (1), (2), (3)), "
        "rate AS MATERIALIZED (SELECT view, k, m, n, 1 + (CASE WHEN m < 3 THEN 2.0 ELSE 0.25 END) * top AS l FROM (SELECT view, k, len(any_value(row)) AS n, max(list_sum(row)) + len(any_value(row)) AS top FROM kern WHERE train GROUP BY view, k) CROSS JOIN model), "
        "fit(view, k, m, it, a, p, b, q) USING KEY (view, k, m) AS (SELECT view, k, m, 0, list_transform(range(n), lambda i: 0.0::DOUBLE), list_transform(range(n), lambda i: 0.0::DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM rate UNION ALL ("
        "WITH ahead AS (SELECT f.view, f.k, m, it, l, a, b, list_transform(list_zip(a, p), lambda x: x[1] + (sqrt(l) - 1) / (sqrt(l) + 1) * (x[1] - x[2])) AS v, b + (sqrt(l) - 1) / (sqrt(l) + 1) * (b - q) AS c FROM fit f JOIN rate USING (view, k, m) WHERE it < " + str(steps) + " AND (it < 9 OR greatest(abs(b - q), list_max(list_transform(list_zip(a, p), lambda x: abs(x[1] - x[2])))) > 1e-9)), "
        "far AS (SELECT h.*, x.nth, x.fold, 2 * x.label - 1 AS y, list_dot_product(x.row, v) + CASE WHEN m < 3 THEN list_sum(v) ELSE c END AS z FROM ahead h JOIN kern x ON x.view = h.view AND x.k = h.k AND x.train), "
        "slope AS (SELECT *, y * CASE WHEN fold = m THEN 0.0 WHEN m < 3 THEN -2 * greatest(0, 1 - y * z) ELSE -1 / (1 + exp(y * z)) END AS g FROM far) "
        "SELECT view, k, m, any_value(it) + 1, list(v[nth] - (v[nth] + g) / l ORDER BY nth), any_value(a), any_value(c) - CASE WHEN m = 3 THEN sum(g) / any_value(l) ELSE 0.0 END, any_value(b) FROM slope GROUP BY view, k, m)), "
        "outs AS MATERIALIZED (SELECT x.view, x.k, m, x.doc_id, label, train, fold, list_dot_product(row, a) + CASE WHEN m < 3 THEN list_sum(a) ELSE b END AS z FROM kern x JOIN fit f ON f.view = x.view AND f.k = x.k), "
        "left_out AS MATERIALIZED (SELECT view, k, m, z, CASE WHEN label = 1 THEN (p + 1.0) / (p + 2.0) ELSE 1.0 / (r + 2.0) END AS t FROM (SELECT *, sum(label) OVER w AS p, sum(1 - label) OVER w AS r FROM outs WHERE train AND fold = m WINDOW w AS (PARTITION BY view, k, m))), "
        "bound AS MATERIALIZED (SELECT view, k, m, sum(z * z) / 4 + 1e-12 AS zz, sum(z) / 4 AS z, count(*) / 4.0 + 1e-12 AS n, ln((count(*) FILTER (t < 0.5) + 1.0) / (count(*) FILTER (t >= 0.5) + 1.0)) AS start FROM left_out GROUP BY view, k, m), "
        "bent(view, k, m, it, a, b, d) USING KEY (view, k, m) AS (SELECT view, k, m, 0, 0.0::DOUBLE, start::DOUBLE, 1.0::DOUBLE FROM bound UNION ALL ("
        "WITH gap AS (SELECT c.view, c.k, c.m, it, c.a, c.b, t - 1 / (1 + exp(c.a * o.z + c.b)) AS g, o.z FROM bent c JOIN left_out o ON o.view = c.view AND o.k = c.k AND o.m = c.m WHERE it < " + str(bends) + " AND d > 1e-10), "
        "sums AS (SELECT view, k, m, any_value(it) AS it, any_value(a) AS a, any_value(b) AS b, sum(g * z) AS ga, sum(g) AS gb FROM gap GROUP BY view, k, m), "
        "steps AS (SELECT view, k, m, it, a, b, (n * ga - z * gb) / (zz * n - z * z) AS da, (zz * gb - z * ga) / (zz * n - z * z) AS db FROM sums JOIN bound USING (view, k, m)) "
        "SELECT view, k, m, it + 1, a - da, b - db, greatest(abs(da), abs(db)) FROM steps)), "
        "sides AS (SELECT o.view, o.k, 'svm' AS model, doc_id, label, avg(1 / (1 + exp(a * z + b))) - 0.5 AS z FROM outs o JOIN bent c ON c.view = o.view AND c.k = o.k AND c.m = o.m WHERE NOT train GROUP BY o.view, o.k, doc_id, label UNION ALL SELECT view, k, 'lr', doc_id, label, z FROM outs WHERE NOT train AND m = 3)"
    )


def _ablation_sql() -> str:
    rows = f"rows AS (SELECT 'raw' AS view, doc_id, label, split = 'train' AS train, content FROM parts UNION ALL SELECT 'stripped', doc_id, label, split = 'train', {_stripped()} FROM parts)"
    judged = "SELECT view, k, model, count(*) FILTER ((label = 1) = (z >= 0)) / count(*) AS accuracy, coalesce(2.0 * count(*) FILTER (label = 1 AND z >= 0) / nullif(count(*) FILTER (label = 1) + count(*) FILTER (z >= 0), 0), 0) AS f1 FROM sides GROUP BY ALL"
    every = f"every AS (SELECT view, k, 'nb' AS model, accuracy, f1 FROM fits UNION ALL {judged})"
    return f"WITH RECURSIVE {_split_sql()}, {_FOLDS}, {rows}, docs AS (SELECT view, doc_id, label, train FROM rows), {_view_terms_sql()}, {_fits_sql(ABLATION)}, {_machines_sql()}, {every}, there AS (SELECT view, least(count(*), {max(ABLATION)}) AS there FROM ranked GROUP BY view) SELECT view AS variant, model, CAST(k AS INTEGER) AS max_features, CAST(least(there, k) AS INTEGER) AS n_features, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM every JOIN there USING (view)"


def _cross_sql() -> str:
    rows = "rows AS (SELECT 'all' AS view, p.doc_id, label, split = 'train' AND lang = 'en' AS train, content, lang FROM parts p JOIN documents d USING (doc_id) WHERE lang IS NOT NULL)"
    last = "c AS (SELECT lang AS corpus, count(*) AS n, count(*) FILTER ((scored.label = 1) = (z >= 0)) / count(*) AS accuracy, coalesce(2.0 * count(*) FILTER (scored.label = 1 AND z >= 0) / nullif(count(*) FILTER (scored.label = 1) + count(*) FILTER (z >= 0), 0), 0) AS f1 FROM scored JOIN rows USING (doc_id) GROUP BY lang), r AS (SELECT corpus, n, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1 FROM c)"
    home = "(SELECT {0} FROM r WHERE corpus = 'en')"
    drops = ", ".join(f"round({home.format(c)} - {c}, 6) AS {c}_drop" for c in ("accuracy", "f1"))
    return f"WITH {_split_sql()}, {rows}, docs AS (SELECT view, doc_id, label, train FROM rows), {_view_terms_sql()}, {_fits_sql([FEATURES])}, {last} SELECT corpus, n, accuracy, f1, {drops} FROM r"


def _shingled_sql() -> str:
    """CTE classes (doc_id, class_id, n, s): texts with the same 5-word shingles, and these in order."""
    grams = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END"
    return f"tokens AS (SELECT doc_id, list_filter(string_split({_norm('text')}, ' '), lambda x: x <> '') AS w FROM documents), grams AS (SELECT doc_id, {grams} AS s FROM tokens), classes AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS class_id, count(*) OVER (PARTITION BY s) AS n, s FROM grams)"


def _near_sql() -> str:
    one = "reps AS (SELECT doc_id, n, len(s) AS k, s FROM classes WHERE doc_id = class_id), each AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM reps), shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM each x JOIN each y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)"
    return f"WITH {_shingled_sql()}, {one} SELECT a, b, p.n AS n_a, q.n AS n_b, c / (p.k + q.k - c) AS similarity FROM shared JOIN reps p ON p.doc_id = a JOIN reps q ON q.doc_id = b WHERE c / (p.k + q.k - c) >= {neardup.SIMILARITY}"


_FOLDS = "folded AS (SELECT p.doc_id, p.label, f.fold FROM parts p JOIN (SELECT doc_id, (row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '-42'), doc_id) - 1) % 3 AS fold FROM corpus) f USING (doc_id) WHERE split = 'train')"


def _search_sql() -> str:
    """Up to the table found: the parameters and cv_f1 of every candidate."""
    views = ", ".join(f"({g}, {d})" for g in GRID["ngrams"] for d in GRID["min_df"])
    named = "held || '-' || ngrams || '-' || min_df AS view"
    pairs = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    base = f"toks AS (SELECT f.doc_id, f.label, fold, {_clean('p.content')} AS w FROM folded f JOIN parts p USING (doc_id)), single AS MATERIALIZED (SELECT doc_id, label, fold, term, count(*) AS tf FROM (SELECT doc_id, label, fold, unnest({pairs}) AS term FROM toks) GROUP BY ALL)"
    kinds = f"kind AS (SELECT * FROM range(3) AS h(held) CROSS JOIN (VALUES {views}) AS v(ngrams, min_df))"
    terms = f"terms AS MATERIALIZED (SELECT {named}, doc_id, label, fold <> held AS train, term, tf FROM single JOIN kind ON len(string_split(term, ' ')) <= ngrams)"
    docs = f"docs AS (SELECT {named}, doc_id, label, fold <> held AS train FROM folded CROSS JOIN kind)"
    fits = _fits_sql(GRID["max_features"], GRID["sublinear"], GRID["alpha"], "CAST(split_part(view, '-', 3) AS INTEGER)")
    found = "found AS (SELECT 'nb' AS model, CAST(k AS INTEGER) AS max_features, CAST(split_part(view, '-', 2) AS INTEGER) AS ngrams, CAST(split_part(view, '-', 3) AS INTEGER) AS min_df, s AS sublinear, alpha, round(avg(f1), 6) AS cv_f1 FROM fits GROUP BY ALL)"
    return f"WITH {_split_sql()}, {_FOLDS}, {base}, {kinds}, {terms}, {docs}, {fits}, {found}"


def _effects_sql() -> str:
    # Values as Spark writes them: true, false, 0.1, 1.0.
    long = " UNION ALL ".join(f"SELECT '{c}' AS parameter, CAST({c} AS VARCHAR) AS value, CAST(round(cv_f1 * 1000000) AS BIGINT) AS s FROM found" for c in GRID)
    return _search_sql() + f", long AS ({long}), mean AS (SELECT parameter, value, sum(s)::BIGINT // count(*) AS s FROM long GROUP BY ALL) SELECT parameter, first(value ORDER BY s DESC, value DESC) AS best, first(value ORDER BY s, value) AS worst, round((max(s) - min(s)) / 1000000.0, 6) AS spread FROM mean GROUP BY parameter HAVING count(*) > 1"


def _curve_sql() -> str:
    place = "(('0x' || left(md5(doc_id || '-part-42'), 8))::UBIGINT) / 4294967296.0"
    part = "CASE " + " ".join(f"WHEN {place} < {p!r}::DOUBLE THEN {i}" for i, p in enumerate(PARTS[:-1])) + f" ELSE {len(PARTS) - 1} END"
    shares = ", ".join(f"({i}, {round(p, 6)}::DOUBLE)" for i, p in enumerate(PARTS))
    return _nb_sql() + (
        f"{_FOLDS}, d AS (SELECT *, {part} AS part FROM folded), fit(f) AS (VALUES (0), (1), (2)), share(p, train_share) AS (VALUES {shares}), "
        "x AS MATERIALIZED (SELECT f, p, d.doc_id, d.label, fold <> f AND part <= p AS learns, fold = f AS judged, term, weight FROM d JOIN weights w ON w.doc_id = d.doc_id CROSS JOIN fit CROSS JOIN share), "
        "c AS (SELECT f, p, term, coalesce(sum(weight) FILTER (learns AND label = 0), 0) AS w0, coalesce(sum(weight) FILTER (learns AND label = 1), 0) AS w1 FROM x GROUP BY ALL), "
        "m AS MATERIALIZED (SELECT f, p, term, ln(w1 + 1) - ln(sum(w1 + 1) OVER o) - ln(w0 + 1) + ln(sum(w0 + 1) OVER o) AS d FROM c WINDOW o AS (PARTITION BY f, p)), "
        "g AS (SELECT f, p, doc_id, sum(weight * d) AS gap FROM x JOIN m USING (f, p, term) GROUP BY ALL), "
        "e AS (SELECT f, p, d.doc_id, label, fold <> f AND part <= p AS learns, fold = f AS judged FROM d CROSS JOIN fit CROSS JOIN share), "
        "k AS (SELECT f, p, greatest(count(*) FILTER (learns AND label = 0), 1) AS n0, greatest(count(*) FILTER (learns AND label = 1), 1) AS n1, count(*) FILTER (learns) AS n_train FROM e GROUP BY ALL), "
        "z AS (SELECT e.*, n_train, coalesce(gap, 0) + ln(n1) - ln(n0) >= 0 AS up FROM e JOIN k USING (f, p) LEFT JOIN g USING (f, p, doc_id)) "
        "SELECT train_share, CAST(f AS INTEGER) AS fold, n_train, "
        + ", ".join(f"round(coalesce(2.0 * count(*) FILTER ({side} AND label = 1 AND up) / nullif(count(*) FILTER ({side} AND label = 1) + count(*) FILTER ({side} AND up), 0), 0), 6) AS {name}_f1" for side, name in (("learns", "train"), ("judged", "validation")))
        + " FROM z JOIN share USING (p) GROUP BY train_share, f, n_train"
    )


def _eval_sql() -> str:
    return _nb_sql() + (
        "scores AS (SELECT doc_id, 'majority' AS system, label, 1 AS pred, 1.0::DOUBLE AS proba FROM parts WHERE split = 'test' "
        rf"UNION ALL SELECT doc_id, 'rule', label, CAST(regexp_matches(content, '{RULE}') AS INTEGER), CASE WHEN regexp_matches(content, '{RULE}') THEN 0.9 ELSE 0.1 END::DOUBLE FROM parts WHERE split = 'test' "
        "UNION ALL SELECT doc_id, 'nb', label, CAST(proba >= 0.5 AS INTEGER), proba FROM nb)"
    )


def _rate_sql(cte: str, labels: list[str]) -> str:
    dim = ", ".join(f"({i}, '{b}')" for i, b in enumerate(labels))
    return f"{cte}, rates AS (SELECT system, bucket, count(*) AS n, CAST(sum(CAST(label <> pred AS INTEGER)) AS BIGINT) AS errors FROM b GROUP BY ALL), dim(bucket_ord, bucket) AS (VALUES {dim}) SELECT s.system, CAST(dim.bucket_ord AS INTEGER) AS bucket_ord, dim.bucket, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors, round(CAST(errors AS DOUBLE) / n, 6) AS error_rate FROM (SELECT DISTINCT system FROM scores) s CROSS JOIN dim LEFT JOIN rates ON rates.system = s.system AND rates.bucket = dim.bucket"


def _case(col: str, bins, upper: bool = False) -> str:
    order = bins if upper else list(reversed(bins))
    return "CASE " + " ".join(f"WHEN {col} {'<=' if upper else '>='} {e} THEN '{b}'" for e, b in order) + " END"


_COVERAGE = "cov AS (SELECT p.doc_id, count(w.term) AS matched FROM parts p LEFT JOIN weights w ON w.doc_id = p.doc_id WHERE p.split = 'test' GROUP BY p.doc_id)"
_WRONG = "wrong AS (SELECT doc_id, min(label) AS label, max(CAST(label <> pred AS INTEGER)) AS any_wrong FROM scores GROUP BY doc_id)"
_LOG = """
    WITH base AS (SELECT conv_id * 1000 + turn AS id, text, role AS source, 'nb' AS model, (length(text) % 101) / 100.0::DOUBLE AS p, make_timestamp((1704067200 + conv_id * 1000 + turn) * 1000000) AS created_at FROM conversations),
    log AS (SELECT id, created_at, source, model, sha256(text) AS input_hash, left(text, 500) AS text_preview, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction, CASE WHEN p >= 0.5 THEN 'REAL' ELSE 'FAKE' END AS label,
            round(greatest(p, 1 - p), 6) AS confidence, CASE WHEN id % 3 = 0 THEN CAST((id + 1) % 2 AS INTEGER) END AS true_label FROM base)
"""


def _dates_sql() -> str:
    limit = lambda k, v: f"CASE WHEN {v} >= {quality.THRESHOLDS[k][1]} THEN 'FAIL' WHEN {v} > {quality.THRESHOLDS[k][0]} THEN 'WARN' ELSE 'PASS' END"
    js = "round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6)"
    return (
        "WITH x AS (SELECT CAST(o_orderstatus <> 'F' AS INTEGER) AS label, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) ELSE CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) END AS d FROM orders), "
        "span AS (SELECT greatest(min(d) FILTER (label = 0), min(d) FILTER (label = 1)) AS lo, least(max(d) FILTER (label = 0), max(d) FILTER (label = 1)) AS hi FROM x), "
        "v AS (SELECT round(count(*) FILTER (d IS NULL) / count(*), 6) AS v FROM x), "
        "o AS (SELECT count(*) AS n, count(*) FILTER (d NOT BETWEEN lo AND hi) AS k, count(*) FILTER (d NOT BETWEEN lo AND hi AND label = 0) AS f FROM x CROSS JOIN span), "
        "m AS (SELECT strftime(d, '%Y-%m') AS month, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM x WHERE d IS NOT NULL GROUP BY 1), "
        "s AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q, a, b FROM m), "
        f"j AS (SELECT {js} AS js, round(count(*) FILTER (a = 0 OR b = 0) / count(*), 6) AS single FROM s) "
        f"SELECT 'validity.dates' AS check_id, 1.0::DOUBLE AS weight, v AS value, {limit('unparseable_date_rate', 'v')} AS status FROM v "
        "UNION ALL SELECT 'consistency.date_label', 1.5, round(k / n, 6), CASE WHEN coalesce(f / nullif(k, 0), 0) > 0.99 THEN 'FAIL' WHEN k > 0 THEN 'WARN' ELSE 'PASS' END FROM o "
        f"UNION ALL SELECT 'drift.dates', 1.5, js, CASE WHEN 'FAIL' IN ({limit('js_distance', 'js')}, {limit('single_class_month', 'single')}) THEN 'FAIL' WHEN 'WARN' IN ({limit('js_distance', 'js')}, {limit('single_class_month', 'single')}) THEN 'WARN' ELSE 'PASS' END FROM j"
    )


def oracle_sql() -> dict[str, str]:
    style, docs_stats = _stats_sql(), _stats_sql()
    audit = " UNION ALL ".join(f"SELECT '{m.replace(chr(39), chr(39) * 2)}' AS marker, count(*) FILTER (label = 0 AND regexp_matches(content, '(?m){p}')) AS h0, count(*) FILTER (label = 1 AND regexp_matches(content, '(?m){p}')) AS h1, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM corpus" for m, p in ((m, p.replace(chr(39), chr(39) * 2)) for m, p in MARKERS.items()))
    enc = {"replacement": "�", "mojibake": quality.HARD[1], "control": quality.SOFT[0], "invisible": quality.SOFT[1], "non_ascii": r"[^\x00-\x7f]"}
    nulls = " UNION ALL ".join(rf"SELECT '{t}' AS table_name, count(*) AS rows, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER (regexp_replace({c}, '\s', '', 'g') = '') AS blanks FROM {t}" for t, cs in (("documents", ("text", "lang", "source")), ("conversations", ("role", "text"))) for c in cs)
    dates = "o AS (SELECT o_orderdate AS d, CAST(o_orderstatus <> 'F' AS INTEGER) AS label FROM orders)"
    conf = "round(greatest(proba, 1 - proba), 6)"
    cm = "c AS (SELECT system, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM scores GROUP BY system)"
    wide = "wide AS (SELECT doc_id, coalesce(list_sort(list(system) FILTER (label <> pred)), []) AS wrong FROM scores GROUP BY doc_id)"
    points = "points AS (SELECT system, proba, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM scores GROUP BY ALL), run AS (SELECT *, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(q) OVER w AS DOUBLE) AS fp, sum(p) OVER (PARTITION BY system) AS np, sum(q) OVER (PARTITION BY system) AS nq FROM points WINDOW w AS (PARTITION BY system ORDER BY proba DESC ROWS UNBOUNDED PRECEDING)), curve AS (SELECT system, proba, coalesce(fp / nullif(nq, 0), 0) AS fpr, coalesce(tp / nullif(np, 0), 0) AS tpr, coalesce(tp / nullif(tp + fp, 0), 0) AS precision FROM run)"
    return {
        "leakage_audit": f"WITH {_CORPUS}, h AS ({audit}), r AS (SELECT *, coalesce(h0 / nullif(n0, 0), 0) AS f, coalesce(h1 / nullif(n1, 0), 0) AS r FROM h) SELECT marker, round(f, 6) AS fake_rate, round(r, 6) AS real_rate, round(abs(r - f), 6) AS gap, round((CASE WHEN r >= f THEN h1 + n0 - h0 ELSE h0 + n1 - h1 END) / (n0 + n1), 6) AS one_rule_accuracy FROM r",
        "class_overview": f"WITH {_CORPUS}, w AS (SELECT label, {_words()} AS w FROM corpus) SELECT label, count(*) AS articles, CAST(quantile_cont(w, 0.5) AS DOUBLE) AS median_words, round(avg(w), 6) AS mean_words, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM w GROUP BY label",
        "text_stats": f"WITH {_DOCS} SELECT doc_id, " + ", ".join(f"round({v}, 6) AS {k}" if "ratio" in k or "avg" in k else f"CAST({v} AS BIGINT) AS {k}" for k, v in docs_stats.items()) + " FROM docs",
        "clean_tokens": f"WITH {_DOCS} SELECT doc_id, array_to_string({_clean()}, ' ') AS clean FROM docs",
        "strip_boilerplate": f"WITH {_DOCS} SELECT doc_id, " + _stripped() + " AS stripped FROM docs",
        "style_by_class": f"WITH {_CORPUS}, s AS (SELECT label, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in style.items()) + " FROM corpus), a AS (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, avg({k}) FILTER (label = 0) AS f, avg({k}) FILTER (label = 1) AS r FROM s" for k in style) + ") SELECT feature, round(f, 6) AS fake, round(r, 6) AS real, round(f / nullif(r, 0), 6) AS ratio FROM a",
        "exact_duplicates": _dups("content"),
        "normalised_duplicates": _dups(_norm()),
        "keep_first": f"WITH {_DOCS} SELECT min(doc_id) AS doc_id FROM docs GROUP BY content",
        "cross_label_texts": f"WITH {_CORPUS}, p AS (SELECT content, min(label) AS a, max(label) AS b, count(*) AS c FROM corpus GROUP BY content) SELECT count(*) AS texts, CAST(coalesce(sum(c), 0) AS BIGINT) AS rows FROM p WHERE a <> b",
        "shared_openings": f"WITH {_DOCS}, x AS (SELECT count(*) AS c, count(DISTINCT substring({_norm()}, 1, 120)) AS o, count(DISTINCT content) AS d FROM docs) SELECT greatest(d - o, 0) AS repeats, round(greatest(d - o, 0) / c, 6) AS rate FROM x",
        "subject_crosstab": f"WITH {_CORPUS} SELECT subject, count(*) FILTER (label = 0) AS fake, count(*) FILTER (label = 1) AS real, CASE WHEN count(*) FILTER (label = 1) = 0 THEN 'fake only' WHEN count(*) FILTER (label = 0) = 0 THEN 'real only' ELSE 'mixed' END AS kind FROM corpus GROUP BY subject",
        "subject_rule": f"WITH {_CORPUS}, s AS (SELECT subject, count(*) FILTER (label = 0) AS f, count(*) FILTER (label = 1) AS r FROM corpus GROUP BY subject) SELECT count(*) AS subjects, count(*) FILTER (f = 0 OR r = 0) AS exclusive, round(count(*) FILTER (f = 0 OR r = 0) / count(*), 6) AS purity, round(sum(greatest(f, r)) / sum(f + r), 6) AS rule_accuracy FROM s",
        "null_blank_profile": nulls,
        "encoding_profile": " UNION ALL ".join(f"SELECT 'documents' AS table_name, '{c}' AS column_name, " + ", ".join(f"count(*) FILTER (regexp_matches({c}, '{p}')) AS {k}" for k, p in enc.items()) + " FROM documents" for c in ("text", "lang", "source")),
        "length_checks": f"WITH w AS (SELECT {_words('text')} AS w FROM documents) SELECT count(*) AS rows, count(*) FILTER (w < 20) AS short, count(*) FILTER (w > 6000) AS long_rows, min(w) AS min_words, CAST(quantile_cont(w, 0.5) AS DOUBLE) AS median_words, max(w) AS max_words, round(count(*) FILTER (w < 20) / count(*), 6) AS short_rate FROM w",
        "formatting_checks": r"WITH x AS (SELECT len(regexp_extract_all(text, '\p{Lu}')) / nullif(length(text), 0) AS u, len(regexp_extract_all(text, '[A-Za-z]')) / nullif(length(text), 0) AS l FROM documents) SELECT count(*) AS rows, count(*) FILTER (coalesce(u, 0) > 0.6) AS shouting, count(*) FILTER (coalesce(l, 0) < 0.5) AS few_letters, round((count(*) FILTER (coalesce(u, 0) > 0.6) + count(*) FILTER (coalesce(l, 0) < 0.5)) / count(*), 6) AS rate FROM x",
        "class_balance": f"WITH {_CORPUS}, x AS (SELECT count(*) FILTER (label = 0) AS fake, count(*) FILTER (label = 1) AS real FROM corpus), y AS (SELECT *, least(fake, real) / (fake + real) AS m FROM x) SELECT fake, real, round(m, 6) AS minority, CASE WHEN m > 0.35 THEN 'PASS' WHEN m > 0.2 THEN 'WARN' ELSE 'FAIL' END AS status FROM y",
        "monthly_timeline": f"WITH {dates} SELECT strftime(d, '%Y-%m') AS month, count(*) FILTER (label = 0) AS fake, count(*) FILTER (label = 1) AS real FROM o GROUP BY 1",
        "single_class_months": f"WITH {dates}, m AS (SELECT strftime(d, '%Y-%m') AS month, count(*) FILTER (label = 0) AS fake, count(*) FILTER (label = 1) AS real FROM o GROUP BY 1) SELECT count(*) AS months, count(*) FILTER (fake = 0 OR real = 0) AS single, CAST(coalesce(sum(fake + real) FILTER (fake = 0 OR real = 0), 0) AS BIGINT) AS rows, round(coalesce(count(*) FILTER (fake = 0 OR real = 0) / nullif(count(*), 0), 0), 6) AS share FROM m",
        "date_stump": f"WITH {dates}, p AS (SELECT d, count(*) FILTER (label = 0) AS f, count(*) FILTER (label = 1) AS r FROM o GROUP BY d), x AS (SELECT d, coalesce(sum(f) OVER b, 0) AS fb, coalesce(sum(r) OVER b, 0) AS rb, sum(f) OVER () AS fn, sum(r) OVER () AS rn FROM p WINDOW b AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), y AS (SELECT d, 0 AS o, 'fake first' AS direction, fb + rn - rb AS hits, fn + rn AS total FROM x UNION ALL SELECT d, 1, 'real first', rb + fn - fb, fn + rn FROM x) SELECT strftime(d, '%Y-%m-%d') AS cutoff, direction, round(hits / total, 6) AS accuracy FROM y ORDER BY hits DESC, o, d LIMIT 1",
        "date_window": f"WITH {dates}, s AS (SELECT min(d) FILTER (label = 0) AS lo0, max(d) FILTER (label = 0) AS hi0, min(d) FILTER (label = 1) AS lo1, max(d) FILTER (label = 1) AS hi1 FROM o) SELECT label, count(*) AS rows, count(*) FILTER (CASE WHEN label = 0 THEN NOT d BETWEEN lo1 AND hi1 ELSE NOT d BETWEEN lo0 AND hi0 END) AS outside FROM o CROSS JOIN s GROUP BY label",
        "temporal_split_counts": f"WITH {dates} SELECT CASE WHEN d < TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS split, label, count(*) AS n FROM o GROUP BY ALL",
        "stratified_split": f"WITH {_split_sql()} SELECT doc_id, label, split FROM parts",
        "stratified_folds": f"WITH {_CORPUS} SELECT doc_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '-42'), doc_id) - 1) % 3 AS INTEGER) AS fold FROM corpus",
        "excerpts": f"WITH {_DOCS}, t AS (SELECT doc_id, regexp_replace(coalesce(content, ''), '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g') AS t FROM docs), p AS (SELECT doc_id, t, greatest(length(regexp_extract(t, '(?s)^(.*?)(?:{RULE})', 1)) - 110, 0) AS s FROM t) SELECT doc_id, CASE WHEN s > 0 THEN '...' ELSE '' END || substring(t, CAST(s + 1 AS BIGINT), 220) || '...' AS excerpt FROM p",
        "seeded_sample": "SELECT doc_id FROM documents ORDER BY md5(doc_id || '-42'), doc_id LIMIT 100",
        "balanced_subsample": f"WITH {_CORPUS}, x AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || '-42'), doc_id) AS k FROM corpus) SELECT doc_id, label FROM x WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM corpus GROUP BY label))",
        "vocabulary_ranking": f"WITH {_CORPUS}, {_terms_sql('corpus')}, {_vocab_sql(2, 500)} SELECT * FROM vocab",
        "discriminative_terms": _ratios_sql(_terms_sql("corpus")),
        "discriminative_pairs": _ratios_sql(_pairs_sql("corpus")),
        "vocabulary_pairs": f"WITH {_CORPUS}, {_pairs_sql('corpus')}, {_vocab_sql(2, 5000)} SELECT * FROM vocab",
        "term_rates": f"WITH {_CORPUS}, {_terms_sql('corpus')}, {_vocab_sql(2, 500)}, s AS (SELECT count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM corpus) SELECT CAST(row_number() OVER (ORDER BY tf DESC, term) AS INTEGER) AS rank, term, tf, round(coalesce(df_fake / nullif(n0, 0), 0), 6) AS fake_rate, round(coalesce(df_real / nullif(n1, 0), 0), 6) AS real_rate, round(abs(coalesce(df_real / nullif(n1, 0), 0) - coalesce(df_fake / nullif(n0, 0), 0)), 6) AS gap FROM vocab CROSS JOIN s",
        "vocabulary_overlap": f"WITH {_CORPUS}, {_terms_sql('corpus')}, p AS (SELECT term, max(CAST(label = 0 AS INTEGER)) AS f, max(CAST(label = 1 AS INTEGER)) AS r FROM terms GROUP BY term) SELECT CAST(sum(f) AS BIGINT) AS fake_terms, CAST(sum(r) AS BIGINT) AS real_terms, count(*) FILTER (f = 1 AND r = 1) AS shared, round(count(*) FILTER (f = 1 AND r = 1) / count(*), 6) AS jaccard FROM p",
        "length_histogram": f"WITH {_CORPUS}, w AS (SELECT least({_words()}, 2000) AS w, label FROM corpus), s AS (SELECT min(w) AS lo, max(w) AS hi FROM w) SELECT CAST(least(floor((w - lo) * 60 / greatest(hi - lo, 1)), 59) AS INTEGER) AS bin, count(*) FILTER (label = 0) AS fake, count(*) FILTER (label = 1) AS real FROM w CROSS JOIN s GROUP BY 1",
        "ks_length": f"WITH {_CORPUS}, w AS (SELECT least({_words()}, 2000) AS w, label FROM corpus), p AS (SELECT w, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM w GROUP BY w), g AS (SELECT abs(sum(a) OVER (ORDER BY w ROWS UNBOUNDED PRECEDING) / sum(a) OVER () - sum(b) OVER (ORDER BY w ROWS UNBOUNDED PRECEDING) / sum(b) OVER ()) AS gap FROM p) SELECT round(max(gap), 6) AS ks_statistic FROM g",
        "js_vocabulary": f"WITH {_CORPUS}, {_terms_sql('corpus')}, {_vocab_sql(3, 20000)}, x AS (SELECT df_fake / sum(df_fake) OVER () AS p, df_real / sum(df_real) OVER () AS q FROM vocab) SELECT round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS js_distance FROM x",
        "tfidf_weights": _nb_sql() + "done AS (SELECT 1) SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
        "nb_log_probs": _nb_sql() + "done AS (SELECT 1) SELECT term, round(lp0, 6) AS lp0, round(lp1, 6) AS lp1 FROM model",
        "nb_predictions": _nb_sql() + "done AS (SELECT 1) SELECT doc_id, label, proba, CAST(proba >= 0.5 AS INTEGER) AS pred FROM nb",
        "linear_attribution": _nb_sql() + "x AS (SELECT doc_id, term, round(weight * (lp1 - lp0), 6) AS contribution FROM weights JOIN model USING (term)), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(contribution) DESC, term) AS k FROM x) SELECT doc_id, CAST(k AS INTEGER) AS rank, term, contribution, CASE WHEN contribution >= 0 THEN 'REAL' ELSE 'FAKE' END AS pushes FROM y WHERE k <= 10",
        "attribution_totals": _nb_sql() + f"pushes AS (SELECT doc_id, sum(greatest(weight * (lp1 - lp0), 0.0)) AS to_real, sum(greatest(-weight * (lp1 - lp0), 0.0)) AS to_fake, count(*) AS terms_matched FROM weights JOIN model USING (term) GROUP BY doc_id) SELECT c.doc_id, CAST(len({_clean('c.content')}) AS BIGINT) AS words_kept, coalesce(terms_matched, 0) AS terms_matched, round(coalesce(to_real, 0.0), 6) AS to_real, round(coalesce(to_fake, 0.0), 6) AS to_fake FROM corpus c LEFT JOIN pushes ON pushes.doc_id = c.doc_id",
        "confusion_metrics": _eval_sql() + f", {cm}, m AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fp, 0), 0) AS s FROM c) SELECT system, tp, fn, fp, tn, round((tp + tn) / (tp + fn + fp + tn), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((r + s) / 2, 6) AS balanced_accuracy, round(s, 6) AS recall_fake FROM m",
        "error_direction": _eval_sql() + ", x AS (SELECT system, count(*) FILTER (label = 0 AND pred = 1) AS a, count(*) FILTER (label = 1 AND pred = 0) AS b, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM scores GROUP BY system) SELECT system, a AS false_real, b AS false_fake, round(coalesce(a / nullif(n0, 0), 0), 6) AS false_real_rate, round(coalesce(b / nullif(n1, 0), 0), 6) AS false_fake_rate FROM x",
        "threshold_sweep": _eval_sql() + ", t AS (SELECT unnest(range(5, 96)) AS t), x AS (SELECT system, t, count(*) FILTER (label = 1 AND floor(round(proba * 100, 4)) >= t) AS p, count(*) FILTER (floor(round(proba * 100, 4)) >= t) AS n, count(*) FILTER (label = 1) AS a FROM scores CROSS JOIN t GROUP BY system, t) SELECT system, round(t / 100, 6) AS threshold, round(CASE WHEN n = 0 THEN 1.0 ELSE p / n END, 6) AS precision, round(coalesce(p / nullif(a, 0), 0), 6) AS recall, round(coalesce(2 * p / nullif(n + a, 0), 0), 6) AS f1 FROM x",
        "roc_pr_areas": _eval_sql() + f", {points}, l AS (SELECT *, coalesce(lag(fpr) OVER w, 0) AS f0, coalesce(lag(tpr) OVER w, 0) AS t0 FROM curve WINDOW w AS (PARTITION BY system ORDER BY proba DESC)) SELECT system, round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS roc_auc, round(sum((tpr - t0) * precision), 6) AS average_precision FROM l GROUP BY system",
        "brier": _eval_sql() + " SELECT system, round(avg((proba - label) * (proba - label)), 6) AS brier FROM scores GROUP BY system",
        "error_by_length": _rate_sql(_eval_sql() + f", b AS (SELECT s.*, {_case(_words('d.text'), LENGTH_BINS)} AS bucket FROM scores s JOIN documents d USING (doc_id))", [b for _, b in LENGTH_BINS]),
        "error_by_confidence": _rate_sql(_eval_sql() + f", b AS (SELECT *, {_case(conf, CONFIDENCE_BINS, True)} AS bucket FROM scores)", [b for _, b in CONFIDENCE_BINS]),
        "model_overlap": _eval_sql() + f", {wide} SELECT array_to_string(wrong, ' + ') AS systems, count(*) AS articles, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM wide WHERE len(wrong) > 0 GROUP BY 1",
        "agreement_cells": _eval_sql() + f", {wide}, w AS (SELECT list_contains(wrong, 'nb') AS a, list_contains(wrong, 'rule') AS b FROM wide) SELECT 'nb' AS a, 'rule' AS b, count(*) FILTER (NOT w.a AND NOT w.b) AS both_right, count(*) FILTER (NOT w.a AND w.b) AS only_a, count(*) FILTER (w.a AND NOT w.b) AS only_b, count(*) FILTER (w.a AND w.b) AS both_wrong, round(count(*) FILTER (w.a = w.b) / count(*), 6) AS agree FROM w",
        "mcnemar_counts": _eval_sql() + ", p AS (SELECT x.system AS a, y.system AS b, count(*) FILTER (x.label = x.pred AND y.label <> y.pred) AS only_a, count(*) FILTER (x.label <> x.pred AND y.label = y.pred) AS only_b FROM scores x JOIN scores y ON x.doc_id = y.doc_id AND x.system < y.system GROUP BY ALL) SELECT *, round(coalesce((abs(only_a - only_b) - 1) * (abs(only_a - only_b) - 1) / nullif(only_a + only_b, 0), 0), 6) AS chi2 FROM p",
        "shared_and_unique": _eval_sql() + f", {wide}, e AS (SELECT unnest(wrong) AS system, len(wrong) AS k FROM wide) SELECT system, count(*) AS errors, count(*) FILTER (k = 1) AS unique_errors, count(*) FILTER (k = (SELECT count(DISTINCT system) FROM scores)) AS shared_by_all FROM e GROUP BY system",
        "agreement_rates": _eval_sql() + f", {wide}, w AS (SELECT list_contains(wrong, 'nb') AS a, list_contains(wrong, 'rule') AS b FROM wide) SELECT 'nb' AS a, 'rule' AS b, round(count(*) FILTER (NOT w.a AND NOT w.b) / count(*), 6) AS both_right, round(count(*) FILTER (NOT w.a AND w.b) / count(*), 6) AS only_a, round(count(*) FILTER (w.a AND NOT w.b) / count(*), 6) AS only_b, round(count(*) FILTER (w.a AND w.b) / count(*), 6) AS both_wrong, round(count(*) FILTER (w.a = w.b) / count(*), 6) AS agree FROM w",
        "best_threshold": _eval_sql() + ", t AS (SELECT unnest(range(5, 96)) AS t), x AS (SELECT system, t, count(*) FILTER (label = 1 AND floor(round(proba * 100, 4)) >= t) AS p, count(*) FILTER (floor(round(proba * 100, 4)) >= t) AS n, count(*) FILTER (label = 1) AS a FROM scores CROSS JOIN t GROUP BY system, t), f AS (SELECT system, round(t / 100, 6) AS threshold, round(coalesce(2 * p / nullif(n + a, 0), 0), 6) AS f1 FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY f1 DESC, threshold) AS k FROM f) SELECT system, threshold, f1 FROM r WHERE k = 1",
        "batch_verdicts": _nb_sql() + f"{_COVERAGE}, x AS (SELECT nb.doc_id, nb.proba, cov.matched, len({_clean('p.content')}) AS tokens FROM nb JOIN cov USING (doc_id) JOIN parts p ON p.doc_id = nb.doc_id) SELECT doc_id, CASE WHEN tokens = 0 THEN 'UNUSABLE' WHEN proba >= {STRICT} THEN 'REAL' ELSE 'FAKE' END AS verdict, CASE WHEN tokens > 0 THEN proba END AS proba, matched < 5 AS low_evidence, CASE WHEN tokens > 0 THEN greatest(proba, 1 - proba) < 0.7 END AS low_confidence FROM x",
        "unknown_subjects": f"SELECT source AS subject, count(*) AS rows FROM documents WHERE source NOT IN ({', '.join(repr(k) for k in KNOWN)}) GROUP BY source",
        "usable_documents": f"WITH {_DOCS} SELECT doc_id FROM docs WHERE len({_clean()}) > 0",
        "top_errors": _eval_sql() + f", e AS (SELECT system, doc_id, label, pred, {conf} AS confidence FROM scores WHERE label <> pred), r AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY confidence DESC, doc_id) AS k FROM e) SELECT system, CAST(k AS INTEGER) AS rank, doc_id, label, pred, confidence FROM r WHERE k <= 10",
        "error_by_coverage": _rate_sql(_eval_sql() + f", {_COVERAGE}, b AS (SELECT s.*, {_case('matched', COVERAGE_BINS)} AS bucket FROM scores s JOIN cov USING (doc_id))", [b for _, b in COVERAGE_BINS]),
        "coverage_stats": _eval_sql() + f", {_COVERAGE} SELECT count(*) AS rows, CAST(quantile_cont(matched, 0.5) AS DOUBLE) AS median_matched, round(avg(CAST(matched < 5 AS INTEGER)), 6) AS low_share FROM cov",
        "feature_correlation": _eval_sql() + f", {_COVERAGE}, {_WRONG}, x AS (SELECT matched, any_wrong, {_words('d.text')} AS w FROM wrong JOIN cov USING (doc_id) JOIN documents d USING (doc_id)) SELECT round(corr(matched, any_wrong), 6) AS matched_wrong, round(corr(matched, w), 6) AS matched_words FROM x",
        "marker_class_errors": _eval_sql() + f", {_WRONG}, m AS (" + " UNION ALL ".join(f"SELECT '{m.replace(chr(39), chr(39) * 2)}' AS marker, label, any_wrong, CAST(regexp_matches(d.text, '(?m){p.replace(chr(39), chr(39) * 2)}') AS INTEGER) AS present FROM wrong JOIN documents d USING (doc_id)" for m, p in MARKERS.items()) + "), dim AS (SELECT * FROM (SELECT DISTINCT marker FROM m) CROSS JOIN (VALUES (0), (1)) l(label) CROSS JOIN (VALUES (0), (1)) h(present)) SELECT dim.marker, dim.label, dim.present, count(m.label) AS n, CAST(coalesce(sum(any_wrong), 0) AS BIGINT) AS errors, round(sum(any_wrong) / nullif(count(m.label), 0), 6) AS error_rate FROM dim LEFT JOIN m ON m.marker = dim.marker AND m.label = dim.label AND m.present = dim.present GROUP BY ALL",
        "marker_mismatch": _eval_sql() + f", x AS (SELECT system, regexp_matches(coalesce(d.text, ''), '{RULE}') = (label = 0) AS odd, label <> pred AS wrong FROM scores JOIN documents d USING (doc_id)), y AS (SELECT system, count(*) AS n, count(*) FILTER (odd) AS k, count(*) FILTER (wrong) AS errors, count(*) FILTER (odd AND wrong) AS in_slice FROM x GROUP BY system) SELECT system, errors, in_slice, round(in_slice / greatest(errors, 1), 6) AS share, round(k / n, 6) AS slice_share, round((in_slice / greatest(errors, 1)) / nullif(k / n, 0), 6) AS concentration FROM y",
        "style_of_errors": _eval_sql() + f", {_WRONG}, s AS (SELECT label, any_wrong, " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in _stats_sql("d.text").items()) + " FROM wrong JOIN documents d USING (doc_id)), a AS (" + " UNION ALL ".join(f"SELECT label, '{k}' AS feature, avg({k}) FILTER (any_wrong = 1) AS w, avg({k}) FILTER (any_wrong = 0) AS r FROM s GROUP BY label" for k in style) + ") SELECT label, feature, round(w, 6) AS wrong, round(r, 6) AS \"right\", round(w / nullif(r, 0), 6) AS ratio FROM a",
        "roc_points": _eval_sql() + f", {points} SELECT system, proba, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr, round(precision, 6) AS precision FROM curve",
        "calibration_bins": _eval_sql() + ", e AS (SELECT system, list_transform(quantile_cont(proba, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda x: round(x, 9)) AS edges FROM scores GROUP BY system), x AS (SELECT s.*, CAST(len(list_filter(edges, lambda x: x < proba)) AS INTEGER) AS bin FROM scores s JOIN e USING (system)) SELECT system, bin, count(*) AS n, CAST((2 * sum(CAST(round(proba * 1000000000) AS BIGINT)) + 1000 * count(*)) // (2000 * count(*)) AS BIGINT) / 1000000.0::DOUBLE AS mean_predicted, round(avg(label), 6) AS observed FROM x GROUP BY system, bin",
        "minhash_classes": f"WITH {_shingled_sql()} SELECT doc_id, class_id FROM classes",
        "minhash_pairs": _near_sql(),
        "ablation": _ablation_sql(),
        "cross_corpus": _cross_sql(),
        "grid_search": _search_sql() + " SELECT * FROM found",
        "parameter_effects": _effects_sql(),
        "learning_curve": _curve_sql(),
        "stump_eval": f"WITH {_CORPUS}, x AS (SELECT CAST(regexp_matches(content, '{RULE}') AS INTEGER) AS hit, count(*) FILTER (label = 0) AS f, count(*) FILTER (label = 1) AS r FROM corpus GROUP BY 1) SELECT hit, CAST(r > f AS INTEGER) AS pred, greatest(f, r) AS hits, f + r AS n FROM x",
        "log_summary": _LOG + ", r AS (SELECT count(*) AS repeated_inputs FROM (SELECT input_hash FROM log GROUP BY 1 HAVING count(*) > 1)) SELECT count(*) AS total, count(*) FILTER (label = 'FAKE') AS fake, count(*) FILTER (label = 'REAL') AS real, round(avg(confidence), 6) AS avg_confidence, count(*) FILTER (confidence < 0.7) AS low_confidence, count(*) FILTER (true_label IS NOT NULL) AS reviewed, round(avg(CAST(true_label = prediction AS INTEGER)), 6) AS observed_accuracy, any_value(repeated_inputs) AS repeated_inputs FROM log CROSS JOIN r",
        "date_checks": _dates_sql(),
        "log_fetch": _LOG + " SELECT id, label, confidence, source FROM log WHERE label = 'REAL' AND created_at >= TIMESTAMP '2024-01-01 00:10:00' ORDER BY id DESC LIMIT 50",
        "log_unknown": _LOG + ", e AS (SELECT CASE WHEN id % 7 = 0 THEN id + 500000000 ELSE id END AS id FROM log CROSS JOIN range(2) WHERE id % 3 = 0) SELECT id, count(*) AS events FROM e WHERE id NOT IN (SELECT id FROM log) GROUP BY id",
        "log_ids": _LOG + ", x AS (SELECT l.*, b.p FROM log l JOIN base b USING (id)) SELECT 1000 + row_number() OVER (ORDER BY md5(id || '-42'), id) AS id, id AS turn_id, label, round(1 - p, 6) AS proba_fake, round(p, 6) AS proba_real FROM x",
        "log_groups": _LOG + " SELECT 'label' AS kind, label AS value, count(*) AS n FROM log GROUP BY 2 UNION ALL SELECT 'model', model, count(*) FROM log GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM log GROUP BY 2",
        "log_corrections": _LOG + " SELECT text_preview AS text, true_label AS label, model FROM log WHERE true_label IS NOT NULL",
    }

"""Exploration: class overview, crosstabs, style, leakage, terms, splits, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import MARKERS, SEED
from tessera.functions.stats import ratio
from tessera.functions.text import clean_tokens, n_words, normalise, text_stats, word_ngrams


def n(col) -> Column:
    return F.count(col).cast("long")


def leakage_audit(corpus: DataFrame, markers: dict[str, str] | None = None) -> DataFrame:
    """Per marker: rate in each class, gap, accuracy of the best one-rule use.

    One scan for all markers: hits are summed as columns and unpivoted after.
    """
    markers = MARKERS if markers is None else markers
    hits = corpus.select("label", *[F.col("content").rlike(f"(?m){p}").cast("int").alias(f"m{i}") for i, p in enumerate(markers.values())])
    sums = [F.sum(F.when(F.col("label") == c, F.col(f"m{i}")).otherwise(0)).cast("long").alias(f"m{i}_{c}") for i in range(len(markers)) for c in (0, 1)]
    row = hits.agg(F.count_if(F.expr("label = 0")).alias("n0"), F.count_if(F.expr("label = 1")).alias("n1"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"m{i}_0").alias("h0"), F.col(f"m{i}_1").alias("h1")) for i, m in enumerate(markers)]))
    x = row.select("n0", "n1", each.alias("x")).select("n0", "n1", "x.*")
    fake, real = ratio(F.col("h0"), F.col("n0")), ratio(F.col("h1"), F.col("n1"))
    x = x.select("marker", "h0", "h1", "n0", "n1", fake.alias("fake_rate"), real.alias("real_rate"))
    right = F.when(F.col("real_rate") >= F.col("fake_rate"), F.col("h1") + F.col("n0") - F.col("h0")).otherwise(F.col("h0") + F.col("n1") - F.col("h1"))
    return x.select("marker", F.round("fake_rate", 6).alias("fake_rate"), F.round("real_rate", 6).alias("real_rate"), F.round(F.abs(F.col("real_rate") - F.col("fake_rate")), 6).alias("gap"), F.round(ratio(right, F.col("n0") + F.col("n1")), 6).alias("one_rule_accuracy"))


def class_overview(corpus: DataFrame) -> DataFrame:
    words = corpus.select("label", n_words(F.col("content")).alias("w"))
    per = words.groupBy("label").agg(n("*").alias("articles"), F.percentile("w", F.lit(0.5)).alias("median_words"), F.round(F.avg("w"), 6).alias("mean_words"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.withColumn("share", F.round(F.col("articles") / F.sum("articles").over(every), 6))


def style_by_class(corpus: DataFrame) -> DataFrame:
    """Mean of each stylometric number by class, and their ratio."""
    stats = text_stats(F.col("content"))
    per = corpus.select("label", *[c.alias(k) for k, c in stats.items()]).agg(*[F.avg(F.when(F.col("label") == c, F.col(k))).alias(f"{k}_{c}") for k in stats for c in (0, 1)])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"{k}_0").alias("fake"), F.col(f"{k}_1").alias("real")) for k in stats]))
    return per.select(each.alias("x")).select("x.feature", F.round("x.fake", 6).alias("fake"), F.round("x.real", 6).alias("real"), F.round(F.try_divide("x.fake", F.nullif("x.real", F.lit(0.0))), 6).alias("ratio"))


def subject_crosstab(corpus: DataFrame) -> DataFrame:
    per = corpus.groupBy("subject").agg(F.count_if(F.expr("label = 0")).cast("long").alias("fake"), F.count_if(F.expr("label = 1")).cast("long").alias("real"))
    return per.withColumn("kind", F.when(F.col("real") == 0, "fake only").when(F.col("fake") == 0, "real only").otherwise("mixed"))


def subject_rule(corpus: DataFrame) -> DataFrame:
    """Share of one-class subjects, and accuracy of guessing each one's majority."""
    x = subject_crosstab(corpus).agg(n("*").alias("subjects"), F.count_if(F.expr("kind <> 'mixed'")).cast("long").alias("exclusive"), F.sum(F.greatest("fake", "real")).alias("hits"), F.sum(F.col("fake") + F.col("real")).alias("rows"))
    return x.select("subjects", "exclusive", F.round(ratio(F.col("exclusive"), F.col("subjects")), 6).alias("purity"), F.round(ratio(F.col("hits"), F.col("rows")), 6).alias("rule_accuracy"))


def digest(text: Column) -> tuple[Column, Column]:
    """What stands for a text as a key: its md5 and length, so that no text is shuffled."""
    return F.md5(text.cast("binary")).alias("_h"), F.length(text).alias("_n")


def duplicates(docs: DataFrame, text: Column) -> DataFrame:
    """rows, distinct, extra (rows beyond the first of each text), groups."""
    per = docs.groupBy(*digest(text)).agg(F.count("*").alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("rows"), n("*").alias("distinct_texts"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("extra"), F.count_if(F.expr("c > 1")).cast("long").alias("groups"))


def keep_first(docs: DataFrame, text: str = "content", key: str = "doc_id") -> DataFrame:
    """The smallest key of every text; partial minima combine before the shuffle."""
    return docs.groupBy(*digest(F.col(text))).agg(F.min(key).alias(key)).select(key)


def cross_label_texts(corpus: DataFrame) -> DataFrame:
    per = corpus.groupBy(*digest(F.col("content"))).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("c"))
    return per.filter("a <> b").agg(n("*").alias("texts"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("rows"))


def shared_openings(docs: DataFrame, size: int = 120) -> DataFrame:
    """Repeats of the first characters of the normalised text beyond exact repeats."""
    keys = docs.select(digest(F.substring(normalise(F.col("content")), 1, size))[0].alias("o"), digest(F.col("content"))[0].alias("d"))
    x = keys.agg(F.count("*").alias("c"), F.countDistinct("o").alias("o"), F.countDistinct("d").alias("d"))
    return x.select(F.greatest(F.col("d") - F.col("o"), F.lit(0)).cast("long").alias("repeats"), F.round(ratio(F.greatest(F.col("d") - F.col("o"), F.lit(0)), F.col("c")), 6).alias("rate"))


def null_profile(df: DataFrame, name: str) -> DataFrame:
    """Nulls and blanks of every string column, from one scan."""
    cols = [c for c, t in df.dtypes if t == "string"]
    sums = [x for c in cols for x in (F.count_if(F.col(c).isNull()).cast("long").alias(f"{c}_n"), F.count_if(F.regexp_replace(c, r"(?U)\s", "") == "").cast("long").alias(f"{c}_b"))]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_n").alias("nulls"), F.col(f"{c}_b").alias("blanks")) for c in cols]))
    return df.agg(n("*").alias("rows"), *sums).select(F.lit(name).alias("table_name"), "rows", each.alias("x")).select("table_name", "rows", "x.*")


def monthly_timeline(df: DataFrame, ts: str, label: Column) -> DataFrame:
    month = F.date_format(F.date_trunc("month", F.col(ts)), "yyyy-MM").alias("month")
    return df.select(month, label.alias("label")).groupBy("month").agg(F.count_if(F.expr("label = 0")).cast("long").alias("fake"), F.count_if(F.expr("label = 1")).cast("long").alias("real"))


def single_class_months(df: DataFrame, ts: str, label: Column) -> DataFrame:
    """Months, those with one class only, the rows in these, and the share of such months."""
    alone = F.expr("fake = 0 or real = 0")
    x = monthly_timeline(df, ts, label).agg(n("*").alias("months"), F.count_if(alone).cast("long").alias("single"), F.coalesce(F.sum(F.when(alone, F.col("fake") + F.col("real"))), F.lit(0)).cast("long").alias("rows"))
    return x.withColumn("share", F.round(ratio(F.col("single"), F.col("months")), 6))


def date_stump(df: DataFrame, ts: str, label: Column) -> DataFrame:
    """Best single cut of the dates, either way round; ties: fake first, earliest.

    Rows are grouped by date first, so the ordered window sees dates only.
    """
    per = df.select(F.col(ts).alias("d"), label.alias("label")).dropna().groupBy("d").agg(F.count_if(F.expr("label = 0")).alias("f"), F.count_if(F.expr("label = 1")).alias("r"))
    before = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = per.select("d", F.coalesce(F.sum("f").over(before), F.lit(0)).alias("fb"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("rb"), F.sum("f").over(every).alias("fn"), F.sum("r").over(every).alias("rn"))
    # Cuts before each date; the one after the last date only swaps the two directions of the first.
    way = F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("fake first").alias("direction"), (F.col("fb") + F.col("rn") - F.col("rb")).alias("hits")), F.struct(F.lit(1).alias("o"), F.lit("real first").alias("direction"), (F.col("rb") + F.col("fn") - F.col("fb")).alias("hits"))))
    y = x.select("d", (F.col("fn") + F.col("rn")).alias("total"), way.alias("w")).select("d", "total", "w.*")
    best = y.orderBy(F.desc("hits"), "o", "d").limit(1)
    return best.select(F.date_format("d", "yyyy-MM-dd").alias("cutoff"), "direction", F.round(ratio(F.col("hits"), F.col("total")), 6).alias("accuracy"))


def outside_window(df: DataFrame, ts: str, label: Column) -> DataFrame:
    """Rows of each class outside the other's span of dates."""
    span = df.select(F.col(ts).alias("d"), label.alias("label")).dropna()
    s = span.agg(*[f(F.when(F.col("label") == c, F.col("d"))).alias(f"{k}{c}") for c in (0, 1) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    return span.groupBy("label").agg(n("*").alias("rows"), F.count_if(F.when(F.col("label") == 0, ~F.col("d").between(s["lo1"], s["hi1"])).otherwise(~F.col("d").between(s["lo0"], s["hi0"]))).cast("long").alias("outside"))


def temporal_split(df: DataFrame, ts: str, cutoff: str) -> DataFrame:
    """``df`` with split: train before the cutoff, test from it on."""
    return df.withColumn("split", F.when(F.col(ts) < F.to_timestamp(F.lit(cutoff)), "train").otherwise("test"))


def temporal_parts(df: DataFrame, ts: str, cutoff: str, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Training and test part by ``temporal_split``; rows without a date are in neither.

    An error where a side is empty, which gives the corpus's span of dates, or
    where the training part has a single class.
    """
    x = temporal_split(df.filter(F.col(ts).isNotNull()), ts, cutoff)
    train = F.col("split") == "train"
    s = x.agg(F.count_if(train).alias("train"), F.count_if(~train).alias("test"), F.count_distinct(F.when(train, F.col(label))).alias("classes"), F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if not (s["train"] and s["test"]):
        raise ValueError(f"cutoff {cutoff} leaves a side empty ({s['train']} train, {s['test']} test); dates run from {s['lo']} to {s['hi']}")
    if s["classes"] < 2:
        raise ValueError(f"cutoff {cutoff} leaves one class in the training part; a later one is needed")
    return x.filter(train).drop("split"), x.filter(~train).drop("split")


def shuffled(key: str, seed: int = SEED) -> Column:
    """A hash to order rows by, the same in any engine."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def ranked(df: DataFrame, label: str, hashed: str, key: str, digits: int = 4) -> DataFrame:
    """``df`` with _r, the place of each row in its class by hash and key.

    Rows are ranked within the first hex digits of their hash and moved on by
    the number of rows before these: no task sorts a class.  At most
    16^digits counts a class are broadcast.
    """
    x = df.withColumn("_p", F.substring(hashed, 1, digits))
    before = Window.partitionBy("_l").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    sizes = x.groupBy(F.col(label).alias("_l"), F.col("_p").alias("_q")).agg(F.count("*").alias("_s"))
    starts = sizes.select("_l", "_q", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
    within = Window.partitionBy(label, "_p").orderBy(hashed, key)
    y = x.withColumn("_w", F.row_number().over(within)).join(F.broadcast(starts), F.col(label).eqNullSafe(F.col("_l")) & (F.col("_p") == F.col("_q")))
    return y.withColumn("_r", F.col("_w") + F.col("_b")).drop("_p", "_w", "_l", "_q", "_b")


def _first_of_each(df: DataFrame, wanted, label: str, key: str, seed: int) -> Column:
    """Whether a row is among the first ``wanted(n)`` of the n of its class by hash.

    Only hashes and keys are ranked; the place of the last wanted row of each
    class comes to the driver, and rows are compared with it where they are.
    Rows that tie with it, repeating its key, are all taken.
    """
    slim = df.select(F.col(label).alias("_c"), shuffled(key, seed).alias("_h"), F.col(key).alias("_k"))
    sizes = {r["_c"]: r["count"] for r in slim.groupBy("_c").count().collect()}
    any_last = F.lit(False)
    for c, n in sizes.items():
        any_last = any_last | (F.col("_c").eqNullSafe(F.lit(c)) & (F.col("_r") == wanted(n)))
    first, own = F.lit(False), shuffled(key, seed)
    for r in ranked(slim, "_c", "_h", "_k").filter(any_last).collect():
        upto = (own < r["_h"]) | ((own == r["_h"]) & (F.col(key) <= r["_k"]))
        first = F.when(F.col(label).eqNullSafe(F.lit(r["_c"])), upto).otherwise(first)
    return first


def stratified_split(df: DataFrame, label: str = "label", key: str = "doc_id", test: float = 0.2, seed: int = SEED) -> DataFrame:
    """``df`` with split: the first share of each class by hash is the test part."""
    first = _first_of_each(df, lambda n: int(n * test + 0.5), label, key, seed)
    return df.withColumn("split", F.when(first, "test").otherwise("train"))


def stratified_folds(df: DataFrame, k: int = 3, label: str = "label", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    x = ranked(df.withColumn("_h", shuffled(key, seed)), label, "_h", key)
    return x.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def seeded_sample(df: DataFrame, size: int, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    return df.orderBy(shuffled(key, seed), key).limit(size)


def balanced_subsample(df: DataFrame, label: str = "label", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """As many rows of every class as the smallest has."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return df.filter(_first_of_each(df, lambda n: least, label, key, seed))


# -- terms -----------------------------------------------------------------


def term_table(corpus: DataFrame, pairs: bool = False) -> DataFrame:
    """(doc_id, label, term, tf) in long form; with ``pairs`` also of neighbouring words."""
    tokens = clean_tokens(F.col("content"))
    if pairs:  # an array of one binds the tokens, which are read four times
        tokens = F.flatten(F.transform(F.array(tokens), word_ngrams))
    words = corpus.select("doc_id", "label", F.explode(tokens).alias("term"))
    return words.groupBy("doc_id", "label", "term").agg(n("*").alias("tf"))


def vocabulary(terms: DataFrame, min_df: int = 2, size: int = 5000) -> DataFrame:
    """The most frequent terms: tf, df and df by class; ties by term."""
    per = terms.groupBy("term").agg(F.sum("tf").cast("long").alias("tf"), n("*").alias("df"), F.count_if(F.expr("label = 0")).cast("long").alias("df_fake"), F.count_if(F.expr("label = 1")).cast("long").alias("df_real"))
    return per.filter(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(size)


def ranked_vocabulary(found: DataFrame, min_df: int = 2, size: int = 5000) -> DataFrame:
    """``vocabulary`` from counts by label (``packed.totals``): grp, term, tf, df, several rows a term."""
    per = found.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), *[F.coalesce(F.sum(F.when(F.col("grp") == c, F.col("df"))), F.lit(0)).alias(k) for c, k in ((0, "df_fake"), (1, "df_real"))])
    return per.filter(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(size)


def discriminative_terms(terms: DataFrame, min_df: int = 5, size: int = 40000, top: int = 20) -> DataFrame:
    """Smoothed log-count ratios; the ``top`` terms of each class."""
    v = vocabulary(terms, min_df, size)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p, q = F.col("df_fake") + 1, F.col("df_real") + 1
    x = v.select("term", "df", F.round(F.log((p / F.sum(p).over(every)) / (q / F.sum(q).over(every))), 6).alias("log_ratio"))
    up, down = Window.orderBy(F.desc("log_ratio"), "term"), Window.orderBy("log_ratio", "term")
    y = x.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down))
    side = F.when(F.col("a") <= top, "fake").when(F.col("b") <= top, "real")
    return y.select(side.alias("side"), "term", "log_ratio", F.col("df").alias("docs")).filter("side is not null")


def term_rates(terms: DataFrame, sizes: DataFrame, min_df: int = 2, size: int = 500) -> DataFrame:
    """The vocabulary by rank, with each class's share of documents that hold the term and their gap.

    ``sizes`` has one row: n0 and n1, the documents of each class.
    """
    v = vocabulary(terms, min_df, size).crossJoin(F.broadcast(sizes))  # one row
    x = v.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tf"), "term")).cast("int"))
    fake, real = ratio(F.col("df_fake"), F.col("n0")), ratio(F.col("df_real"), F.col("n1"))
    return x.select("rank", "term", "tf", F.round(fake, 6).alias("fake_rate"), F.round(real, 6).alias("real_rate"), F.round(F.abs(real - fake), 6).alias("gap"))


def vocabulary_overlap(terms: DataFrame) -> DataFrame:
    per = terms.groupBy("term").agg(F.max((F.col("label") == 0).cast("int")).alias("f"), F.max((F.col("label") == 1).cast("int")).alias("r"))
    x = per.agg(F.sum("f").cast("long").alias("fake_terms"), F.sum("r").cast("long").alias("real_terms"), F.count_if(F.expr("f = 1 and r = 1")).cast("long").alias("shared"), n("*").alias("all_terms"))
    return x.select("fake_terms", "real_terms", "shared", F.round(ratio(F.col("shared"), F.col("all_terms")), 6).alias("jaccard"))


def tfidf(terms: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, label, term, weight): tf (ln((1+n)/(1+df)) + 1), each document of length 1."""
    idf = vocab.select("term", (F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    x = terms.join(idf, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = x.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return x.join(norm, "doc_id").select("doc_id", "label", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def length_histogram(corpus: DataFrame, bins: int = 60, clip: int = 2000) -> DataFrame:
    w = corpus.select(F.least(n_words(F.col("content")), F.lit(clip)).alias("w"), "label")
    s = w.agg(F.min("w").alias("lo"), F.max("w").alias("hi")).first()
    lo, hi = s["lo"] or 0, s["hi"] or 0
    step = F.floor((F.col("w") - lo) * bins / F.lit(max(hi - lo, 1)))
    return w.withColumn("bin", F.least(step, F.lit(bins - 1)).cast("int")).groupBy("bin").agg(F.count_if(F.expr("label = 0")).cast("long").alias("fake"), F.count_if(F.expr("label = 1")).cast("long").alias("real"))

"""Data-quality checks: one row each, a weighted score, and a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DATE_FORMATS, POINTS, THRESHOLDS
from tessera.functions.stats import js_distance, ks_statistic, ratio, verdict, worst
from tessera.functions.text import clean_tokens, n_words, normalise, parse_date
from tessera.operators import eda, neardup, packed
from tessera.plans.kept import written
from tessera.sources.corpus import compare_runs

#: Patterns of decoding accidents, hard ones first.
HARD = ("\ufffd", "\u00c3[\u0080-\u00bf]|\u00e2\u20ac[\u0098-\u009d\u2122\u00a6]|\u00c2[\u00a0-\u00bf]")
SOFT = ("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "[\u00ad\u200b-\u200f\u202a-\u202e\u2060\ufeff]")


def encoding_profile(df: DataFrame, name: str) -> DataFrame:
    """Rows with decoding accidents in every string column, from one scan."""
    cols = [c for c, t in df.dtypes if t == "string"]
    kinds = {"replacement": HARD[0], "mojibake": HARD[1], "control": SOFT[0], "invisible": SOFT[1], "non_ascii": r"[^\x00-\x7f]"}
    sums = [F.count_if(F.col(c).rlike(p)).cast("long").alias(f"{c}_{k}") for c in cols for k, p in kinds.items()]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}_{k}").alias(k) for k in kinds]) for c in cols]))
    return df.agg(*sums).select(F.lit(name).alias("table_name"), each.alias("x")).select("table_name", "x.*")


def length_checks(docs: DataFrame) -> DataFrame:
    w = docs.select(n_words(F.col("content")).alias("w"))
    x = w.agg(F.count("*").cast("long").alias("rows"), F.count_if(F.expr("w < 20")).cast("long").alias("short"), F.count_if(F.expr("w > 6000")).cast("long").alias("long_rows"), F.min("w").alias("min_words"), F.percentile("w", F.lit(0.5)).alias("median_words"), F.max("w").alias("max_words"))
    return x.withColumn("short_rate", F.round(ratio(F.col("short"), F.col("rows")), 6))


def formatting_checks(docs: DataFrame) -> DataFrame:
    c = F.col("content")
    upper, letters = F.regexp_count(c, F.lit(r"\p{Lu}")), F.regexp_count(c, F.lit("[A-Za-z]"))
    x = docs.agg(F.count("*").cast("long").alias("rows"), F.count_if(ratio(upper, F.length(c)) > 0.6).cast("long").alias("shouting"), F.count_if(ratio(letters, F.length(c)) < 0.5).cast("long").alias("few_letters"))
    return x.withColumn("rate", F.round(ratio(F.col("shouting") + F.col("few_letters"), F.col("rows")), 6))


def unknown_subjects(corpus: DataFrame, known: list[str]) -> DataFrame:
    """Subjects that are not among the known ones, with their rows."""
    return corpus.filter(~F.col("subject").isin(known)).groupBy("subject").agg(F.count("*").cast("long").alias("rows"))


def class_balance(corpus: DataFrame) -> DataFrame:
    x = corpus.agg(F.count_if(F.expr("label = 0")).cast("long").alias("fake"), F.count_if(F.expr("label = 1")).cast("long").alias("real"))
    share = ratio(F.least("fake", "real"), F.col("fake") + F.col("real"))
    return x.select("fake", "real", F.round(share, 6).alias("minority"), balance(share).alias("status"))


def balance(minority: Column) -> Column:
    return F.when(minority > 0.35, "PASS").when(minority > 0.2, "WARN").otherwise("FAIL")


def _entry(name: str, weight: float, value: Column, threshold: str | None, status: Column | None = None) -> Column:
    v = F.round(value.cast("double"), 6)
    warn, fail = THRESHOLDS.get(threshold, (0.0, 0.0))
    return F.struct(F.lit(name).alias("check_id"), F.lit(float(weight)).alias("weight"), v.alias("value"), (verdict(v, warn, fail) if status is None else status).alias("status"))


def _rows(df: DataFrame, *entries: Column) -> DataFrame:
    """The checks of a table of one row."""
    return df.select(F.explode(F.array(*entries)).alias("x")).select("x.*")


def _check(df: DataFrame, name: str, weight: float, value: Column, threshold: str | None, status: Column | None = None) -> DataFrame:
    return _rows(df, _entry(name, weight, value, threshold, status))


def measures(corpus: DataFrame, marker: str) -> DataFrame:
    """What the checks ask of each row, from one scan of the texts and written without them: digests of the text, its normalised form, its opening and its title, words, and flags."""
    c, t = F.col("content"), F.coalesce("title", F.lit("")) if "title" in corpus.columns else F.lit("")
    x = corpus.select("label", "subject", "content", t.alias("_t"), normalise(c).alias("_norm"), n_words(c).alias("words"), F.length(c).alias("size"))
    upper, letters = F.regexp_count(c, F.lit(r"\p{Lu}")), F.regexp_count(c, F.lit("[A-Za-z]"))
    flags = {
        "blank": F.regexp_replace(c, r"(?U)\s", "") == "",
        "short": F.col("words") < 20,
        "hard": c.rlike("|".join(HARD)),
        "soft": c.rlike("|".join(SOFT)),
        "marked": c.rlike(f"(?i){marker}"),
        "shouting": ratio(upper, F.col("size")) > 0.6,
        "few_letters": ratio(letters, F.col("size")) < 0.5,
        "url_title": F.col("_t").rlike(r"https?://|www\."),
    }
    keys = {"text": c, "norm": F.col("_norm"), "opening": F.substring("_norm", 1, 120), "title": F.col("_t")}
    return written(x.select("label", "subject", "words", "size", *[F.md5(v.cast("binary")).alias(f"{k}_key") for k, v in keys.items()], *[v.alias(k) for k, v in flags.items()]), "measures")


def date_checks(corpus: DataFrame) -> DataFrame:
    """The three checks of a corpus with label and date, as rows of ``checks``."""
    first, *rest = _date_checks(corpus)
    for x in rest:
        first = first.unionByName(x)
    return first


def _date_checks(corpus: DataFrame) -> list[DataFrame]:
    """The three checks of the column date; a class without dates has no window and no distance."""
    x = corpus.select("label", parse_date(F.col("date"), DATE_FORMATS).alias("d"))
    bad = x.agg(F.count_if(F.col("d").isNull()).alias("bad"), F.count("*").alias("n"))
    span = x.agg(*[f(F.when(F.col("label") == c, F.col("d"))).alias(f"{k}{c}") for c in (0, 1) for k, f in (("lo", F.min), ("hi", F.max))])
    out = F.when(F.col("lo0").isNotNull() & F.col("lo1").isNotNull(), ~F.col("d").between(F.greatest("lo0", "lo1"), F.least("hi0", "hi1")))
    outside = x.crossJoin(span).agg(F.count_if(out).alias("out"), F.count_if(out & (F.col("label") == 0)).alias("fake"), F.count("*").alias("n"))
    months = eda.monthly_timeline(x.dropna(), "d", F.col("label"))
    single = months.agg(F.count_if(F.expr("fake = 0 or real = 0")).alias("s"), F.count("*").alias("m"))
    drift = js_distance(months, "fake", "real").crossJoin(single)
    js, share = F.round("js_distance", 6), F.round(ratio(F.col("s"), F.col("m")), 6)
    both = worst(verdict(js, *THRESHOLDS["js_distance"]), verdict(share, *THRESHOLDS["single_class_month"]))
    return [
        _check(bad, "validity.dates", 1.0, ratio(F.col("bad"), F.col("n")), "unparseable_date_rate"),
        _check(outside, "consistency.date_label", 1.5, ratio(F.col("out"), F.col("n")), None, F.when(ratio(F.col("fake"), F.col("out")) > 0.99, "FAIL").when(F.col("out") > 0, "WARN").otherwise("PASS")),
        _check(drift, "drift.dates", 1.5, js, None, both),
    ]


def vocabulary(corpus: DataFrame, min_df: int, size: int) -> DataFrame:
    """``eda.vocabulary`` of the corpus' words, of which only counts by term are shuffled; rows of one doc_id and label are one document, and of those that repeat the words are."""
    again = corpus.groupBy("doc_id", "label").agg(F.count("*").alias("c")).filter("c > 1").select(F.col("doc_id").alias("_id"), F.col("label").alias("_label"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("label").eqNullSafe(F.col("_label"))
    found = packed.totals(corpus.join(again, same, "left_anti"), clean_tokens(F.col("content")), F.col("label"), False)
    repeated = eda.term_table(corpus.join(again, same, "left_semi"))
    return eda.ranked_vocabulary(found.unionByName(repeated.select(F.col("label").cast("int").alias("grp"), "term", "tf", F.lit(1).cast("long").alias("df"))), min_df, size)


def checks(corpus: DataFrame, marker: str = r"\breuters\b", known_subjects: list[str] | None = None) -> DataFrame:
    """(check_id, weight, value, status) of the checks that need the corpus only.

    ``corpus``: doc_id, content, label, subject; optional columns title (two)
    and date (three) add their checks.  The two integrity and two schema checks
    are in ``file_checks``.  Near duplicates are graded on the
    worse of two rates over all texts, rows equal after normalising beyond
    exact repeats and distinct texts with a MinHash near copy, and fail on any
    near copy across labels.
    """
    m, n = measures(corpus, marker), F.count("*")
    exact = m.groupBy("text_key", "size").agg(n.alias("c"), F.min("label").alias("a"), F.max("label").alias("b")).agg(F.sum(F.col("c") - 1).alias("extra"), F.sum("c").alias("n"), F.count_if(F.expr("a <> b")).alias("cross"))
    norm = m.groupBy("norm_key").agg(n.alias("c")).agg(F.sum(F.col("c") - 1).alias("norm_extra"))
    near = exact.drop("cross").crossJoin(norm).crossJoin(neardup.involvement(corpus).withColumnRenamed("cross", "near_cross"))
    near_rate = F.greatest(ratio(F.greatest(F.col("norm_extra") - F.col("extra"), F.lit(0)), F.col("n")), ratio(F.col("near"), F.col("texts")))
    openings = m.agg(n.alias("n"), F.countDistinct("opening_key").alias("o"), F.countDistinct("text_key").alias("d"))
    of = lambda k, label=None: F.count_if(F.col(k) if label is None else F.col(k) & (F.col("label") == label))
    flat = m.agg(n.alias("n"), *[of(k).alias(k) for k in ("blank", "short", "hard", "soft", "shouting", "few_letters", "url_title")], *[of("marked", c).alias(f"m{c}") for c in (0, 1)], *[F.count_if(F.col("label") == c).alias(f"n{c}") for c in (0, 1)])
    gap = F.abs(ratio(F.col("m1"), F.col("n1")) - ratio(F.col("m0"), F.col("n0")))
    rate = ratio(F.col("extra"), F.col("n"))
    share = ratio(F.least("n0", "n1"), F.col("n0") + F.col("n1"))
    flags = [
        _entry("completeness.nulls", 1.5, ratio(F.col("blank"), F.col("n")), "empty_rate"),
        _entry("validity.encoding", 1.0, ratio(F.col("hard") + F.col("soft"), F.col("n") * 2), "encoding_bad_rate"),
        _entry("validity.length", 1.5, ratio(F.col("short"), F.col("n")), "short_article_rate"),
        _entry("validity.formatting", 1.0, ratio(F.col("shouting") + F.col("few_letters"), F.col("n")), "formatting_rate"),
        _entry("consistency.publisher_fingerprint", 2.0, gap, "marker_class_gap"),
        _entry("consistency.class_balance", 1.0, share, None, balance(share)),
    ]
    if "title" in corpus.columns:
        flags.append(_entry("validity.title_is_url", 1.0, ratio(F.col("url_title"), F.col("n")), "url_title_rate"))
    words = vocabulary(corpus, 3, 20000)
    out = [
        _rows(flat, *flags),
        _check(exact, "uniqueness.exact_duplicates", 2.0, rate, None, F.when(F.col("cross") > 0, "FAIL").otherwise(verdict(F.round(rate, 6), *THRESHOLDS["dup_rate"]))),
        _check(near, "uniqueness.near_duplicates", 1.5, near_rate, None, F.when(F.col("near_cross") > 0, "FAIL").otherwise(verdict(F.round(near_rate, 6), *THRESHOLDS["near_dup_rate"]))),
        _check(openings, "uniqueness.shared_openings", 1.0, ratio(F.greatest(F.col("d") - F.col("o"), F.lit(0)), F.col("n")), "shared_opening_rate"),
        _check(eda.subject_rule(m), "consistency.subject_label", 2.0, F.col("purity"), "subject_purity"),
        _check(ks_statistic(m.select(F.least("words", F.lit(2000)).alias("w"), "label"), "w", "label"), "drift.length", 1.0, F.col("ks_statistic"), "ks_stat"),
        _check(js_distance(words, "df_fake", "df_real"), "drift.vocabulary", 1.0, F.col("js_distance"), "js_distance"),
    ]
    if "title" in corpus.columns:
        t = m.groupBy("title_key").agg(n.alias("c")).agg(F.sum(F.col("c") - 1).alias("extra"), F.sum("c").alias("n"))
        out.append(_check(t, "uniqueness.duplicate_titles", 1.0, rate, "dup_title_rate"))
    if "date" in corpus.columns:
        out += _date_checks(corpus)
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def file_checks(files: DataFrame, tables: dict[str, DataFrame], expected: dict[str, dict[str, str]], before: DataFrame | None = None) -> DataFrame:
    """The two integrity and two schema checks.

    ``files``: file and sha256, as ``corpus.fingerprints`` gives them; ``before``
    the same of an earlier run, without which the second check is INFO.
    ``expected``: the columns and types of each table.  Values are numbers of
    files, of changed and new files, and of deviating columns; a label that
    comes from elsewhere than its row is always a WARN.
    """
    one = files.sparkSession.range(1)
    found = files.agg(F.count("sha256").alias("files"))
    if before is None:
        same = _check(one, "integrity.unchanged", 1.0, F.lit(None), None, F.lit("INFO"))
    else:
        states = compare_runs(files, before).agg(F.count_if(F.expr("state = 'changed'")).alias("changed"), F.count_if(F.expr("state = 'new'")).alias("new"))
        same = _check(states, "integrity.unchanged", 1.0, F.col("changed") + F.col("new"), None, F.when(F.col("changed") > 0, "FAIL").when(F.col("new") > 0, "WARN").otherwise("PASS"))
    wrong = extra = 0
    for name, columns in expected.items():
        have = dict(tables[name].dtypes)
        wrong += sum(have.get(c) != t for c, t in columns.items())
        extra += len(set(have) - set(columns))
    columns = _check(one, "schema.columns", 1.5, F.lit(wrong + extra), None, F.lit("FAIL" if wrong else "WARN" if extra else "PASS"))
    provenance = _check(one, "schema.label_provenance", 1.0, F.lit(None), None, F.lit("WARN"))
    return _check(found, "integrity.fingerprint", 1.0, F.col("files"), None, F.lit("PASS")).unionByName(same).unionByName(columns).unionByName(provenance)


def score(table: DataFrame) -> DataFrame:
    """100 times the weighted mean of points; INFO rows do not count."""
    points = F.create_map(*[x for k, v in POINTS.items() for x in (F.lit(k), F.lit(v))])
    x = table.filter(F.col("status").isin(list(POINTS))).withColumn("p", F.element_at(points, F.col("status")))
    return x.agg(F.round(100 * F.sum(F.col("weight") * F.col("p")) / F.sum("weight"), 2).alias("score"), F.count("*").cast("long").alias("counted"))


def gate(table: DataFrame) -> bool:
    """Whether no check failed."""
    return table.filter("status = 'FAIL'").isEmpty()

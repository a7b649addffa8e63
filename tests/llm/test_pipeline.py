import math
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from tessera.llm import mixing, queries
from tessera.llm.common import materialise

SF = "/root/testdata/sf0.001"


def keeps_good_texts(spark, docs, out):
    """Most labelled texts that stay are good, and most good ones stay."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    there = {r.doc_id: r.quality for r in docs.select("doc_id").join(labels, "doc_id").collect()}
    stay = {r.doc_id for r in out.collect()} & set(there)
    good = {k for k, q in there.items() if q == 1}
    assert len(stay & good) >= 0.9 * len(good) and len(stay & good) >= 0.9 * len(stay)


def brute_kept(docs):
    """The smallest id of each component of fingerprints at two bits or fewer, by comparing all pairs."""
    def fingerprint(text):
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = sorted((r.doc_id, fingerprint(r.text)) for r in docs.collect())
    label = {k: k for k, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, (a, x) in enumerate(rows):
            for b, y in rows[:i]:
                if (x ^ y).bit_count() <= 2 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return sorted(k for k, v in label.items() if k == v)


def meets_the_weights(spark, docs, out):
    """Every document comes floor(rate) or ceil(rate) times; a plain solver's rates give the same expected shares."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    classifier = mixing.fit(docs, labels, queries.domain_of_labels())
    rows = mixing.mix(docs, classifier, queries.TARGETS)[0].select("doc_id", "tokens", "posterior", "rate").collect()
    times = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert all(math.floor(r.rate) <= times[r.doc_id] <= math.ceil(r.rate) for r in rows)
    t, p = np.array([r.tokens for r in rows], float), np.array([r.posterior for r in rows])
    want = np.array([queries.TARGETS[d] for d in classifier.domains]) / sum(queries.TARGETS[d] for d in classifier.domains)
    share = lambda w: (w * t) @ p / t.sum() - want
    # Plain projected gradient with the same ridge, from rates of 1.
    w, mass = np.ones(len(t)), t / t.sum()
    for _ in range(20_000):
        w = np.maximum(0, w - 0.5 * (p @ share(w) + 1e-3 * (w - 1)))
    assert np.abs(share(np.array([r.rate for r in rows]))).max() <= np.abs(share(w)).max() + 5e-3, (share(w), mass.max())


def test_mixture_keeps_the_rate_of_rows_without_a_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 1, F.col("id").cast("string")).otherwise("same").alias("text"), F.lit(0.5).alias("r"), F.lit(1).alias("_place"))
    out = mixing.resample(rows, "r")
    assert out.columns == ["doc_id", "text", "_place"]
    for part in ("doc_id is null and text = 'same'", "doc_id is null and text <> 'same'", "doc_id is not null"):
        assert 430 < out.filter(part).count() < 570
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.resample(rows, "r").collect()))


def test_stages_take_tables_that_no_reader_gave(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7), (2, "a b c d", "en", "s", 7), (None, None, None, None, None), (3, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0) for r in corpus_pipeline.near_duplicates(spark, docs.filter("n_chars > 0 or doc_id is null"), SF).collect()) == [0, 1, 3]


def test_quality_without_two_classes_keeps_all(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == docs.count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns, name
        assert 0 < out.count()
        if name == "quality":
            scored = queries.op5_zstd_quality(spark, SF).filter("predicted = 1")
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in scored.collect()}
            keeps_good_texts(spark, docs, out)
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in out.collect()) == brute_kept(docs)
        if name == "mixture":
            meets_the_weights(spark, docs, out)
        docs = out
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in docs.collect()}
    found = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(found) == docs.count() and {r.doc_id: r.n_tokens for r in found} == wanted


def test_stages_take_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None), (None, "x y z"), (1, None), (2, ""), (3, "a  b"), (3, "a  b"), (4, "word " * 50_000)]
    odd = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    extra = ("_kept", "_copies", "_mix_words", "_quality", "_file", "tokens", "fp", "rate")
    docs = docs.unionByName(odd).selectExpr("*", *[f"{i} AS {n}" for i, n in enumerate(extra)])
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(docs, f"test-{name}")
        out = stage(spark, docs, SF)
        assert out.count() and stage(spark, materialise(docs.limit(0), "none"), SF).count() == 0, name
        if name != "tokens":
            assert out.columns == docs.columns
            assert {tuple(r) for r in out.select(*extra).distinct().collect()} == {tuple(range(len(extra)))}, name
            docs = out

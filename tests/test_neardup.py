import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import normalise
from tessera.operators import neardup, order


def similar(rng, words, n, share):
    """Texts of ``words`` words, and partners whose 5-word shingles have about this Jaccard similarity."""
    texts = []
    for i in range(n):
        own = [f"w{i}x{j}" for j in range(words)]
        # One changed word costs five shingles of both sides.
        changes = max(1, round((words - 4) * (1 - share) / (1 + share) / 5))
        other = own.copy()
        for k in range(changes):
            other[int((k + 0.5) * words / changes)] = f"new{i}x{k}"
        texts += [own, other]
    return [" ".join(t) for t in texts]


def jaccard(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("bucket", [256, 2])
def test_recall_and_exact_similarity(spark, monkeypatch, bucket):
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    texts = similar(np.random.default_rng(1), 240, 150, 0.85)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    found = {(r.a, r.b): r.similarity for r in neardup.pairs(docs).collect()}
    wanted = {(i, i + 1): s for i in range(0, 300, 2) if (s := jaccard(texts[i], texts[i + 1])) >= 0.8}
    assert len(wanted) > 100 and set(found) <= set(wanted)
    assert len(found) >= 0.95 * len(wanted) and all(v == pytest.approx(wanted[k]) for k, v in found.items())


def test_one_band_that_all_share(spark):
    """Buckets of thousands: divided by the other bands; those that share all of them meet in blocks."""
    rng = np.random.default_rng(2)
    n = 1500
    sig = rng.integers(0, neardup.PRIME, (n, 64))
    sig[:, :4] = 7
    sets = [[int(v) for v in rng.integers(0, 1 << 40, 20)] for _ in range(n)]
    for i in range(400):  # one group of near copies, beyond a block
        sig[i], sets[i] = sig[0], [*sets[0][:19], i]
    sig[1000], sets[1000] = sig[1200], sets[1200][:19]
    rows = [(i, 1, sorted(s), [int(v) for v in g]) for i, (s, g) in enumerate(zip(sets, sig, strict=True))]
    reps = spark.createDataFrame(rows, "rep long, n long, set array<long>, sig array<long>")
    found = neardup.meet(reps, 0.8)
    assert found.filter("a = 1000 and b = 1200").count() == 1
    assert found.count() == 400 * 399 // 2 + 1 and found.filter("similarity < 0.8 or a >= b").count() == 0


def test_classes_by_shingles(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b, c d e f!"), (3, "x"), (4, None), (5, ""), (6, "a b c d e f a b c d e f"), (None, "x")], "doc_id long, content string")
    found = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, None: 3}


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_sums_and_quantiles(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(g, float(v), int(k)) for g, n in (("hot", 900), ("b", 40), ("c", 1)) for v, k in zip(np.round(rng.normal(size=n), 1), rng.integers(0, 9, n), strict=True)]
    df = spark.createDataFrame(rows, "g string, v double, k long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        per = df.groupBy("g", "v").agg(F.sum("k").alias("k"))
        found = {(r.g, r.v): r.k_upto for r in order.running(per, "g", [F.desc("v")], ["k"]).collect()}
        edges = {r.g: r.edges for r in order.quantiles(df, "g", "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == {(g, v): sum(k for h, u, k in rows if h == g and u >= v) for g, v, _ in rows}
    for g in ("hot", "b", "c"):
        assert edges[g] == pytest.approx(np.quantile([v for h, v, _ in rows if h == g], [0.0, 0.25, 0.5, 0.9, 1.0]).tolist())
    assert order.quantiles(df.limit(0), "g", "v", [0.5]).count() == 0


def test_sketches_are_the_minima_of_the_shingles(spark):
    """Sets, digests and signatures of the batches against plain words and the minima as columns."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{v}" for v in rng.integers(0, 30, n)) for n in (0, 1, 4, 5, 6, 40, 3000)]
    texts += [None, "  ", "\u0130stanbul \u212a k\u00e9 \u00c9t\u00e9\t1 2", "a-b\nc d e", "A b c, D e", "b a c d e", "x x x x x x x", "x x x x x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string").repartition(3)
    words = {r[0]: r[1].split() for r in docs.select("doc_id", normalise(F.coalesce("content", F.lit("")))).collect()}
    grams = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    found, p = neardup._sketched(docs, F.col("content"), ["doc_id"], True).collect(), neardup.PRIME
    params = [(int(x), int(y)) for x, y in zip(*(v.ravel() for v in neardup._draws(64, neardup.SEED)), strict=True)]
    for r in found:
        h = [v % (1 << 64) % p for v in r.set]
        assert len(r.set) == len(grams[r.doc_id]) and list(r.sig) == [min([(x * v + y) % p for v in h], default=p) for x, y in params]
        assert [x.doc_id for x in found if x.digest == r.digest] == [x.doc_id for x in found if grams[x.doc_id] == grams[r.doc_id]]


def test_signing_is_fast(spark):
    """Shingles and minima by arrays: interpreted column by column they took several milliseconds a text."""
    text = " ".join(f"w{i}" for i in range(20_000))
    docs = spark.range(60, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id").cast("string")).alias("content"))
    neardup._sketched(docs.limit(1), F.col("content"), ["doc_id"], True).collect()
    plan = neardup._sketched(docs, F.col("content"), ["doc_id"], True)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "transform(" not in plan and "regexp_replace" not in plan

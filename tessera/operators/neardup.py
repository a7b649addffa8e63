"""MinHash near-duplicates: banding finds candidates, exact similarity decides.

Texts with the same set of shingles form a class, and only class representatives
meet in the bands: a group of copies of any size costs one row a band.  A bucket
of many representatives is divided by each other band in turn, as similar texts
share several; what stays large is cut into blocks, and each pair of blocks is a
group of its own that returns similar pairs only.  Candidates need to agree in
fewer places of the signature than the similarity asks for; then the Jaccard
similarity of their shingles is computed.  No bucket is capped and texts are
read whole.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest, xxh128_hexdigest

from tessera.config import SEED
from tessera.functions.text import normalise, shingles
from tessera.plans.kept import written

# Permutations, their modulus, bands, and the least similarity.
PERMUTATIONS, PRIME, BANDS, SIMILARITY = 64, (1 << 31) - 1, 16, 0.80
#: Candidates agree in this share of the signature: three deviations of the estimate below the similarity.
AGREEMENT = 0.65
#: Representatives of a bucket that meet by a join; larger ones are divided, then cut into blocks of this size.
BUCKET = 256


def _words(content: Column) -> Column:
    return F.filter(F.split(normalise(F.coalesce(content, F.lit(""))), " "), lambda w: w != "")


def signature(content: Column, permutations: int = PERMUTATIONS, seed: int = SEED) -> Column:
    """array<long> of minima of (a h + b) mod p over the hashes of the 5-word shingles; p for empty texts."""
    # Arrays of one bind the words and the hashes: an expression inside a lambda is evaluated anew for every item.
    hashes = F.transform(F.array(_words(content)), lambda w: F.transform(shingles(w), lambda s: F.crc32(s.cast("binary")) % PRIME))
    return F.transform(hashes, lambda h: minima(h, permutations, seed))[0]


def minima(hashes: Column, permutations: int = PERMUTATIONS, seed: int = SEED) -> Column:
    draw = random.Random(seed)
    params = F.array(*[F.struct(F.lit(draw.randrange(1, PRIME)).cast("long").alias("a"), F.lit(draw.randrange(PRIME)).cast("long").alias("b")) for _ in range(permutations)])
    return F.transform(params, lambda p: F.coalesce(F.array_min(F.transform(hashes, lambda x: (p["a"] * x + p["b"]) % PRIME)), F.lit(PRIME).cast("long")))


#: Factor of the hash of a shingle, over the hashes of its words.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that a task looks at together.
BYTES = 4_000_000
_U = np.uint64


def _draws(permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = random.Random(seed)
    a, b = zip(*[(draw.randrange(1, PRIME), draw.randrange(PRIME)) for _ in range(permutations)], strict=True)
    return np.array(a, _U)[:, None], np.array(b, _U)[:, None]


def _minima(sets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``minima`` of the hashes modulo the prime: 2^31 is 1 there, so halves are added instead of dividing."""
    out = np.full(len(a), PRIME, _U)
    h = sets % _U(PRIME)
    for lo in range(0, len(h), 256):
        x = a * h[lo : lo + 256]
        x += b
        y = x >> _U(31)
        x &= _U(PRIME)
        x += y
        # Below the prime the difference wraps around, so the smaller one is the remainder.
        np.subtract(x, _U(PRIME), out=y)
        np.minimum(out, np.minimum(x, y, out=x).min(1), out=out)
    return out


#: What ``normalise`` leaves of lower-case text, byte by byte: a-z and 0-9, all else is a space.
_KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def shingle_hashes(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each lower-case text the distinct 64-bit hashes of its shingles, in order; a text of up to ``width`` words is one."""
    words = [t.translate(_KEPT).split() for t in texts]
    sizes = [len(w) for w in words]
    h = np.fromiter((xxh64_intdigest(v) for w in words for v in w), _U, sum(sizes))
    whole = np.ones(max(0, len(h) - width + 1), _U)
    for k in range(width):
        whole = whole * FACTOR + h[k : k + len(whole)]
    out, at = [], 0
    for n in sizes:
        if n >= width:
            found = whole[at : at + n - width + 1]
        else:
            found = np.ones(min(n, 1), _U)
            for v in h[at : at + n]:
                found = found * FACTOR + v
        # Mixed, so that remainders and order depend on all bits.
        found = (found ^ (found >> _U(32))) * _U(0xD6E8FEB86659FD93)
        out.append(np.unique(found ^ (found >> _U(32))))
        at += n
    return out


def _sketched(docs: DataFrame, content: Column, keep: list[str], whole: bool) -> DataFrame:
    """The columns ``keep`` with the digest of the text's shingles, equal for texts with the same ones, and if ``whole`` their set and sig.

    Shingles are told by 64-bit hashes.  They are made a batch at a time where
    the texts are.
    """
    names = [*keep, "digest", *(("set", "sig") if whole else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _draws(PERMUTATIONS, SEED)
        for batch in batches:
            ends, lo = np.cumsum(pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False)), 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BYTES, "right")))
                part, lo = batch.slice(lo, hi - lo), hi
                sets = shingle_hashes(part.column("_text").to_pylist())
                out = [*(part.column(c) for c in keep), pa.array([xxh128_hexdigest(s.tobytes()) for s in sets], pa.string())]
                if whole:
                    edges = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])], pa.int32())
                    sigs = np.concatenate([_minima(s, a, b) for s in sets]).astype(np.int64)
                    out += [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(sets).view(np.int64))), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * PERMUTATIONS, pa.int32()), pa.array(sigs))]
                yield pa.record_batch(out, names)

    x = docs.select(*keep, F.lower(F.coalesce(content, F.lit(""))).cast("binary").alias("_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema], "digest string", *(("set array<long>", "sig array<long>") if whole else ())])
    return x.mapInArrow(run, schema)


def classes(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """key and class_id: the smallest key whose text has the same shingles."""
    signed = written(_sketched(docs, F.col(content), [key], False), "classes")
    return signed.join(signed.groupBy("digest").agg(F.min(key).alias("class_id")), "digest").select(key, "class_id")


def representatives(docs: DataFrame, key: str = "doc_id", content: str = "content", *more: Column) -> DataFrame:
    """(rep, n, set, sig) and ``more`` aggregates, one row a class, written to the shared folder.

    The rep is the smallest key of the class and n its rows; set are the
    shingles and sig their minima.  Texts are not moved: classes are formed by
    digest, and a row of the smallest key gives the shingles, which are
    shuffled once.
    """
    kept = [c for c in docs.columns if c != content]
    signed = written(_sketched(docs, F.col(content), kept, True), "shingles")
    per = signed.groupBy("digest").agg(F.min(key).alias("rep"), F.count("*").cast("long").alias("n"), *more)
    x = signed.select(F.col(key).alias("rep"), "digest", "set", "sig").join(per, ["digest", "rep"])
    # Rows of one key and set are alike.
    others = [c for c in x.columns if c not in ("digest", "rep")]
    return written(x.groupBy("digest", "rep").agg(*[F.first(c).alias(c) for c in others]).drop("digest"), "representatives")


def _buckets(banded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of buckets (code) of two or more: the small and the large ones, with their size."""
    sizes = banded.groupBy("code").agg(F.count("*").alias("size")).filter("size > 1")
    sized = written(banded.join(sizes, "code"), "buckets")
    return sized.filter(F.col("size") <= BUCKET), sized.filter(F.col("size") > BUCKET)


def _join_within(small: DataFrame) -> DataFrame:
    x, y = small.alias("x"), small.alias("y")
    return x.join(y, (F.col("x.code") == F.col("y.code")) & (F.col("x.rep") < F.col("y.rep"))).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _between(agreement: float):
    """Candidates between two blocks of a bucket, or within one: those whose first two common bands are the bucket's."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        _, first, second, p, q = (k.as_py() for k in key)
        left, reps = group["left"].to_numpy(zero_copy_only=False), group["rep"].combine_chunks()
        sig = np.array(group["sig"].to_pylist(), np.int64)
        x = np.flatnonzero(left)
        y = x if p == q else np.flatnonzero(~left)
        rows = PERMUTATIONS // BANDS
        agree, common = np.zeros((len(x), len(y)), np.int16), np.ones((len(x), len(y)), bool)
        for band in range(BANDS):
            whole = np.ones(agree.shape, bool)
            for k in range(band * rows, (band + 1) * rows):
                same = sig[x, k][:, None] == sig[y, k][None, :]
                agree += same
                whole &= same
            if band in (first, second):
                common &= whole
            elif band < second:
                common &= ~whole
        i, j = np.nonzero((agree >= agreement * PERMUTATIONS) & common)
        a, b = reps.take(pa.array(x[i])), reps.take(pa.array(y[j]))
        swap = pc.greater(a, b)
        out = pa.table({"a": pc.if_else(swap, b, a), "b": pc.if_else(swap, a, b)})
        return out.filter(pc.not_equal(a, b))

    return run


def meet(reps: DataFrame, similarity: float = SIMILARITY, agreement: float = AGREEMENT) -> DataFrame:
    """Pairs (a < b) of ``representatives`` with a Jaccard similarity of at least ``similarity``, and the classes' sizes.

    A pair is found if it shares a band, or two where the first one's bucket is
    large: of pairs at 0.8 more than 0.997 are, of pairs at 0.85 more than 0.9997.
    """
    rows = PERMUTATIONS // BANDS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, F.lit(rows))))
    filled = reps.filter(F.size("set") > 0)
    small, large = _buckets(filled.select("rep", F.posexplode(bands).alias("band", "code")))
    # Members of large buckets meet again where another band agrees as well.
    own = filled.select("rep", bands.alias("bands"))
    twice = large.select("rep", "band").join(own, "rep").select("rep", "band", "bands", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("other")).filter("band <> other")
    twice = twice.select("rep", F.least("band", "other").alias("first"), F.greatest("band", "other").alias("second"), "bands").distinct()
    code = F.xxhash64("first", "second", F.element_at("bands", F.col("first") + 1), F.element_at("bands", F.col("second") + 1))
    small_twice, hot = _buckets(twice.select("rep", "first", "second", code.alias("code")))
    # What is large even so: blocks, and a group for each pair of them; only signatures travel.
    n = F.ceil(F.col("size") / BUCKET).cast("int")
    cut = hot.withColumn("n", n).withColumn("own", F.pmod(F.xxhash64("rep", F.lit("block")), F.col("n")).cast("int"))
    cut = cut.join(filled.select("rep", F.col("sig").cast("array<int>").alias("sig")), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = cut.select("code", "first", "second", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") <= F.col("other")).alias("left"), "rep", "sig")
    kind = reps.schema["rep"].dataType.simpleString()
    blocks = cut.groupBy("code", "first", "second", "p", "q").applyInArrow(_between(agreement), f"a {kind}, b {kind}")
    met = _join_within(small).unionByName(_join_within(small_twice)).unionByName(blocks).distinct()
    # Signatures first: shingles travel only with the pairs that agree.
    left, right = (reps.select(F.col("rep").alias(k), F.col("sig").cast("array<int>").alias(f"sig_{k}"), F.col("n").alias(f"n_{k}"), F.size("set").alias(f"size_{k}")) for k in "ab")
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    close = met.join(left, "a").join(right, "b").filter(agree >= agreement * PERMUTATIONS)
    # The sizes bound the similarity from above.
    close = written(close.filter(F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")).select("a", "b", "n_a", "n_b"), "close")
    first, second = (reps.select(F.col("rep").alias(k), F.col("set").alias(f"set_{k}")) for k in "ab")
    near = close.join(first, "a").join(second, "b").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    near = near.withColumn("similarity", F.col("both") / (F.size("set_a") + F.size("set_b") - F.col("both")))
    return near.filter(F.col("similarity") >= similarity).select("a", "b", "n_a", "n_b", "similarity")


def pairs(docs: DataFrame, similarity: float = SIMILARITY, key: str = "doc_id", content: str = "content") -> DataFrame:
    """Pairs of class representatives (a < b) that are similar, with the classes' sizes."""
    return meet(representatives(docs.select(key, content), key, content), similarity)


def involvement(corpus: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row: distinct texts, near (those that have a near copy among the others), cross (classes with near copies under both labels).

    All texts are taken; those that occur with both labels count for both.
    """
    texts = corpus.groupBy(F.md5(F.col("content").cast("binary")).alias("key")).agg(F.min("content").alias("content"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    reps = representatives(texts, "key", "content", F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = meet(reps, similarity).select("a", "b")
    links = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = links.join(reps.select(F.col("rep").alias("b"), "lo", "hi"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("lo").alias("other_lo"), F.max("hi").alias("other_hi"))
    x = reps.select("rep", "n", "lo", "hi").join(other, "rep", "left")
    near = F.col("other_lo").isNotNull() | (F.col("n") > 1)
    return x.agg(F.sum("n").alias("texts"), F.sum(F.when(near, F.col("n")).otherwise(0)).alias("near"), F.count_if(near & (F.least("lo", "other_lo") != F.greatest("hi", "other_hi"))).alias("cross"))

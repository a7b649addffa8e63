"""Quality scores from two zstandard dictionaries.

One dictionary is trained on good labelled text and one on bad.  A text is cut
into blocks of ``block`` bytes, all of it, and each block is compressed with
both; bytes that its own kind's dictionary knows cost less.  The difference of
the two sizes, normalised by the length, is calibrated to a probability by a
logistic curve together with the log of the compression ratio, because a
difference of a few bytes means more in text that hardly compresses.

The dictionaries and the curve are learned from a bounded sample of labelled
rows (``sample`` of each class for each of the two), the lowest by hash of
their key, and only labels choose the class.  The texts that teach the
dictionaries go through the driver, at most ``longest`` characters of each; the
curve learns from whole texts.  Everything else is one pass over
the table without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest, materialise, slices

BLOCK, LEVEL, DICTIONARY = 1000, 3, 112 << 10


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Sizes:
    """Compressed sizes of texts under the bad and the good dictionary."""

    def __init__(self, bad: bytes, good: bytes, block: int = BLOCK, level: int = LEVEL):
        self.block, self.press = block, []
        for data in (bad, good):
            own = zstandard.ZstdCompressionDict(data)
            own.precompute_compress(level=level)
            self.press.append(zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))

    def features(self, text: str) -> tuple[float, float]:
        """Size difference by length; log of the mean compression ratio."""
        data = text.encode("utf-8", "replace")
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        # An empty frame is 6 bytes or so; what is above is the text's own.
        bad, good = (sum(len(p.compress(x)) - 6 for x in parts) for p in self.press)
        return (bad - good) / (len(data) + 20), math.log((max(bad + good, 0) + 2) / 2 / (len(data) + 20))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 60) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic curve, by Newton's method."""
    z = np.c_[np.ones(len(x)), x]
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Model:
    """What scoring needs: dictionaries, curve and the share of good labels."""

    def __init__(self, dictionaries: tuple[bytes, bytes] | None, mean, scale, weights, prior: float):
        self.dictionaries, self.mean, self.scale, self.weights, self.prior = dictionaries, mean, scale, weights, prior

    def scores(self, features: np.ndarray) -> np.ndarray:
        z = np.c_[np.ones(len(features)), (features - self.mean) / self.scale] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(dictionaries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sizes(*dictionaries)
        for b in batches:
            f = [own.features(t) for _, _, texts in slices(b.column(1)) for t in texts]
            yield pa.record_batch([b.column(0), pa.array([x for x, _ in f], pa.float64()), pa.array([y for _, y in f], pa.float64())], ["label", "x", "y"])

    return run


def _cut(text: str, size: int) -> list[bytes]:
    """A sample text in parts of ``size`` bytes for the dictionary's trainer."""
    data = text.encode("utf-8", "replace")
    return [data[i : i + size] for i in range(0, len(data), size)]


def fit(docs: DataFrame, labels: DataFrame, sample: int = 2000, part_bytes: int = 2000, longest: int = 8000, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks 0 or 1.

    ``sample`` texts of each class teach the dictionaries and as many others the
    curve.  Of a text beyond ``longest`` characters the dictionaries learn a
    stretch of that length, so the driver holds 2 x sample x longest characters
    at most; the curve learns from whole texts.  A key with several labels has the smallest, one
    with several texts the smallest of them, ties by hash go to the smaller key:
    a repeated run learns the same.  With one class only, or none, the model
    knows no more than the share of good labels (0.5 with none).
    """
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_key")).agg(F.min(label).cast("int").alias("label"))
    kind = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    total = sum(kind.values())
    prior = kind.get(1, 0) / total if total else 0.5
    flat = Model(None, None, None, None, prior)
    if len(kind) < 2:
        return flat
    # The lowest hashes of each class, found before any text is read: 2 x sample keys of each class at most.
    hashed = marks.withColumn("h", F.xxhash64("_key"))
    chosen = None
    for c in (0, 1):
        own = lowest(hashed.filter(F.col("label") == c), F.col("h"), 2 * sample, kind[c], "_key")
        chosen = own if chosen is None else chosen.unionByName(own)
    keys = [(r["_key"], r["label"], i % 2) for i, r in enumerate(chosen.collect())]
    spark = docs.sparkSession
    wanted = spark.createDataFrame(keys, "_key long, label int, part int")
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(wanted), "_key").groupBy("_key", "label", "part").agg(F.min("_text").alias("_text"))
    rows = materialise(rows, "taught")
    begin = F.pmod(F.xxhash64("_key", F.lit("stretch")), F.greatest(F.length("_text") - longest, F.lit(0)) + 1).cast("int") + 1
    stretch = F.substring("_text", begin, F.lit(longest)).alias("_text")
    taught = sorted((r["label"], r["_key"], r["_text"]) for r in rows.filter("part = 0").select("label", "_key", stretch).collect())
    parts = {c: [x for own, _, text in taught if own == c for x in _cut(text, part_bytes)] for c in (0, 1)}
    del taught
    if not (parts[0] and parts[1]):
        return flat
    dictionaries = tuple(train_dictionary(parts[c]) for c in (0, 1))
    seen = rows.filter("part = 1").select("label", "_text").mapInArrow(_features(dictionaries), "label int, x double, y double").collect()
    if len({r["label"] for r in seen}) < 2:
        return flat
    x, y = np.array([(r["x"], r["y"]) for r in seen]), np.array([r["label"] for r in seen], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = logistic((x - mean) / scale, y)
    # The sample has its classes in other shares than the labels; the intercept is moved by the difference of the log odds.
    share = y.mean()
    w[0] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return Model(dictionaries, mean, scale, w, prior)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1.

    Null texts are empty; an empty text has the score of a text that compresses
    to nothing.  Texts of any length are compressed whole, block by block.  An
    empty table gives an empty result.  Every row is scored alone, so repeated rows agree.  All other
    columns are kept, but one with the same name is replaced.
    """
    if model.dictionaries is None:
        return docs.withColumn(name, F.lit(float(model.prior)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Sizes(*shared.value.dictionaries)
        for column in columns:
            found = [own.features(t) for _, _, texts in slices(column) for t in texts]
            yield pa.array(shared.value.scores(np.array(found).reshape(-1, 2)), pa.float64())

    return docs.withColumn(name, run(F.col(text).cast("string")))

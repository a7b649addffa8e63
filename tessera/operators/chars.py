"""Logistic regression on character n-grams, kept as words.

N-grams lie within words, so a document's counts are those of its words, each
times the n-grams it holds.  A block of documents has the words of each of them
with their counts, and the n-grams of every word once; a pass sums the weights
by word first and then the words by document, and goes back the same way.  What
is shuffled are counts by n-gram; in a pass the driver gets a number for each
n-gram of the vocabulary from every core, whatever the number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import eda, linear, packed
from tessera.plans.kept import written

#: Characters of an n-gram; a word has at least three with its spaces.
LOW, HIGH = 3, 5
#: N-grams of documents that are counted at a time.
CELLS = 1 << 17
#: Documents, and words of documents, that the driver has of the training rows, about.
NEAR, NEAR_WORDS = 4000, 2_000_000


def grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``placed`` but for the places."""
    return placed(words)[:3]


def placed(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """How many n-grams every word has, their codes, and the names of the codes, as ``text.char_ngrams`` forms them; none for an empty word.  And where each begins in all words together; of one word shorter ones stand first.

    An n-gram's key is the code of what stands before its last character and
    that one, so no strings are made but for the names.
    """
    length = pc.utf8_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.where(length > 0, sum(np.maximum(length + 3 - n, 1) for n in range(LOW, HIGH + 1)), 0)
    full = np.flatnonzero(length)
    text = np.frombuffer(f" {' '.join(words.take(pa.array(full)).to_pylist())} ".encode("utf-32-le"), np.uint32)
    seen = np.zeros(0x110000, bool)
    seen[text] = True
    marks = np.flatnonzero(seen)
    letters, c, size = pa.array(map(chr, marks), pa.string()), (np.cumsum(seen) - 1)[text], length[full] + 2
    # A space ends a word and begins the next; at each place but the last: its word, how far it is within, what is left of it.
    word = np.repeat(np.arange(len(full)), size - 1)
    within = np.arange(len(word)) - (np.cumsum(size - 1) - size + 1)[word]
    left, slot = size[word] - within, (np.cumsum(sizes) - sizes)[full]
    at = np.arange(len(word))
    key, room, gram, names, below = c[at], len(marks), np.empty(sizes.sum(), np.int64), [], 0
    begins = np.empty(len(gram), np.int64)
    for n in range(2, HIGH + 1):
        on = left[at] >= n
        at, key = at[on], key[on]
        key, room = key * len(marks) + c[at + n - 1], room * len(marks)
        if n < LOW:
            continue
        coded = pa.array(key).dictionary_encode()
        key, room = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        to = slot[word[at]] + within[at]
        gram[to], begins[to] = key + below, at
        slot += np.maximum(size - n + 1, 1)
        # A word of n characters stands for its longer ones too.
        whole = size[word[at]] == n
        for k in range(HIGH - n):
            to = slot[word[at[whole]]] + k
            gram[to], begins[to] = key[whole] + below, at[whole]
        place = np.empty(room, np.int64)
        place[key] = at
        names.append(pc.binary_join_element_wise(*[letters.take(pa.array(c[place + j])) for j in range(n)], ""))
        below += room
    return sizes, gram, pa.concat_arrays(names), begins


class Prefixes:
    """The longest known n-gram at a place of a word stands for those that begin there: the known ones that begin it, and each as often as a short word has it."""

    def __init__(self, terms: list[str]):
        at = {t: i for i, t in enumerate(terms)}
        self.times = np.array([HIGH - len(t) + 1 if t[0] == t[-1] == " " else 1 for t in terms], float)
        parent = np.array([next((at[t[:n]] for n in range(len(t) - 1, LOW - 1, -1) if t[:n] in at), -1) for t in terms], np.int64)
        size = np.array([len(t) for t in terms], np.int64)
        self.levels = [(own, parent[own]) for n in range(LOW + 1, HIGH + 1) for own in [np.flatnonzero((size == n) & (parent >= 0))]]

    def up(self, weights: np.ndarray) -> np.ndarray:
        """What each stands for; the intercept stays."""
        v = weights.copy()
        v[: len(self.times)] *= self.times
        for own, parent in self.levels:
            v[own] += v[parent]
        return v

    def down(self, sums: np.ndarray) -> np.ndarray:
        """Sums by n-gram of sums by longest one."""
        v = sums.copy()
        for own, parent in reversed(self.levels):
            v += np.bincount(parent, v[own], len(v))
        return v * self.times


def cells(row: np.ndarray, word: np.ndarray, n: np.ndarray, sizes: np.ndarray, gram: np.ndarray, most: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, n-gram and count of every n-gram of the documents, some documents at a time; a single one is never cut.

    ``row``, ``word`` and ``n`` are the words' counts, by rising row.  Numbers of
    document, n-gram and count are sorted as one.
    """
    k, first = sizes[word], np.cumsum(sizes) - sizes
    ends, a = np.cumsum(k), 0
    wide, deep = int(gram.max(initial=0)).bit_length(), int(n.max(initial=1)).bit_length()
    gram = gram.astype(np.int32) if wide < 32 else gram  # half as much to look up
    while a < len(row):
        b = int(np.searchsorted(ends, ends[a] - k[a] + most, "right"))
        if b < len(row):
            b = int(max(np.searchsorted(row, row[b]), np.searchsorted(row, row[a], "right")))
        own = k[a:b]
        at = np.arange(own.sum()) + np.repeat(first[word[a:b]] - np.cumsum(own) + own, own)
        key = np.repeat((row[a:b] - row[a]) << wide, own)
        key |= gram[at]
        if int(row[b - 1] - row[a]).bit_length() + wide + deep < 63:
            both = np.sort(key << deep | np.repeat(n[a:b], own))
            key = both >> deep
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            key, count = key[start], np.add.reduceat(both & ((1 << deep) - 1), start) if len(start) else start
        else:
            key, of = np.unique(key, return_inverse=True)
            count = np.bincount(of, np.repeat(n[a:b], own), len(key)).astype(np.int64)
        yield row[a] + (key >> wide), key & ((1 << wide) - 1), count
        a = b


def _split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, with the words of content instead of it: cut at what Java's \\s matches."""
    words = pc.ascii_split_whitespace(batch.column("content"))
    rest = [c for c in batch.schema.names if c != "content"]
    yield from packed.slices(pa.record_batch([*[batch.column(c) for c in rest], words], [*rest, "words"]), "words")


def vocabulary(docs: DataFrame, features: int, min_df: int = 2) -> DataFrame:
    """(term, i, tf, df): the most frequent n-grams of ``docs`` (content), numbered by term; ties by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _split(batch):
                row, word, n, names = packed.entries(b.column("words"), False)
                sizes, gram, terms = grams(names)
                tf, df = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
                for _, g, count in cells(row, word, n, sizes, gram):
                    tf += np.bincount(g, count, len(terms)).astype(np.int64)
                    df += np.bincount(g, minlength=len(terms))
                yield pa.record_batch([terms, pa.array(tf), pa.array(df)], ["term", "tf", "df"])

    found = docs.select("content").mapInArrow(run, "term string, tf long, df long")
    return linear.numbered(eda.ranked_vocabulary(found.withColumn("grp", F.lit(0)), min_df, features), "tf", "df")


def _block(words: pa.Array, known: pa.Array, idf: np.ndarray, longest: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The words of documents with their counts, the words' n-grams that are known, the length of each document's weights; the sums of squared weights by n-gram.

    With ``longest`` only the longest of the n-grams that begin at one place.
    """
    row, word, n, names = packed.entries(words, False)
    sizes, code, terms, begins = placed(names)
    gram = pc.index_in(terms, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[gram >= 0], minlength=len(sizes))
    gram, begins, on = gram[gram >= 0], begins[gram >= 0], sizes[word] > 0
    # Only words with such n-grams stay.
    row, word, n, sizes = row[on], (np.cumsum(sizes > 0) - 1)[word[on]], n[on], sizes[sizes > 0]
    norm, square = np.ones(len(words)), np.zeros(len(idf))
    for r, g, count in cells(row, word, n, sizes, gram):
        w, low = (count * idf[g]) ** 2, r[0]
        total = np.bincount(r - low, w)
        square += np.bincount(g, w / total[r - low], len(idf))
        own = np.flatnonzero(total)
        norm[low + own] = np.sqrt(total[own])
    if longest and len(gram):
        last, of = np.full(begins.max() + 1, -1), np.zeros(begins.max() + 1, np.int64)
        last[begins], of[begins] = gram, np.repeat(np.arange(len(sizes)), sizes)
        sizes, gram = np.bincount(of[last >= 0], minlength=len(sizes)), last[last >= 0]
    return {"entries": np.bincount(row, minlength=len(words)), "word": word, "n": n, "sizes": sizes, "gram": gram, "norm": norm}, square


#: What a block holds: one value a document (entries, norm, label), a word of a document (word, n), a word (sizes), the longest n-gram at a place of a word (gram), a term (square).
BLOCK = {"entries": np.int32, "word": np.int32, "n": np.int32, "sizes": np.int32, "gram": np.int32, "norm": np.float64, "label": np.float64, "square": np.float64}


def _kinds(d: int) -> dict[str, type]:
    return BLOCK | ({"gram": np.uint16} if d <= 1 << 16 else {})


def blocks(docs: DataFrame, terms: list[str], idf: np.ndarray) -> DataFrame:
    """``docs`` (content, label) as bytes, many documents to a row, written to the shared folder."""
    shared = docs.sparkSession.sparkContext.broadcast((terms, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scale = pa.array(shared.value[0], pa.string()), shared.value[1]
        for batch in batches:
            for b in _split(batch):
                have, square = _block(b.column("words"), known, scale, True)
                have |= {"label": b.column("label").to_numpy(zero_copy_only=False), "square": square}
                yield pa.record_batch([pa.array([have[k].astype(t).tobytes()], pa.binary()) for k, t in _kinds(len(scale)).items()], list(BLOCK))

    return written(docs.select("content", "label").mapInArrow(run, ", ".join(f"{k} binary" for k in BLOCK)), "chars")


def _margins(b: dict[str, np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margin of each document for weights already times idf, the intercept last; the document of each entry."""
    row, first = np.repeat(np.arange(len(b["norm"])), b["entries"]), np.cumsum(b["sizes"], dtype=np.int64) - b["sizes"]
    by_word = np.add.reduceat(weights[b["gram"]], first) if len(first) else np.zeros(0)
    return np.bincount(row, b["n"] * by_word[b["word"]], len(b["norm"])) / b["norm"] + weights[-1], row


def _sums(shared, d: int):
    """Slope by term and for the intercept, loss, curvature of the intercept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, y = shared.value, np.zeros(d + 3)
        for block in (r for batch in batches for r in zip(*[batch.column(k) for k in BLOCK if k != "square"], strict=True)):
            b = _read(block, d)
            sign = 2 * b["label"] - 1
            margin, row = _margins(b, weights)
            f, g, h = linear.loss("lr", sign * margin)
            g = g * sign
            by_word = np.bincount(b["word"], b["n"] * (g / b["norm"])[row], len(b["sizes"]))
            y[:d] += np.bincount(b["gram"], np.repeat(by_word, b["sizes"]), d)
            y[d:] += g.sum(), f.sum(), h.sum()
        yield pa.record_batch([pa.array([y.tobytes()], pa.binary())], ["y"])

    return run


def _squares(d: int):
    """Squared weights by term, and words of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.zeros(d + 1)
        for batch in batches:
            for square, word in zip(batch.column("square"), batch.column("word"), strict=True):
                y[:d] += np.frombuffer(square.as_buffer())
                y[d] += len(word.as_buffer()) // 4
        yield pa.record_batch([pa.array([y.tobytes()], pa.binary())], ["y"])

    return run


def _read(block, d: int) -> dict[str, np.ndarray]:
    b = {k: np.frombuffer(v.as_buffer(), t) for (k, t), v in zip(_kinds(d).items(), block, strict=False)}
    b["gram"] = b["gram"].astype(np.intp)
    return b


def _near(d: int, every: int):
    """Entries (document, n-gram, count by length) of every so many documents of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (r for batch in batches for r in zip(*[batch.column(k) for k in BLOCK if k != "square"], strict=True)):
            b = _read(block, d)
            on = np.zeros(len(b["norm"]), bool)
            on[crc32(block[0].as_buffer()) % every :: every] = True
            row = np.repeat(np.arange(len(on)), b["entries"])
            own = on[row]
            found = list(cells((np.cumsum(on) - 1)[row[own]], b["word"][own], b["n"][own].astype(np.int64), b["sizes"].astype(np.int64), b["gram"]))
            r, g, n = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64) for _ in range(3))
            have = [np.bincount(r, minlength=on.sum()).astype(np.int32), g.astype(np.int32), (n / b["norm"][on][r]).astype(np.float32)]
            yield pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in have], ["sizes", "gram", "value"])

    return run


class CharModel:
    """A fitted model: terms, their idf, their weights with the intercept last, and the passes it took."""

    def __init__(self, terms: list[str], idf: np.ndarray, coef: np.ndarray, passes: int):
        self.terms, self.idf, self.coef, self.passes = terms, idf, coef, passes


def fit(train: DataFrame, features: int = 30_000, c: float = 1.0, passes: int = 1000) -> CharModel:
    """Logistic regression on the TF-IDF weights of ``train`` (content, label), each document of length 1.

    The least of half the squared norm of the weights, the intercept not among
    them, plus c times the logistic losses.  Every pass takes loss and slope of
    all documents, and by them the descent ends; how a step is turned follows
    from the curvature at some of them (``NEAR``, spread over all blocks).
    """
    spark, n = train.sparkSession, train.count()
    vocab = written(vocabulary(train, features), "grams").orderBy("i").collect()  # at most ``features`` rows
    terms, d = [r["term"] for r in vocab], len(vocab)
    idf = np.array([math.log((n + 1.0) / (r["df"] + 1.0)) + 1.0 for r in vocab])
    # As many partial sums as there are cores, not one for each split of the table.
    data = blocks(train, terms, idf).coalesce(spark.sparkContext.defaultParallelism)
    *square, words = linear.total(data.select("square", "word"), _squares(d), d + 1)
    data, square = data.drop("square"), np.array(square)
    near = data.mapInArrow(_near(d, max(1, math.ceil(n / NEAR), math.ceil(words / NEAR_WORDS))), "sizes binary, gram binary, value binary").toArrow()
    sizes, gram, value = (np.concatenate([np.zeros(0, t), *(np.frombuffer(v.as_buffer(), t) for v in near.column(k))]) for k, t in (("sizes", np.int32), ("gram", np.int32), ("value", np.float32)))
    stand, scale, ridge, done = Prefixes(terms), np.r_[idf, 1.0], np.r_[np.ones(d), 0.0], 0
    near = linear.Bend("lr", np.repeat(np.arange(len(sizes)), sizes), gram, value, np.ones(len(sizes)), scale, ridge, c * n, up=stand.up, down=stand.down)
    run = linear.Turned(d + 1, near)
    while done < passes and not run.done:
        shared = spark.sparkContext.broadcast(stand.up(run.point * scale))
        y = linear.total(data, _sums(shared, d), d + 3)
        shared.unpersist()
        y[:d], bend = stand.down(y[:d]), y[d + 2]
        h = np.maximum(ridge + c * np.r_[square * bend / max(n, 1), bend], 1e-6)
        run.tell(0.5 * float((ridge * run.point**2).sum()) + c * float(y[d + 1]), ridge * run.point + c * scale * y[: d + 1], h)
        done += 1
    return CharModel(terms, idf, run.x, done)


def scores(docs: DataFrame, model: CharModel, system: str = "lr") -> DataFrame:
    """(doc_id, system, label, pred, proba) of ``docs`` (doc_id, label, content)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.idf, model.coef))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf, coef = shared.value
        known, weights = pa.array(terms, pa.string()), coef * np.r_[idf, 1.0]
        for batch in batches:
            for b in _split(batch):
                m, _ = _margins(_block(b.column("words"), known, idf)[0], weights)
                yield pa.record_batch([b.column("doc_id"), b.column("label"), pa.array(m)], ["doc_id", "label", "m"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    p = 1 / (1 + F.exp(-F.col("m")))
    return docs.select("doc_id", "label", "content").mapInArrow(run, f"doc_id {kind}, label int, m double").select("doc_id", F.lit(system).alias("system"), "label", (p > 0.5).cast("int").alias("pred"), p.alias("proba"))

"""Toxicity by a string-kernel support vector machine.

The kernel of two strings counts the subsequences of three characters that they
share, each weighted by ``DECAY`` for every letter it skips and by ``EASY`` for
every space or sign, over at most ``SPAN`` characters.  ``idiot``, ``i.d.i.o.t`` and ``idxiot`` have many in common,
other words few.  The machine sees strings through Nyström landmarks: words of
labelled texts, chosen one after another by how much their class uses them times
what the landmarks before do not explain of them.

It learns from labelled sentences, as multiple-instance machines do: a toxic
text need only have one toxic place, so the best window of its sentences, of a
few characters (``LENGTHS``), stands for it, while the best windows of a clean text's
sentences are all examples against.  Choice and fit take turns; hard clean
windows are kept.

A decision is a sum over landmarks, hence over subsequences: the machine folds
into one table with a weight for each three characters, exactly, and a text is
scored in one pass over its characters whatever the number of landmarks.  The
score of a text is that of its best window on a calibrated curve.  Scoring is
one pass over the table without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowest, materialise, slices
from .zstd_quality import logistic

DECAY, EASY, SPAN = 0.6, 0.9, 7
#: Lengths of windows, in places where a subsequence begins.
LENGTHS = (4, 8, 12)
WINDOW = LENGTHS[-1]
#: Places of the second and third character after the first.
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
#: Classes of characters: none, white space, signs and digits, three of letters that are rare in the sample.
NONE, SPACE, SIGN, RARE, OWN = 0, 1, 2, 3, 6
_LETTERS = 58
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_STEP = 1 << 18


class Alphabet:
    """Classes of characters; upper and lower case are one letter."""

    def __init__(self, texts: list[str]):
        seen = Counter(c for t in texts for c in t.lower() if c.isalpha())
        own = {c: OWN + i for i, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:_LETTERS])}
        self.size = OWN + len(own)
        self.table = np.array([self._of(chr(i), own) for i in range(1 << 16)], np.int32)

    @staticmethod
    def _of(c: str, own: dict[str, int]) -> int:
        small = c.lower()
        if small in own:
            return own[small]
        return SPACE if c.isspace() else RARE + ord(c) % 3 if c.isalpha() else SIGN

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Classes of all characters, each text followed by a gap that nothing spans, and where the texts start."""
        gap = "\0" * (WINDOW + SPAN)
        sizes = np.fromiter((len(t) + len(gap) for t in texts), np.int64, len(texts))
        points = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.where(points < 1 << 16, self.table[points & 0xFFFF], RARE).astype(np.int32)
        starts = np.cumsum(sizes) - sizes
        ends = starts + sizes - len(gap)
        for k in range(len(gap)):
            out[ends + k] = NONE
        return out, starts


def triples(c: np.ndarray, size: int, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, triple, weight) of the subsequences that begin within ``length`` places of each start."""
    at = (starts[:, None] + np.arange(length)[None, :]).ravel()
    row = np.repeat(np.arange(len(starts)), length)
    c = np.r_[c, np.zeros(length + SPAN, np.int32)]
    cost = np.where(c > SIGN, DECAY, EASY)
    rows, found, weights = [], [], []
    skipped = np.ones(len(at))
    for a, b in OFFSETS:
        if a == 1:
            skipped = skipped * cost[at + b - 1]
        x, y, z = c[at], c[at + a], c[at + b]
        ok = (x > NONE) & (y > NONE) & (z > NONE)
        rows.append(row[ok])
        found.append((x[ok].astype(np.int64) * size + y[ok]) * size + z[ok])
        weights.append((skipped / cost[at + a])[ok])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(weights)


def windows(c: np.ndarray, table: np.ndarray, size: int) -> np.ndarray:
    """The highest value of a window that starts at each place: weights of the subsequences that begin in it."""
    out = np.empty(len(c), np.float64)
    # Steps overlap by what a window reads, so that memory is bounded and the pieces stay in cache.
    reach = WINDOW + SPAN
    padded = np.r_[c, np.zeros(reach, np.int32)]
    for lo in range(0, len(c), _STEP):
        n = min(_STEP, len(c) - lo) + WINDOW
        own = padded[lo : lo + n + SPAN]
        own = np.r_[own, np.zeros(n + SPAN - len(own), np.int32)] if len(own) < n + SPAN else own
        first, value = own[:n] * (size * size), np.zeros(n, np.float32)
        middle, cost = own * size, np.where(own > SIGN, np.float32(DECAY), np.float32(EASY))
        gain, skipped = 1 / cost, np.ones(n, np.float32)
        for b in range(2, SPAN):
            skipped = skipped * cost[b - 1 : b - 1 + n]
            found = np.zeros(n, np.float32)
            for a in range(1, b):
                found += table.take(first + middle[a : a + n] + own[b : b + n]) * gain[a : a + n]
            value += skipped * found
        total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        m = min(_STEP, len(c) - lo)
        best = total[WINDOW : WINDOW + m]
        for n in LENGTHS[:-1]:
            best = np.maximum(best, total[n : n + m])
        out[lo : lo + m] = best - total[:m]
    # What begins in a gap belongs to no text.
    out[c == NONE] = 0
    return out


def features(words: list[str], alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """The triples of the words, and the words' weights of them with norm 1."""
    codes, starts = alphabet.codes(words)
    row, triple, weight = triples(codes, alphabet.size, starts, max(map(len, words)))
    columns, place = np.unique(triple, return_inverse=True)
    z = np.bincount(row * len(columns) + place, weight, len(words) * len(columns)).reshape(len(words), len(columns))
    return columns, z / np.maximum(np.sqrt((z**2).sum(1)), 1e-12)[:, None]


class Strings:
    """Kernel features of strings over the triples that the landmarks have."""

    def __init__(self, landmarks: list[str], alphabet: Alphabet):
        self.alphabet = alphabet
        self.columns, self.z = features(landmarks, alphabet)
        value, vector = np.linalg.eigh(self.z @ self.z.T)
        keep = value > 1e-6 * value.max()
        #: Turns kernel values with the landmarks into Nyström coordinates.
        self.root = vector[:, keep] / np.sqrt(value[keep])
        #: Turns weights of the landmarks into those of the coordinates.
        self.back = (vector[:, keep] * np.sqrt(value[keep])).T

    def best(self, codes: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Nyström coordinates of the highest window that starts at each place."""
        every = np.stack([self.coordinates(codes, starts, n) for n in LENGTHS])
        return every[(every @ weights).argmax(0), np.arange(len(starts))]

    def coordinates(self, codes: np.ndarray, starts: np.ndarray, length: int = WINDOW) -> np.ndarray:
        """Nyström coordinates of the windows that start at these places."""
        out = np.zeros((len(starts), self.root.shape[1]))
        basis = self.z.T @ self.root
        for lo in range(0, len(starts), 1024):
            own = starts[lo : lo + 1024]
            row, triple, weight = triples(codes, self.alphabet.size, own, length)
            place = np.minimum(np.searchsorted(self.columns, triple), len(self.columns) - 1)
            ok = self.columns[place] == triple
            dense = np.bincount(row[ok] * len(self.columns) + place[ok], weight[ok], len(own) * len(self.columns)).reshape(len(own), len(self.columns))
            out[lo : lo + 1024] = dense @ basis
        return out

    def fold(self, weights: np.ndarray) -> np.ndarray:
        """The table of triples' weights that stands for a machine over the coordinates."""
        table = np.zeros(self.alphabet.size**3, np.float32)
        table[self.columns] = self.z.T @ (self.root @ weights)
        return table


def squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear support vector machine with squared hinge loss, by Newton's method."""
    z, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    ridge = np.r_[np.ones(x.shape[1]), 1e-3]
    lost = lambda w: 0.5 * (ridge * w**2).sum() + (cost * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()
    now = lost(w)
    for _ in range(steps):
        gap = 1 - y * (z @ w)
        at = gap > 0
        slope = ridge * w - 2 * z[at].T @ (cost[at] * y[at] * gap[at])
        step = np.linalg.solve(np.diag(ridge) + 2 * (z[at] * cost[at][:, None]).T @ z[at], slope)
        rate = 1.0
        while (then := lost(w - rate * step)) > now and rate > 1e-4:
            rate /= 2
        w, before, now = w - rate * step, now, then
        if before - now < 1e-8 * before:
            break
    return w[:-1], float(w[-1])


def choose_landmarks(texts: list[str], toxic: np.ndarray, alphabet: Alphabet, each: int, most: int = 400) -> tuple[list[str], list[str]]:
    """Up to ``each`` words of toxic and of clean texts.

    Toxic words by the toxic texts they explain that no two words before do,
    less their share of clean ones: a word that only stands beside an insult
    explains nothing.  Clean words by their texts, times what the kernel with
    the words before leaves of them.
    """
    own = [{w[: WINDOW + 4] for w in t.lower().split()} for t in texts]
    clean = Counter(w for s, y in zip(own, toxic.tolist(), strict=True) if not y for w in s)
    bad = [s for s, y in zip(own, toxic.tolist(), strict=True) if y]
    df = Counter(w for s in bad for w in s)
    n = len(bad), max(1, len(own) - len(bad))
    able = sorted(w for w, k in df.items() if k >= 2 and k / n[0] > 4 * (clean[w] + 0.5) / (n[1] + 1))
    place = {w: i for i, w in enumerate(able)}
    doc, word = (np.array(x, np.int64) for x in zip(*[(d, place[w]) for d, s in enumerate(bad) for w in s if w in place], strict=True)) if able else (np.empty(0, np.int64),) * 2
    against = np.array([clean[w] * n[0] / n[1] for w in able])
    explained, taken = np.zeros(n[0], np.int64), []
    for _ in range(min(each, len(able))):
        gain = np.bincount(word, explained[doc] < 2, len(able)) - 2 * against
        gain[taken] = 0
        k = int(gain.argmax())
        if gain[k] < max(2, n[0] / 500):
            break
        taken.append(k)
        explained[doc[word == k]] += 1
    chosen = [" " + able[k] for k in taken]
    words = [f" {w}" for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0]))[:most]]
    words = [w for w in words if w not in chosen]
    basis: list[int] = []
    if words:
        _, z = features(words, alphabet)
        left, value = z @ z.T, np.sqrt([clean[w[1:]] for w in words])
        for _ in range(min(each, len(words))):
            k = int((value * np.diag(left)).argmax())
            if left[k, k] < 0.0025:
                break
            basis.append(k)
            left = left - np.outer(left[:, k], left[k]) / left[k, k]
    return chosen, [words[k] for k in basis]


def _best(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest window of each string and where it begins."""
    top = np.maximum.reduceat(values, starts)
    sizes = np.diff(np.r_[starts, len(values)])
    hit = np.flatnonzero(values == np.repeat(top, sizes))
    return top, hit[np.searchsorted(hit, starts)]


def train(texts: list[str], toxic: np.ndarray, landmarks: int = 96, rounds: int = 5, cost: float = 1.0) -> tuple[Alphabet, np.ndarray]:
    """The alphabet and the folded table of a machine learned from labelled texts."""
    split = [[s for s in _SENTENCES.split(t) if s.strip()] for t in texts]
    alphabet = Alphabet(texts)
    bad_words, clean_words = choose_landmarks(texts, toxic, alphabet, landmarks)
    names = bad_words + clean_words
    if not names:
        return alphabet, np.zeros(alphabet.size**3, np.float32)
    strings = Strings(names, alphabet)
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in split])
    codes, starts = alphabet.codes([" " + s for t in split for s in t])
    # The first choice of windows: nearness to words of toxic texts.
    weight = strings.back @ np.where(np.arange(len(names)) < len(bad_words), 1.0, -0.1)
    # These words are examples too, so that none is hidden by others in its texts.
    marked = strings.coordinates(*alphabet.codes(bad_words)) if bad_words else np.empty((0, strings.root.shape[1]))
    kept = np.empty((0, strings.root.shape[1]))
    for _ in range(rounds):
        top, place = _best(windows(codes, strings.fold(weight), alphabet.size), starts)
        order = np.lexsort((-top, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        bad, good = toxic[owner[order]] & (rank < 1), ~toxic[owner[order]] & (rank < 3)
        positive = np.r_[marked, strings.best(codes, place[order][bad], weight)]
        kept = np.r_[kept, strings.best(codes, place[order][good], weight)]
        x, y = np.r_[positive, kept], np.r_[np.ones(len(positive)), -np.ones(len(kept))]
        costs = np.where(y > 0, cost / max(1, len(positive)), cost / max(1, len(kept))) * 1000
        weight, _ = squared_hinge(x, y, costs)
    return alphabet, strings.fold(weight)


class Model:
    """What scoring needs: classes of characters, weights of triples, the curve, and the share of toxic labels."""

    def __init__(self, alphabet: Alphabet | None, table: np.ndarray | None, curve: np.ndarray | None, prior: float):
        self.alphabet, self.table, self.curve, self.prior = alphabet, table, curve, prior

    def values(self, texts: list[str]) -> np.ndarray:
        """The best window of each text; 0 for a text without any."""
        if not texts:
            return np.empty(0)
        codes, starts = self.alphabet.codes([" " + t for t in texts])
        return np.maximum.reduceat(windows(codes, self.table, self.alphabet.size), starts)

    def scores(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * values, -30, 30)))


def learn(texts: list[str], toxic: np.ndarray, prior: float, folds: int = 3) -> Model:
    """A machine on all texts, and a curve on the values of texts that machines did not learn from."""
    if not (toxic.any() and (~toxic).any()):
        return Model(None, None, None, prior)
    fold, values = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for c in (True, False):
        own = np.flatnonzero(toxic == c)
        fold[own] = np.arange(len(own)) % folds
    known = np.zeros(len(texts), bool)
    for k in range(folds):
        own, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not (toxic[own].any() and (~toxic[own]).any() and len(out)):
            continue
        part = Model(*train([texts[i] for i in own], toxic[own]), None, prior)
        values[out], known[out] = part.values([texts[i] for i in out]), True
    alphabet, table = train(texts, toxic)
    if not (toxic[known].any() and (~toxic[known]).any()):
        values, known = Model(alphabet, table, None, prior).values(texts), np.ones(len(texts), bool)
    curve = logistic(values[known][:, None], toxic[known].astype(float), ridge=1e-3)
    share = toxic[known].mean()
    curve[0] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return Model(alphabet, table, curve, prior)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 1500, longest: int = 6000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks 0 or 1.

    At most ``sample`` texts of each class reach the driver, those of the lowest
    hashes of their keys; shorter ones than ``longest`` characters come first,
    and of a longer one a stretch of that length does.  A key with several
    labels has the smallest, one with several texts the smallest of them: a
    repeated run learns the same.  With one class only, or none, the model knows
    no more than the share of toxic labels (0.5 with none).
    """
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_key")).agg(F.min(label).cast("int").alias("label"))
    kind = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    total = sum(kind.values())
    prior = kind.get(1, 0) / total if total else 0.5
    if len(kind) < 2:
        return Model(None, None, None, prior)
    hashed, chosen = marks.withColumn("h", F.xxhash64("_key")), None
    for c in (0, 1):
        own = lowest(hashed.filter(F.col("label") == c), F.col("h"), 2 * sample, kind[c], "_key").select("_key", "label", "h")
        chosen = own if chosen is None else chosen.unionByName(own)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    # 2 x sample keys of each class at most.
    rows = rows.join(F.broadcast(chosen), "_key").groupBy("_key", "label", "h").agg(F.min("_text").alias("_text"))
    room = F.length("_text") - longest
    begin = F.when(room > 0, F.pmod(F.col("h"), F.greatest(room, F.lit(1)))).otherwise(0).cast("int")
    cut = materialise(rows.select("_key", "label", "h", (room > 0).alias("cut"), F.substring("_text", begin + 1, F.lit(longest)).alias("_text")), "taught")
    taught = [r for c in (0, 1) for r in cut.filter(F.col("label") == c).orderBy("cut", "h", "_key").limit(sample).collect()]
    return learn([r["_text"] for r in taught], np.array([r["label"] == 1 for r in taught], bool), prior)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1, higher: more likely toxic.

    Null texts are empty, and empty ones have the value of a text without
    subsequences.  Texts of any length are read whole.  Every row is scored
    alone, so repeated rows agree.  All other columns are kept, but one with the
    same name is replaced.  An empty table gives an empty result.
    """
    if model.table is None:
        return docs.withColumn(name, F.lit(float(model.prior)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = [shared.value.values(texts) for _, _, texts in slices(column, 1_000_000)]
            yield pa.array(shared.value.scores(np.concatenate(found) if found else np.empty(0)), pa.float64())

    return docs.withColumn(name, run(F.col(text).cast("string")))

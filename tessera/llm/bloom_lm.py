"""Language-model scoring from a log-frequency Bloom filter.

Counts are quantised to levels: the first few counts have one each, then levels
grow by a constant factor.  An n-gram of level q is put into the filter with
each level from 1 to q.  A count is read back by membership probes of growing
levels and then between the last two, so it is never underestimated, and
overestimated with probability 2^-k a probe.  With c~ the middle of a level's
counts, the score of a text is the sum over its tokens v after u of

    log10((min(c~(uv), Z(u)) + mu * p(v)) / (Z(u) + mu)),
    p(v) = (c~(v) + 0.5) / (N~ + 0.5 * (V + 1))

where Z(u) is the sum of c~(uv) over all v, itself in the filter at fine
levels, and N~ the sum of c~(v): the probabilities of what may follow u add up
to 1 but for false positives and Z's rounding.

Words that many texts share are told from a bounded sample, and are no keys of
any group: their counts are summed by chunk, and their exact totals and Z, a few
numbers for each, go to all workers.  For other words and bigrams one shuffle
gathers the corpus: map tasks aggregate hashed n-grams and send packed arrays to
segments, whose number follows the number of documents, so that a segment's
work stays the same as the corpus grows.  A segment sums its counts, builds its
own part of the filter, and for words returns the exact sums that the base score
needs; all bigrams of a context that is not common are in one segment, with its
Z.  The filter is broadcast in runs of segments below ``max_filter_bytes`` for
words and for bigrams; if they do not fit in one run each, the texts are scored
once for each pair of runs and the sums are added, so the broadcast stays
bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import chunks, lower_words, materialise, slices

#: Hashes of the two tokens that are no words.
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that a task scores together: some forty bytes of arrays a byte.
SCORED = 2_000_000
#: Bits of a bigram's key within its segment: for a common context its number and 30 bits of the pair, else 22 bits each of context and pair.
KEY_BITS, COMMON_BITS = 45, 14
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on all of ``x``."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the lengths."""
    rows, n = [], []
    for t in texts:
        words = lower_words(t)
        h = np.empty(len(words) + 1, _U)
        h[:-1] = np.fromiter(map(xxh64_intdigest, words), _U, len(words))
        h[-1] = END
        rows.append(h)
        n.append(len(h))
    return (np.concatenate(rows) if rows else np.empty(0, _U)), np.array(n, np.int64)


def place_in(common: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each hash's place among the sorted common ones, -1 if it is none of them."""
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return np.where(common[at] == hashes, at, -1)


def bigrams(tokens: np.ndarray, n: np.ndarray, common: np.ndarray, words: np.ndarray, place: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment << KEY_BITS | key) of each token after the one before it, and that context's place among the common words.

    ``words[place]`` are the tokens.
    """
    begin, own = int(place_in(common, np.array([BEGIN]))[0]), place_in(common, words)
    first = np.cumsum(n) - n
    before, context = np.empty_like(tokens), np.empty(len(tokens), np.int64)
    before[1:], context[1:] = tokens[:-1], own[place[:-1]]
    before[first], context[first] = BEGIN, begin
    pair, shift = mix(before * _U(3) + mix(tokens)), _U(64 - int(math.log2(segments)))
    often = (pair >> shift << _U(KEY_BITS)) | _U(1 << 44) | (np.maximum(context, 0).astype(_U) << _U(30)) | (pair & _U((1 << 30) - 1))
    left = mix(before)
    return np.where(context >= 0, often, context_keys(left, shift) << _U(22) | (pair & _U((1 << 22) - 1))), context


def context_keys(mixed: np.ndarray, shift) -> np.ndarray:
    """(segment << 23 | context) of a context that is not common."""
    return (mixed >> shift << _U(KEY_BITS - 22)) | (mixed & _U((1 << 22) - 1))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)
    return starts, np.diff(np.r_[starts, len(sorted_values)])


def _pack(*arrays: np.ndarray) -> list[bytes]:
    z = zstandard.ZstdCompressor(level=1)
    return [z.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _six(keys: np.ndarray) -> np.ndarray:
    """The low six bytes of each key, as planes."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T


def _from_six(data: bytes) -> np.ndarray:
    planes = _unpack(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").ravel()


def common_words(rows: DataFrame, n: int, most: int, sample: int) -> np.ndarray:
    """Sorted hashes of the words that most texts of a sample share, of both marks too.

    The sample is what a hash of the row lets through, ``sample`` rows or so of
    the ``n``; a word counts if it is in a thousandth of it and in two texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, texts in slices(b.column(0)):
                tokens, size = hashed(texts)
                at = np.repeat(np.arange(len(size)), size)
                words, place = np.unique(tokens, return_inverse=True)
                per = np.bincount(np.unique(place * len(size) + at) // len(size), minlength=len(words))
                yield pa.record_batch([pa.array(words.view(np.int64)), pa.array(per)], ["word", "n"])

    share = min(1.0, sample / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64("rid", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    seen = drawn.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = seen.filter(F.col("n") >= max(2, share * n / 1000)).orderBy(F.desc("n"), "word").limit(most).collect()
    words = np.array([r["word"] for r in found], np.int64).view(_U)
    return np.union1d(words[: max(0, most - 2)], np.array([BEGIN, END]))


# -- gathering -------------------------------------------------------------

_GATHERED = "kind int, seg long, chunk long, x binary, y binary, z binary, w binary, learn binary"


def _gather(common, n_bi: int, n_uni: int, flush: int = 800_000):
    """Map side: rows (kind, segment, chunk, packed arrays) of about ``flush`` tokens.

    kind 1: bigram keys and counts of training texts.  kind 0: hashes of words
    that are not common, entries per hash, and for each entry the text's place in
    the chunk and its count; learn: which texts of the chunk are for training.
    kind 3: the ids of the chunk's texts.  kind 4: counts of the common words.
    """
    uni_shift = _U(64 - int(math.log2(n_uni)))

    def one(chunk: int, rids: list[tuple], train: list[bool], texts: list[str]) -> Iterator[pa.RecordBatch]:
        tokens, n = hashed(texts)
        texts.clear()
        at = np.repeat(np.arange(len(n), dtype=np.int64), n)
        learn = np.array(train, bool)
        words, place = np.unique(tokens, return_inverse=True)
        often = place_in(common.value, words)
        counts = np.bincount(place, learn[at], len(words)).astype(np.int64)
        totals = np.zeros(len(common.value), np.int64)
        totals[often[often >= 0]] = counts[often >= 0]
        out: list[tuple] = [(3, chunk, chunk, *_pack(np.array(rids, np.int64)), None, None, None, None), (4, chunk, chunk, *_pack(totals), None, None, None, None)]
        keys, _ = bigrams(tokens, n, common.value, words, place, n_bi)
        keys = keys[learn[at]]
        del tokens
        keys.sort()
        starts, count = runs(keys)
        keys = keys[starts]
        edge, size = runs(keys >> _U(KEY_BITS))
        for a, k in zip(edge.tolist(), size.tolist(), strict=True):
            out.append((1, int(keys[a] >> _U(KEY_BITS)), chunk, *_pack(_six(keys[a : a + k] & _U((1 << KEY_BITS) - 1)), count[a : a + k].astype(np.uint32)), None, None, None))
        del keys, starts, count
        rare = np.flatnonzero((often < 0)[place])
        pair = place[rare] * len(n) + at[rare]
        del place, at, rare
        pair.sort()
        starts, tf = runs(pair)
        pair = pair[starts]
        per = np.bincount(pair // len(n), minlength=len(words))
        ends = np.cumsum(per)
        doc = (pair % len(n)).astype(np.uint16 if len(n) <= 1 << 16 else np.uint32)
        (marks,) = _pack(np.packbits(learn))
        some = np.flatnonzero(per)
        words, per, ends = words[some], per[some], ends[some]
        edge, size = runs(words >> uni_shift)
        for a, k in zip(edge.tolist(), size.tolist(), strict=True):
            lo, hi = int(ends[a] - per[a]), int(ends[a + k - 1])
            out.append((0, int(words[a] >> uni_shift), chunk, *_pack(words[a : a + k], per[a : a + k].astype(np.uint32), doc[lo:hi], tf[lo:hi].astype(np.uint32)), marks))
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        for lo in range(0, len(out), 4096):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[lo : lo + 4096], strict=True), kinds, strict=True)], ["kind", "seg", "chunk", "x", "y", "z", "w", "learn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rids, train, texts, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for b in batches:
            for lo, hi, own in slices(b.column(3)):
                ids = zip(*(b.column(i).slice(lo, hi - lo).to_pylist() for i in range(3)), own, strict=True)
                for rid, other, learn, text in ids:
                    rids.append((rid, other))
                    train.append(learn)
                    texts.append(text)
                    size += len(text) // 6 + 1
                    if size >= flush:
                        yield from one(chunk, rids, train, texts)
                        chunk, rids, train, texts, size = chunk + 1, [], [], [], 0
        if rids:
            yield from one(chunk, rids, train, texts)

    return run


class Levels:
    """Levels of counts: least[j] is the smallest count of level j + 1; value[j] what level j reads as."""

    def __init__(self, base: float, most: int = 1 << 50):
        least = [1]
        while least[-1] < most:
            least.append(max(least[-1] + 1, math.ceil(least[-1] * base)))
        self.least = np.array(least, np.int64)
        self.value = np.r_[0.0, (self.least[:-1] + self.least[1:] - 1) / 2, float(least[-1])]

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.least, counts, side="right")


COUNTS, SUMS = Levels(1.25), Levels(1.05)


def _salt(level: int) -> np.uint64:
    return _U(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)


def _positions(keys: np.ndarray, level, bits, k: int) -> Iterator[np.ndarray]:
    h = mix(keys + _salt(level))
    a, b = h & _U(0xFFFFFFFF), (h >> _U(32)) | _U(1)
    for i in range(k):
        yield (((a + _U(i) * b) & _U(0xFFFFFFFF)) * bits) >> _U(32)


def _filter(keys: np.ndarray, level: np.ndarray, k: int) -> np.ndarray:
    """Bits of one segment: sized by what goes in, 1.44 k bits an insertion."""
    m = max(64, math.ceil(1.4427 * k * int(level.sum()) / 8) * 8)
    if m >= 1 << 32:
        raise ValueError("a segment has too many n-grams: lower docs_per_segment")
    bits = np.zeros(m, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for p in _positions(keys[level >= j], j, _U(m), k):
            bits[p.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


#: Marks the key of a context's Z.
_Z = _U(1 << 46)
_BUILT = "kind int, seg long, bits binary, tokens long, types long, mass double, chunk long, doc binary, logs binary, known binary, rids binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("seg", pa.int64()), ("bits", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("mass", pa.float64()), ("chunk", pa.int64()), ("doc", pa.binary()), ("logs", pa.binary()), ("known", pa.binary()), ("rids", pa.binary())])


def _build_bigrams(seg: int, keys: np.ndarray, counts: np.ndarray, k: int) -> list[dict]:
    """The filter of a segment's bigrams and contexts; kind 5: its part of the common contexts' Z."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts, _ = runs(keys)
    total, keys = np.add.reduceat(counts[order], starts), keys[starts]
    level = COUNTS.of(total)
    value, often = COUNTS.value[level], keys >> _U(44) > 0
    at = ((keys[often] >> _U(30)) & _U((1 << COMMON_BITS) - 1)).astype(np.int64)
    sums = np.bincount(at, value[often]) if len(at) else np.empty(0)
    some = np.flatnonzero(sums)
    # Keys are sorted, so those of a context stand together.
    contexts = keys[~often] >> _U(22)
    starts, _ = runs(contexts)
    z = SUMS.of(np.rint(np.add.reduceat(value[~often], starts)).astype(np.int64)) if len(starts) else np.empty(0, np.int64)
    bits = _filter(np.concatenate([keys, contexts[starts] | _Z]), np.concatenate([level, z]), k)
    parts = dict(zip(("doc", "logs"), _pack(some.astype(np.uint32), sums[some]), strict=True))
    return [{"kind": 1, "seg": seg, "bits": bits.tobytes()}, {"kind": 5, "seg": seg} | parts]


def _build(k: int):
    """Reduce side: the filter of one segment, and base sums of its chunks' texts."""

    def run(key: tuple, batch: pa.Table) -> pa.Table:
        kind, seg = key[0].as_py(), key[1].as_py()
        chunk = batch["chunk"].to_pylist()
        x = batch["x"].to_pylist()
        if kind in (3, 4):
            return pa.Table.from_pylist([{"kind": kind, "chunk": c, "rids": v} for c, v in zip(chunk, x, strict=True)], _SCHEMA)
        y = [_unpack(v, np.uint32).astype(np.int64) for v in batch["y"].to_pylist()]
        if kind == 1:
            return pa.Table.from_pylist(_build_bigrams(seg, np.concatenate([_from_six(v) for v in x]), np.concatenate(y), k), _SCHEMA)
        keys, z, w = np.concatenate([_unpack(v, _U) for v in x]), batch["z"].to_pylist(), batch["w"].to_pylist()
        learn = [np.unpackbits(_unpack(v, np.uint8)).astype(bool) for v in batch["learn"].to_pylist()]

        def entries(i: int) -> tuple[np.ndarray, np.ndarray]:
            tf = _unpack(w[i], np.uint32).astype(np.int64)
            doc = zstandard.ZstdDecompressor().decompress(z[i])
            return np.frombuffer(doc, np.uint16 if len(doc) == 2 * len(tf) else np.uint32), tf

        found = []
        for i, per in enumerate(y):
            doc, tf = entries(i)
            found.append(np.bincount(np.repeat(np.arange(len(per)), per), tf * learn[i][doc], len(per)).astype(np.int64))
        counts = np.concatenate(found)
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
        starts, size = runs(sorted_keys)
        total = np.add.reduceat(counts[order], starts)
        seen = total > 0
        level = COUNTS.of(total[seen])
        bits = _filter(sorted_keys[starts][seen] & _U((1 << KEY_BITS) - 1), level, k)
        out = [{"kind": kind, "seg": seg, "bits": bits.tobytes(), "tokens": int(total.sum()), "types": int(seen.sum()), "mass": float(COUNTS.value[level].sum())}]
        back = np.empty(len(keys), np.int64)
        back[order] = np.repeat(total, size)
        at = 0
        for i, per in enumerate(y):
            doc, tf = entries(i)
            c = np.repeat(back[at : at + len(per)], per)
            at += len(per)
            own, local = np.unique(doc, return_inverse=True)
            logs, known = np.bincount(local, tf * np.log10(c + 0.5)), np.bincount(local, tf * (c > 0)).astype(np.uint32)
            packed = _pack(own.astype(np.uint32), logs, known)
            out.append({"kind": 2, "seg": seg, "chunk": chunk[i]} | dict(zip(("doc", "logs", "known"), packed, strict=True)))
        return pa.Table.from_pylist(out, _SCHEMA)

    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by common word of the rows of kind 4 (counts) and 5 (Z)."""
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for kind, doc, logs, rids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            own = sums.setdefault(kind, np.zeros(1 << COMMON_BITS))
            if kind == 4:
                counts = _unpack(rids, np.int64)
                own[: len(counts)] += counts
            else:
                own[_unpack(doc, np.uint32)] += _unpack(logs, np.float64)
    for kind, own in sums.items():
        at = np.flatnonzero(own)
        yield pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(own[at])], ["kind", "place", "value"])


def _sum_chunk(key: tuple, batch: pa.Table) -> pa.Table:
    """Base sums of a chunk's texts over all segments."""
    rows = batch.to_pylist()
    rids = next(_unpack(r["rids"], np.int64).reshape(-1, 2) for r in rows if r["rids"] is not None)
    logs, known = np.zeros(len(rids)), np.zeros(len(rids), np.int64)
    for r in sorted((r for r in rows if r["rids"] is None), key=lambda r: r["seg"]):
        at = _unpack(r["doc"], np.uint32)
        logs[at] += _unpack(r["logs"], np.float64)
        known[at] += _unpack(r["known"], np.uint32)
    return pa.table({"rid": rids[:, 0].copy(), "other": rids[:, 1].copy(), "logs": logs, "known": known})


# -- scoring ---------------------------------------------------------------


class Filter:
    """Segments [lo, hi) of a filter, ready for probes."""

    def __init__(self, parts: dict[int, bytes], lo: int, hi: int, k: int):
        self.lo, self.hi, self.k = lo, hi, k
        size = np.zeros(hi - lo, np.int64)
        for seg, bits in parts.items():
            size[seg - lo] = len(bits)
        self.start, self.bits = (np.cumsum(size) - size).astype(_U) * _U(8), size.astype(_U) * _U(8)
        self.data = np.frombuffer(b"".join(parts[s] for s in sorted(parts)), np.uint8)

    def holds(self, seg: np.ndarray) -> np.ndarray:
        return (seg >= self.lo) & (seg < self.hi)

    def _has(self, keys: np.ndarray, level: np.ndarray, start: np.ndarray, bits: np.ndarray) -> np.ndarray:
        live = np.arange(len(keys))
        h = mix(keys + level.astype(_U) * _U(0xD6E8FEB86659FD93))
        a, b = h & _U(0xFFFFFFFF), (h >> _U(32)) | _U(1)
        for i in range(self.k):
            p = ((((a[live] + _U(i) * b[live]) & _U(0xFFFFFFFF)) * bits[live]) >> _U(32)) + start[live]
            live = live[(self.data[(p >> _U(3)).astype(np.int64)] >> (p & _U(7)).astype(np.uint8)) & 1 > 0]
        out = np.zeros(len(keys), bool)
        out[live] = True
        return out

    def counts(self, seg: np.ndarray, keys: np.ndarray, levels: Levels) -> np.ndarray:
        """Quantised counts of keys in segments of this run; 0: not seen."""
        start, bits, level = self.start[seg - self.lo], self.bits[seg - self.lo], np.zeros(len(keys), np.int64)
        top = len(levels.least)
        over = np.full(len(keys), top + 1)

        def probe(at: np.ndarray, j: np.ndarray) -> np.ndarray:
            ok = self._has(keys[at], j, start[at], bits[at])
            level[at[ok]], over[at[~ok]] = j[ok], j[~ok]
            return at[ok]

        at, j = np.flatnonzero(bits), 1
        while len(at) and j <= top:
            at, j = probe(at, np.full(len(at), j)), 2 * j
        at = np.flatnonzero((level > 0) & (over - level > 1))
        while len(at):
            probe(at, (level[at] + over[at]) // 2)
            at = at[over[at] - level[at] > 1]
        return levels.value[level]


class Model:
    """What scoring needs besides the filter: common words, their counts and Z, and sizes."""

    def __init__(self, common, counts, z, mass: float, types: int, mu: float, n_uni: int, n_bi: int):
        self.common, self.counts, self.z, self.mass, self.types, self.mu, self.n_uni, self.n_bi = common, counts, z, mass, types, mu, n_uni, n_bi

    def score(self, uni: Filter, bi: Filter, tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 of each token's probability, 0 where its word or bigram is not in the runs; exact counts of common words, else -1."""
        words, place = np.unique(tokens, return_inverse=True)
        often = place_in(self.common, words)
        seg = (words >> _U(64 - int(math.log2(self.n_uni)))).astype(np.int64)
        here = np.where(often >= 0, uni.lo == 0, uni.holds(seg))  # common words count with the first run
        c, rare = np.where(often >= 0, self.counts[often], 0.0), np.flatnonzero((often < 0) & here)
        c[rare] = uni.counts(seg[rare], words[rare] & _U((1 << KEY_BITS) - 1), COUNTS)
        p = (c + 0.5) / (self.mass + 0.5 * (self.types + 1))
        # Z of the words as contexts; that of one that is not common is in the segment of its bigrams.
        z, mixed = np.where(often >= 0, self.z[often], 0.0), context_keys(mix(words), _U(64 - int(math.log2(self.n_bi))))
        seg = (mixed >> _U(KEY_BITS - 22)).astype(np.int64)
        rare = np.flatnonzero((often < 0) & bi.holds(seg))
        z[rare] = bi.counts(seg[rare], (mixed[rare] & _U((1 << 23) - 1)) | _Z, SUMS)
        grams, _ = bigrams(tokens, n, self.common, words, place, self.n_bi)
        context, first = np.empty(len(tokens)), np.cumsum(n) - n
        context[1:] = z[place[:-1]]
        context[first] = self.z[place_in(self.common, np.array([BEGIN]))[0]]
        seg = (grams >> _U(KEY_BITS)).astype(np.int64)
        own = np.flatnonzero(bi.holds(seg) & here[place])
        seen = bi.counts(seg[own], grams[own] & _U((1 << KEY_BITS) - 1), COUNTS)
        value = np.zeros(len(tokens))
        value[own] = np.log10((np.minimum(seen, context[own]) + self.mu * p[place[own]]) / (context[own] + self.mu))
        return value, np.where(often >= 0, self.counts[often], -1.0)[place]


def _score(model, uni, bi, base: bool):
    """Sums, per text, over the tokens in the runs of segments; with ``base``, what common words add to the base score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in slices(b.column(4), SCORED, 1 << 16):
                tokens, n = hashed(texts)
                value, counts = model.value.score(uni.value, bi.value, tokens, n)
                first, often = np.cumsum(n) - n, (counts >= 0) & base
                logs, known = np.add.reduceat(np.where(often, np.log10(np.maximum(counts, 0) + 0.5), 0.0), first), np.add.reduceat((often & (counts > 0)).astype(np.int64), first)
                yield pa.record_batch([*(b.column(i).slice(lo, hi - lo) for i in range(4)), pa.array(np.add.reduceat(value, first)), pa.array(n), pa.array(logs), pa.array(known)], ["rid", "other", "key", "train", "score", "n_tokens", "logs", "known"])

    return run


def _power(n: float, least: int, most: int) -> int:
    return 1 << min(most.bit_length() - 1, max(least.bit_length() - 1, math.ceil(math.log2(max(n, 1)))))


def score_texts(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", k: int = 6, mu: float = 8.0, docs_per_segment: int = 1000, max_filter_bytes: int = 256 << 20, common: int = (1 << COMMON_BITS) - 2, sample: int = 8192) -> DataFrame:
    """Per row: key, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` is a boolean column: the rows to learn from.  Null and empty
    texts are one end token; texts of any length are read whole.  Repeated rows
    get equal results and count as often as they occur.  Null keys stay null.
    With no training rows all counts are 0.  An empty table gives an empty
    result; other columns are not read.  ``common`` words at most are told from
    ``sample`` rows or so; which they are changes no count, only where it is
    kept.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    # 128 bits tell rows apart.
    parts = (F.coalesce("key", F.lit(-1)), F.col("key").isNull(), F.col("train"), F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"rid": F.xxhash64(*parts), "other": F.xxhash64(F.lit("other"), *parts)})
    size = rows.agg(F.count("*").alias("n"), F.count_if("train").alias("train")).first()
    n_bi = _power(size["n"] / docs_per_segment, 16, 1 << 19)
    n_uni = max(8, n_bi // 8)
    names = common_words(rows, size["n"], min(common, (1 << COMMON_BITS) - 2), sample)
    shared = spark.sparkContext.broadcast(names)
    gathered = rows.select("rid", "other", "train", "text").mapInArrow(_gather(shared, n_bi, n_uni), _GATHERED)
    built = materialise(gathered.groupBy("kind", "seg").applyInArrow(_build(k), _BUILT), "lm")
    sums = built.filter("kind in (4, 5)").select("kind", "doc", "logs", "rids").mapInArrow(_add_up, "kind int, place long, value double")
    counts, z = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for r in sums.groupBy("kind", "place").agg(F.sum("value").alias("value")).collect():  # two rows a common word
        (counts if r["kind"] == 4 else z)[r["place"]] = r["value"]
    parts = built.filter("kind < 2")
    facts = parts.filter("kind = 0").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"), F.sum("mass").alias("mass")).first()
    n_tokens, types = int(facts["tokens"] or 0) + int(counts.sum()), int(facts["types"] or 0) + int((counts > 0).sum())
    model = spark.sparkContext.broadcast(Model(names, counts, z, (facts["mass"] or 0.0) + counts.sum(), types, mu, n_uni, n_bi))

    def edges(kind: int, segments: int) -> list[tuple[int, int]]:
        """Runs of segments; together they cover all, those without a part too, so that each token is scored once."""
        found = [(r["seg"], r["bytes"]) for r in parts.filter(F.col("kind") == kind).select("seg", F.length("bits").alias("bytes")).orderBy("seg").collect()]
        at = [0, *[found[a][0] for a, _ in chunks((n for _, n in found), max_filter_bytes, 1 << 30)][1:], segments]
        return list(zip(at, at[1:], strict=False))

    def load(kind: int, lo: int, hi: int):
        found = parts.filter((F.col("kind") == kind) & (F.col("seg") >= lo) & (F.col("seg") < hi)).select("seg", "bits").toLocalIterator()
        return spark.sparkContext.broadcast(Filter({r["seg"]: bytes(r["bits"]) for r in found}, lo, hi, k))

    packed = built.filter("kind in (2, 3)").select("chunk", "seg", "rids", "doc", "logs", "known")
    found = packed.groupBy("chunk").applyInArrow(_sum_chunk, "rid long, other long, logs double, known long")
    found = found.select("rid", "other", *[F.lit(None).cast(t).alias(c) for c, t in (("key", "long"), ("train", "boolean"), ("score", "double"), ("n_tokens", "long"))], "logs", "known")
    times, schema = 0, "rid long, other long, key long, train boolean, score double, n_tokens long, logs double, known long"
    for of_words in edges(0, n_uni):
        uni = load(0, *of_words)
        for of_pairs in edges(1, n_bi):
            part = rows.select("rid", "other", "key", "train", "text").mapInArrow(_score(model, uni, load(1, *of_pairs), times == 0), schema)
            found, times = found.unionByName(part), times + 1
    # Rows of one id are alike, so they share their sums and are told apart again by their number.
    copies = (F.count("n_tokens") / F.lit(times)).cast("int").alias("times")
    per = found.groupBy("rid", "other").agg(copies, F.max("key").alias("key"), F.max("train").alias("train"), F.max("n_tokens").alias("n_tokens"), F.sum("score").alias("score"), F.sum("logs").alias("logs"), F.sum("known").alias("known"))
    scale = math.log10(n_tokens + 0.5 * (types + 1))
    return per.select(
        F.col("key").alias(key),
        "train",
        "n_tokens",
        (F.col("known") / F.col("times")).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") / F.col("times") - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("score") / F.col("times")).alias("score"),
        F.explode(F.sequence(F.lit(1), "times")).alias("copy"),
    ).drop("copy")

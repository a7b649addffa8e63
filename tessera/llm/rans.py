"""Token files coded with a static range asymmetric numeral system.

One frequency table, counted over all texts and scaled to 2^20, is shared by
all blocks.  A block holds the ids of whole consecutive texts, dealt in turn to
up to 1024 interleaved coder states.  States are 64 bits with 32-bit
renormalisation.  Every 256 steps the states and the place in the words are
kept as a checkpoint, so the stretches of a block are decoded side by side, and
each block carries the crc32 of its ids and its words.

A dataset is a folder: ``freqs`` (id, freq) and ``blocks``, with one file for
each ``part=P/stretch=S``.  P is a range of keys and S a stretch of its texts,
both with leading zeros, so that files in the order of their names, and blocks
in the order of a file, have ascending keys.  The rows are written by Spark's
own writer, so any store works and a lost executor costs its tasks only.

The library encodes each text once: texts are ordered by key first, then
encoded to a table of plain ids, which has the counts that give the frequencies
and which the coder reads in the same order.  That table is emptied at the end.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import release, slices, work_dir
from .pieces import Generations, PieceCache, lay_out

SCALE, LANES, EVERY, BLOCK = 20, 1024, 256, 1 << 20
#: Chunks of plain ids in a file, about 2 MB of text each: such a file is one row group, so one task reads all of it, in order.
STRETCH = 32
LOW = np.uint64(1 << 31)
_U = np.uint64


# -- the coder -------------------------------------------------------------


def scaled(counts: np.ndarray, bits: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2^bits, at least 1 where a count is."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * ((1 << bits) / total))), 0).astype(np.int64)
    if (freq > 0).sum() > 1 << bits:
        raise ValueError("more ids than slots")
    while (rest := (1 << bits) - int(freq.sum())) != 0:
        if rest > 0:
            freq[np.argmax(freq)] += rest
        else:
            big = np.flatnonzero(freq > 1)
            share = np.minimum(freq[big] - 1, np.maximum(1, (-rest * freq[big]) // max(1, int(freq[big].sum()))))
            over = np.cumsum(share) - share
            freq[big] -= np.where(over < -rest, np.minimum(share, np.maximum(0, -rest - over)), 0)
    return freq


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(_U)
        self.cum = (np.cumsum(freq) - freq).astype(_U)
        self.slot = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> dict:
        """A block: lanes, words, and the checkpoints' places and states."""
        n = len(ids)
        lanes = min(LANES, 1 << max(0, (n // 64).bit_length() - 1)) if n else 1
        steps = -(-n // lanes)
        f, c = self.freq[ids], self.cum[ids]
        if n and not f.all():
            raise ValueError("an id has no frequency")
        x = np.full(lanes, LOW, _U)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        done, shift, top = 0, _U(SCALE), _U(63 - SCALE)
        for s in range(steps - 1, -1, -1):
            a, b = s * lanes, min(n, (s + 1) * lanes)
            own, fs = x[: b - a], f[a:b]
            full = own >= (fs << top)
            if full.any():
                out = own[full]
                words.append(out.astype("<u4"))
                done += len(out)
                own = np.where(full, own >> _U(32), own)
            q = own // fs
            x[: b - a] = (q << shift) + (own - q * fs) + c[a:b]
            if s % EVERY == 0:
                marks.append((done, x.copy()))
        flat = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
        marks.reverse()
        return {"n": n, "lanes": lanes, "words": flat.tobytes(), "places": [done - d for d, _ in marks], "states": b"".join(m.astype("<u8").tobytes() for _, m in marks), "crc": zlib.crc32(ids.astype("<u4").tobytes()), "words_crc": zlib.crc32(flat.tobytes())}

    def decode(self, block: dict, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the stretches [first, last) between checkpoints, side by side."""
        n, lanes, places = block["n"], block["lanes"], np.array(block["places"], np.int64)
        if zlib.crc32(block["words"]) != block["words_crc"]:
            raise ValueError("block is damaged")
        words = np.frombuffer(block["words"], "<u4").astype(_U)
        words = np.concatenate([words, np.zeros(lanes, _U)])
        last = len(places) if last is None else last
        if not n or first >= last:
            return np.empty(0, np.uint32)
        x = np.frombuffer(block["states"], "<u8").reshape(len(places), lanes)[first:last].copy()
        at = places[first:last].copy()
        steps = -(-n // lanes)
        long = min(EVERY, steps - first * EVERY)
        out = np.zeros((last - first, long, lanes), np.uint32)
        low, shift = _U((1 << SCALE) - 1), _U(SCALE)
        for s in range(long):
            live = np.arange(first, last) * EVERY + s < steps
            k = int(live.sum())  # the last stretch can be shorter
            slot = x[:k] & low
            ids = self.slot[slot.astype(np.int64)]
            out[:k, s] = ids
            y = self.freq[ids] * (x[:k] >> shift) + slot - self.cum[ids]
            if k and (first + k - 1) * EVERY + s == steps - 1:
                # Lanes past the block's end keep their state.
                y[k - 1, n - (steps - 1) * lanes :] = x[k - 1, n - (steps - 1) * lanes :]
            need = y < LOW
            place = np.cumsum(need, axis=1) + (at[:k, None] - 1)
            y = np.where(need, (y << _U(32)) | words[np.where(need, place, 0)], y)
            at[:k] += need.sum(1)
            x[:k] = y
        flat = out.reshape(-1)
        return flat[: min(n, last * EVERY * lanes) - first * EVERY * lanes]


# -- the library's ids -----------------------------------------------------

#: All texts with a run of white space that is cut otherwise (and perhaps a few more), for RE2.
_RUNS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]{3}|[\s\x0b\x1c-\x1f\x{85}\pZ]{2}\z"

#: Other white space than the lead, or what a special string may begin with.
_NOT_PLAIN = r"[\s\x0b\x1c-\x1f\x{85}\pZ<]"


class Encoder:
    """Ids of texts as packed little-endian 16- or 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        if any(s[0] != "<" for s in self.special):
            raise ValueError(f"{path}: special strings are expected to begin with <")
        self.leads = {c: np.zeros(self.tok.get_vocab_size(), bool) for c in "ĠĊ"}
        for token, i in self.tok.get_vocab().items():
            if token[:1] in self.leads:
                self.leads[token[0]][i] = True
        self.kept, self.firsts = Generations(700_000), Generations(50_000)
        self.cache = PieceCache(self._piece, 50_000)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.tok.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()

    def _many(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as if alone; pieces of one kind are encoded as one text.

        A piece here is what stands between a space or newline, its lead, and
        the next, without other white space or special strings; each begins
        with the only token in it that starts with its lead.
        """
        out: list[bytes] = [b""] * len(pieces)
        plain = pc.invert(pc.match_substring_regex(pc.utf8_slice_codeunits(pa.array(pieces, pa.string()), 1), _NOT_PLAIN)).to_numpy(zero_copy_only=False)
        left = np.ones(len(pieces), bool)
        for lead, mark in ((" ", "Ġ"), ("\n", "Ċ")):
            own = [i for i in np.flatnonzero(plain).tolist() if pieces[i][0] == lead and len(pieces[i]) > 1]
            groups = [own[i : i + 500] for i in range(0, len(own), 500)]
            for at in range(0, len(groups), 16):
                few = groups[at : at + 16]
                for group, e in zip(few, self.tok.encode_batch_fast(["".join([pieces[i] for i in g]) for g in few], add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, self.kind)
                    starts = np.flatnonzero(self.leads[mark][ids])
                    if len(starts) == len(group):
                        data, edges = ids.tobytes(), [*(starts * self.kind.itemsize).tolist(), len(ids) * self.kind.itemsize]
                        for i, a, b in zip(group, edges, edges[1:], strict=False):
                            out[i] = data[a:b]
                        left[group] = False
        for i in np.flatnonzero(left).tolist():
            out[i] = self._piece(pieces[i]) if pieces[i] else b""
        return out

    def encode_rows(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, ``end`` after each, and the rows' lengths.

        Arrow cuts the texts and numbers the distinct pieces, so that only
        these are looked up one by one; numpy lays their ids out in order.
        """
        odd = pc.match_substring_regex(column, _RUNS)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        parts = pc.split_pattern(pc.replace_substring(pc.if_else(odd, "", column), "\n", " \n"), " ")
        flat, bounds = parts.flatten(), np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy())])
        heads = bounds[:-1]
        # A text's first piece has no space before it; an odd text is one piece.
        coded = flat.take(pa.array(heads)).dictionary_encode()
        firsts = self.firsts.values(_python(coded.dictionary), lambda new: [self._piece(x) if x else b"" for x in new])
        first_at = coded.indices.to_numpy().astype(np.int64)
        coded = flat.dictionary_encode()
        values = self.kept.values(_python(coded.dictionary), lambda new: self._many([x if x[:1] == "\n" else " " + x for x in new]))
        at = coded.indices.to_numpy().astype(np.int64)
        at[heads] = len(values) + first_at
        values += firsts
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        at[heads[whole]] = len(values) + np.arange(len(whole))
        values += [self.encode(t) for t in column.take(pa.array(whole)).to_pylist()]
        values.append(np.array([end], self.kind).tobytes())
        at = np.insert(at, bounds[1:], len(values) - 1)
        ids, own = lay_out(values, at, self.kind)
        return ids, np.add.reduceat(own, heads + np.arange(len(column)))

    def encode(self, text: str) -> bytes:
        for s, i in self.special.items():
            if s in text:
                return np.array([i], self.kind).tobytes().join(map(self.encode, text.split(s)))
        return b"".join(self.cache.values_of(text))


def _python(column: pa.Array) -> list[str]:
    """Strings of an Arrow column without nulls; much faster than ``to_pylist``."""
    return column.to_numpy(zero_copy_only=False).tolist()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _planes(data: bytes, size: int) -> bytes:
    return np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes()


def _ids(path: str, end: int):
    """Chunks of rows in key order: keys, lengths and ids; last the counts of a task's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        z, width, total = zstandard.ZstdCompressor(level=1), own.kind.itemsize, np.zeros(own.tok.get_vocab_size(), np.int64)

        def row(seq, keys, lengths, data, counts) -> pa.RecordBatch:
            return pa.record_batch([pa.array([v], f.type) for v, f in zip((part, seq, keys, lengths, data, counts), _ID_SCHEMA, strict=True)], _ID_SCHEMA)

        for b in batches:
            keys = b.column(0)
            for lo, hi, texts in slices(b.column(1), 2_000_000, 1024):
                ids, lengths = own.encode_rows(pa.array(texts, pa.string()), end)
                total += np.bincount(ids, minlength=len(total))
                yield row(seq, keys.slice(lo, hi - lo).to_pylist(), lengths, z.compress(_planes(ids.tobytes(), width)), None)
                seq += 1
        if seq:
            yield row(seq, None, None, None, z.compress(total.astype("<i8").tobytes()))

    return run


_IDS = "part int, seq long, keys array<long>, lengths array<long>, ids binary, counts binary"
_ID_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.binary())])


def _unplane(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.tobytes(), kind)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for data in b.column(0).to_pylist():
            own = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")
            total = own + (0 if total is None else total)
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["id", "n"])


_BLOCKS = "part int, seq long, keys array<long>, lengths array<long>, n long, lanes int, places array<long>, states binary, words binary, crc long, words_crc long"
_FIELDS = ("n", "lanes", "places", "states", "words", "crc", "words_crc")
_BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n", pa.int64()), ("lanes", pa.int32()), ("places", pa.list_(pa.int64())), ("states", pa.binary()), ("words", pa.binary()), ("crc", pa.int64()), ("words_crc", pa.int64())])


def _encode(freq, kind: np.dtype):
    """Blocks of about BLOCK ids of whole texts of one stretch, numbered by their first chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, first, keys, lengths, ids, n = Coder(freq.value), None, 0, [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, lengths, ids, n
            if keys:
                block = coder.encode(np.concatenate(ids))
                row = [part, first, keys, lengths, *(block[k] for k in _FIELDS)]
                yield pa.record_batch([pa.array([v], f.type) for v, f in zip(row, _BLOCK_SCHEMA, strict=True)], _BLOCK_SCHEMA)
                keys, lengths, ids, n = [], [], [], 0

        for b in batches:
            for p, q, k, size, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if keys and (p, q // STRETCH) != (part, first // STRETCH):
                    yield from flush()
                if not keys:
                    part, first = p, q
                keys += k
                lengths += size
                ids.append(_unplane(data, kind))
                n += len(ids[-1])
                if n >= BLOCK:
                    yield from flush()
        yield from flush()

    return run


def _decode(freq):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq.value)
        for b in batches:
            for row in b.to_pylist():
                ids = coder.decode(row)
                raw = ids.astype("<u4").tobytes()
                if zlib.crc32(raw) != row["crc"]:
                    raise ValueError("ids do not match their checksum")
                ends = np.cumsum(row["lengths"])
                starts = ends - np.array(row["lengths"])
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array([row["part"]] * len(crc), pa.int32()), pa.array([row["seq"]] * len(crc), pa.int64()), pa.array(row["keys"], pa.int64()), pa.array(starts), pa.array(row["lengths"], pa.int64()), pa.array(crc, pa.int64())], ["part", "seq", "key", "at", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, path: str, out: str, end: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all texts, ``end`` after each, in ascending key order.

    Null texts are empty; null keys come first; rows with equal keys stand next
    to each other, ordered by their texts' hashes.  Texts of any length are taken
    whole, and a block holds whole texts.  Other columns are not read.  An empty table writes an empty dataset.
    """
    spark = docs.sparkSession
    own = encoder(path)
    kind, vocab = own.kind, own.tok.get_vocab_size()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The text breaks ties of the range, so that a key that many rows share is dealt to many tasks.
    rows = rows.repartitionByRange(n, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    plain = f"{work_dir(spark)}/ids-{uuid.uuid4().hex}"
    rows.mapInArrow(_ids(path, end), _IDS).write.option("compression", "uncompressed").option("maxRecordsPerFile", STRETCH).parquet(plain)
    ids = spark.read.schema(_IDS).parquet(plain)
    counts = ids.filter("counts is not null").select("counts").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(vocab, np.int64)
    for r in counts:  # no more rows than the vocabulary has ids
        total[r["id"]] = r["n"]
    freq = scaled(total)
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.parquet(f"{out}/freqs")
    shared = spark.sparkContext.broadcast(freq)
    blocks = ids.filter("counts is null").select("part", "seq", "keys", "lengths", "ids").mapInArrow(_encode(shared, kind), _BLOCKS)
    # Each stretch is in one file and so in one task; its blocks stay in order.
    place = [F.format_string("%08d", F.col("part")).alias("part"), F.format_string("%08d", (F.col("seq") / STRETCH).cast("long")).alias("stretch")]
    blocks = blocks.select(*place, *[c for c in blocks.columns if c != "part"]).sortWithinPartitions("part", "stretch", "seq")
    blocks.write.partitionBy("part", "stretch").option("compression", "uncompressed").parquet(f"{out}/blocks")
    release(ids, plain)


def read_tokens(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """Decode a dataset: key, start, n_tokens, ids_crc32 of every text."""
    size = spark.read.parquet(f"{out}/freqs")
    rows = size.collect()
    freq = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(f"{_BLOCKS}, stretch int").parquet(f"{out}/blocks")
    texts = blocks.drop("stretch").mapInArrow(_decode(shared), "part int, seq long, key long, at long, n_tokens long, ids_crc32 long")
    # One row a range of keys: as many as the writer had partitions.
    sizes, before = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()), 0
    starts = []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    parts = spark.createDataFrame(starts, "part int, before long")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("part", "seq", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("within")).join(F.broadcast(parts), "part")
    return texts.join(offsets, ["part", "seq"]).select(F.col("key").alias(key), (F.col("at") + F.col("within") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

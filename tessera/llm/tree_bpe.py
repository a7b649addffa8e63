"""BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved, wherever the middles fall, until its parts
are leaves.  The leaves of many texts are encoded together, each as if it stood
alone, to tokens with their places in the text.  Then neighbours are joined,
level by level, all pairs of a level together: a window around the cut is
encoded, and grows until it has a token in common with the left side and one
with the right side, same id and same place, away from the cut and from the
window's own ends.  What lies between the two comes from the window, the rest
from the sides.  A window that has grown over both sides is the plain encoding
of them.

The join is exact.  A sequence of tokens is the BPE encoding of its text if and
only if any two neighbours are that of theirs, and the pattern that cuts words
scans forward without looking back; so from a common token on both encodings go
on alike, and all neighbours of the joined sequence are neighbours in one of
the encodings that it is made of.

Below the leaves stands a cache only: white space always ends a word here, so a
part is encoded by its pieces between spaces and newlines, and each distinct
piece is asked of the library once.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, slices
from .pieces import Generations, lay_out

def _can_cut(ch: str) -> bool:
    """Whether normalisation never joins ``ch`` to what stands before it."""
    return unicodedata.category(ch)[0] != "M" and not 0x1160 <= ord(ch) <= 0x11FF


class TreeEncoder:
    """Encodes and decodes with a tokenizers file whose words white space ends.

    Tokens are arrays with the fields id, a and b: the token stands for [a, b)
    of the text.  ``joins`` and ``grown`` count the joins made and the windows
    that had to grow.
    """

    def __init__(self, path: str, leaf: int = 4096, window: int = 256, cache: int = 300_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("decoder") is not None:
            raise ValueError(f"{path}: a file without a decoder is expected, whose texts are tokens joined by spaces")
        #: No decision of the pattern looks further than the longest special string and a few characters.
        self.margin = 32 + max([0, *(len(t["content"]) for t in spec.get("added_tokens", []))])
        self.leaf, self.window, self.joins, self.grown = max(leaf, 4 * self.margin), window, 0, 0
        size = self.tok.get_vocab_size()
        self.kind = np.dtype([("id", "<u2" if size <= 1 << 16 else "<u4"), ("a", "<i4"), ("b", "<i4")])
        self.kept = Generations(cache)
        tokens = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.decimals, self.tokens = pa.array([b"%d" % i for i in range(size)], pa.binary()), pa.array([t.encode() for t in tokens], pa.binary())

    # -- leaves and windows -----------------------------------------------

    def _library(self, pieces: list[str]) -> list[bytes]:
        """Packed tokens of pieces; the library's encodings are far larger, so few are held at a time."""
        out, wide = [], self.kind.itemsize
        for a, b in chunks(map(len, pieces), 100_000, 2048):
            found = self.tok.encode_batch(pieces[a:b], add_special_tokens=False)
            ids = [e.ids for e in found]
            ends = list(accumulate(map(len, ids), initial=0))
            own = np.empty(ends[-1], self.kind)
            own["id"] = list(chain.from_iterable(ids))
            places = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int32, 2 * ends[-1])
            own["a"], own["b"] = places[::2], places[1::2]
            packed = own.tobytes()
            out += [packed[x * wide : y * wide] for x, y in pairwise(ends)]
        return out

    def _encode(self, parts: list[str], at: list[int]) -> list[np.ndarray]:
        """Tokens of each part, as if it stood alone; ``at`` is where the part begins in its text."""
        pieces = [x.replace("\n", " ").split(" ") for x in parts]
        coded = pa.array(list(chain.from_iterable(pieces)), pa.string()).dictionary_encode()
        values = self.kept.values(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self._library)
        tokens, own = lay_out(values, coded.indices.to_numpy(), self.kind)
        # Where the pieces begin: lengths and a space each, counted anew in every part.
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sizes = pc.utf8_length(coded.dictionary).take(coded.indices).to_numpy().astype(np.int64) + 1
        begin, first = np.cumsum(sizes) - sizes, np.cumsum(n) - n
        begin += np.repeat(np.array(at, np.int64) - begin[first], n)
        shift = np.repeat(begin, own).astype(np.int32)
        tokens["a"] += shift
        tokens["b"] += shift
        return np.split(tokens, np.cumsum(np.add.reduceat(own, first))[:-1])

    # -- the tree ---------------------------------------------------------

    def _cuts(self, text: str, a: int, b: int, out: list[int]) -> None:
        if b - a <= self.leaf:
            return
        m = (a + b) // 2
        while m < b and not _can_cut(text[m]):
            m += 1
        if m < b:
            self._cuts(text, a, m, out)
            out.append(m)
            self._cuts(text, m, b, out)

    def _window(self, text: str, a: int, m: int, b: int, size: int) -> tuple[int, int]:
        lo, hi = max(a, m - size), min(b, m + size)
        while lo > a and not _can_cut(text[lo]):
            lo -= 1
        while hi < b and not _can_cut(text[hi]):
            hi += 1
        return lo, hi

    @staticmethod
    def _common(side: np.ndarray, mid: np.ndarray, lo: int, hi: int, last: bool = False) -> tuple[int, int] | None:
        """Places in both of a token they share within [lo, hi): the first, or the last."""
        x, y = np.searchsorted(side["a"], (lo, hi)).tolist()
        u, v = np.searchsorted(mid["a"], (lo, hi)).tolist()
        # Tokens of one character that takes several have one place; they are no mark.
        starts = mid["a"][u:v].tolist()
        at = {t: k for k, t in enumerate(mid[u:v].tolist(), u) if t[2] <= hi and starts.count(t[1]) == 1}
        own = side[x:y].tolist()
        for k in range(len(own) - 1, -1, -1) if last else range(len(own)):
            place = at.get(own[k])
            if place is not None and (k == 0 or own[k - 1][1] != own[k][1]) and (k + 1 == len(own) or own[k + 1][1] != own[k][1]):
                return x + k, place
        return None

    def _join(self, left: np.ndarray, right: np.ndarray, mid: np.ndarray, ends: tuple[int, int, int, int, int]) -> np.ndarray | None:
        """Tokens of [a, b) from those of [a, m) and [m, b) and of the window [lo, hi), or None if it is too small."""
        a, m, b, lo, hi = ends
        head = (0, 0) if lo == a else self._common(left, mid, lo + self.margin, m - self.margin)
        tail = (len(right), len(mid)) if hi == b else self._common(right, mid, m + self.margin, hi - self.margin, last=True)
        if head is None or tail is None:
            return None
        return np.concatenate([left[: head[0]], mid[head[1] : tail[1]], right[tail[0] :]])

    def spans(self, texts: list[str]) -> list[np.ndarray]:
        """Tokens of each text."""
        edges = []
        for t in texts:
            cuts: list[int] = []
            self._cuts(t, 0, len(t), cuts)
            edges.append([0, *cuts, len(t)])
        leaves = [(t, e[k], e[k + 1]) for t, e in zip(texts, edges, strict=True) for k in range(len(e) - 1)]
        found = iter(self._encode([t[a:b] for t, a, b in leaves], [a for _, a, _ in leaves]) if leaves else [])
        nodes = [[(e[k], e[k + 1], next(found)) for k in range(len(e) - 1)] for e in edges]
        while any(len(n) > 1 for n in nodes):
            # All pairs of neighbours of this level, by text and place.
            todo = {(i, k): self.window for i, n in enumerate(nodes) for k in range(0, len(n) - 1, 2)}
            joined: dict[tuple[int, int], np.ndarray] = {}
            self.joins += len(todo)
            while todo:
                ends = {(i, k): self._window(texts[i], nodes[i][k][0], nodes[i][k][1], nodes[i][k + 1][1], size) for (i, k), size in todo.items()}
                windows = self._encode([texts[i][lo:hi] for (i, _), (lo, hi) in ends.items()], [lo for lo, _ in ends.values()])
                for ((i, k), (lo, hi)), mid in zip(ends.items(), windows, strict=True):
                    (a, m, left), (_, b, right) = nodes[i][k : k + 2]
                    one = mid if lo == a and hi == b else self._join(left, right, mid, (a, m, b, lo, hi))
                    if one is not None:
                        joined[i, k] = one
                        del todo[i, k]
                self.grown += len(todo)
                todo = {at: 2 * size for at, size in todo.items()}
            nodes = [[(n[k][0], n[k + 1][1], joined[i, k]) if k + 1 < len(n) else n[k] for k in range(0, len(n), 2)] for i, n in enumerate(nodes)]
        return [n[0][2] for n in nodes]

    # -- texts ------------------------------------------------------------

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their numbers."""
        found = self.spans(texts)
        return np.concatenate([t["id"] for t in found]), np.array([len(t) for t in found], np.int64)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Per text: number of ids, sha256 of the ids, sha256 of the decoded text."""
        for a, b in chunks(map(len, texts), 2_000_000, 1024):
            ids, n = self.encode_many(texts[a:b])
            at = pa.array(ids)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(at)), b" ").to_pylist() for names in (self.decimals, self.tokens)]
            for size, x, y in zip(n.tolist(), *joined, strict=True):
                yield size, hashlib.sha256(x).hexdigest(), hashlib.sha256(y).hexdigest()

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as the library decodes without a decoder."""
        return b" ".join(self.tokens.take(pa.array(ids, pa.int64())).to_pylist()).decode()


@lru_cache(2)
def encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def encode_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ids array<int>, decoded string; rows as ``round_trip_digests`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for x, y, texts in slices(b.column(1)):
                ids = [own.encode(t) for t in texts]
                yield pa.record_batch([b.column(0).slice(x, y - x), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())], ["key", "ids", "decoded"])

    return _rows(docs, key, text).mapInArrow(run, "key long, ids array<int>, decoded string").withColumnRenamed("key", key)


def round_trip_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids: 0 and the sha256 of nothing, twice.
    Texts of any length are taken whole; one longer than a leaf goes through the
    tree.  Repeated rows are encoded each, null keys stay null, other columns
    are not read, an empty table gives an empty result.  One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            for x, y, texts in slices(b.column(1)):
                n, ids, decoded = zip(*own.digests(texts), strict=True)
                yield pa.record_batch([b.column(0).slice(x, y - x), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, key, text).mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)

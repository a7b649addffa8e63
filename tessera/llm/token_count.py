"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol per byte, held in a doubly linked list.  A
heap has the rank of every adjacent pair that can merge; the lowest rank,
leftmost first, is popped again and again, and each merge puts the two new
pairs on the heap.  The count is the number of initial symbols less the merges;
no identifier is looked up.  The work is O(n log n) for a pre-token of n bytes,
so unbroken texts of any length are safe.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pieces import PieceCache


def merged_length(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that are left of ``symbols`` when no more pair can merge."""
    n = len(symbols)
    if n < 2:
        return n
    part = list(symbols)
    heap = [r * n + i for i, p in enumerate(zip(part, part[1:], strict=False)) if (r := ranks.get(p)) is not None]
    if not heap:
        return n
    heapify(heap)
    after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    while heap:
        rank, i = divmod(heappop(heap), n)
        j = after[i]
        # An entry is stale if either side has merged since: the pair there has another rank now.
        if j >= n or part[i] is None or ranks.get((part[i], part[j])) != rank:
            continue
        part[i] += part[j]
        part[j] = None
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((part[i], part[k]))) is not None:
                heappush(heap, r * n + i)
        h = before[i]
        if h >= 0 and (r := ranks.get((part[h], part[i]))) is not None:
            heappush(heap, r * n + h)
    return left


class TokenCounter:
    """Counts for a byte-level BPE file of the tokenizers library (.json)."""

    def __init__(self, path: str, cache: int = 800_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path}: not a byte-level BPE without normalizer")
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.cache = PieceCache(self._piece, cache)

    def _piece(self, piece: str) -> int:
        return sum(merged_length(word, self.ranks) for word, _ in self.pre.pre_tokenize_str(piece))

    def count(self, text: str) -> int:
        for s in self.special:
            if s in text:
                parts = text.split(s)
                return len(parts) - 1 + sum(map(self.count, parts))
        return sum(self.cache.values_of(text))


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Null and empty texts have 0 bytes and 0 tokens; long ones are counted whole; a null key stays null;
    repeated rows are counted each; an empty table gives an empty result; other
    columns are not read.  One pass over the table, no shuffle.
    """
    out = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for b in batches:
            for x, y, texts in slices(b.column(1)):
                yield pa.record_batch([b.column(0).slice(x, y - x), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()), pa.array(list(map(own.count, texts)), pa.int64())], out)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.mapInArrow(run, "key long, n_bytes long, n_tokens long")
    return rows.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

"""Cuts of a text at places where a byte-level pre-tokenizer always cuts.

The pre-tokenizer pattern ends in ``\\s+(?!\\S)|\\s+`` and lets one space lead a
word, so in a run of white space it cuts before the run and before its last
character when a word follows.  A cut there never changes the tokens, whatever
the rest of the text, and the pieces repeat so often that their encodings are
worth keeping.  Runs of three or more, and runs of two at the end of the text,
are only cut outside.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

_LONG_RUN = re.compile(r"\s{3}|\s{2}\Z")
_SINGLE = re.compile(r"(?<=\S)(?=[ \n]\S)")


class PieceCache(dict):
    """Values of pieces, by key; ``make(piece)`` gives what is missing.

    A key stands for a space and itself, or for itself if it starts with a
    newline.  ``exact`` holds pieces that stand for themselves only.  Both are
    emptied at ``limit`` entries and long pieces are not kept, so that memory
    stays bounded whatever the vocabulary.
    """

    def __init__(self, make, limit: int = 800_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest, self.exact = make, limit, longest, {}

    def __missing__(self, key: str):
        value = self.make(key if key[:1] == "\n" else " " + key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value

    def plain(self, piece: str):
        value = self.exact.get(piece)
        if value is None:
            value = self.make(piece)
            if len(piece) <= self.longest:
                if len(self.exact) >= self.limit:
                    self.exact.clear()
                self.exact[piece] = value
        return value

    def values_of(self, text: str) -> list:
        """Values of the pieces of a text without special strings, in order."""
        if _LONG_RUN.search(text):
            return [self.plain(x) for x in _SINGLE.split(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        values = [self.plain(first)] if first else []
        values.extend(map(self.__getitem__, rest))
        return values


class Generations:
    """Values by key in two generations: memory stays bounded, and keys that come again stay."""

    def __init__(self, limit: int = 400_000, longest: int = 64):
        self.limit, self.longest, self.young, self.old = limit, longest, {}, {}

    def values(self, keys: list[str], make: Callable[[list[str]], list]) -> list:
        """Values of distinct keys; ``make`` gives those of the keys that aren't kept."""
        out = list(map(self.young.get, keys))
        gaps = [i for i, v in enumerate(out) if v is None]
        if not gaps:
            return out
        wanted = [keys[i] for i in gaps]
        found = list(map(self.old.get, wanted))
        made = iter(make([k for k, v in zip(wanted, found, strict=True) if v is None]))
        found = [next(made) if v is None else v for v in found]
        for i, v in zip(gaps, found, strict=True):
            out[i] = v
        if len(self.young) + len(gaps) > self.limit:
            self.old, self.young = self.young, {}
        self.young.update((k, v) for k, v in zip(wanted, found, strict=True) if len(k) <= self.longest)
        return out


def lay_out(values: list[bytes], at: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``values[i]`` for each i of ``at``, one after another, and their numbers."""
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize
    places = np.cumsum(sizes) - sizes
    data, own = np.frombuffer(b"".join(values), kind), sizes[at]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.arange(total) - np.repeat(ends - own - places[at], own)], own

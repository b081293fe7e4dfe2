"""Token ids of distinct words, kept between batches in a worker process."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa


class WordStore:
    """Maps words to id lists and expands word sequences to id sequences by one gather.

    `encode(words)` returns the ids of each word, flat, and their counts. What is kept is
    bounded: beyond `limit` words those used once go, and, if that is not enough, all but
    the most used half. To forget a word costs time only.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts = np.zeros(1 << 14, np.int64)
        self.uses = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _forget(self) -> None:
        """Keep the words that are used most."""
        n = len(self.slots)
        least = 2 if (self.uses[:n] >= 2).sum() <= self.limit // 2 else int(np.partition(self.uses[:n], -(self.limit // 2))[-(self.limit // 2)]) + 1
        keep = np.flatnonzero(self.uses[:n] >= least)
        words = list(self.slots)
        kept, counts, uses = [words[i] for i in keep.tolist()], self.counts[keep], self.uses[keep]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.starts[keep] - (ends - counts), counts) + np.arange(total)]
        self._clear()
        m = len(kept)
        self.slots = dict(zip(kept, range(m), strict=True))
        self.flat = self._room(self.flat, total)
        self.flat[:total] = flat
        self.used = total
        for name, values in (("starts", ends - counts), ("counts", counts), ("uses", uses // 2)):
            setattr(self, name, self._room(getattr(self, name), m))
            getattr(self, name)[:m] = values

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, words: list[str]) -> None:
        if not words:
            return
        ids, counts = self.encode(words)
        n, m = len(self.slots), len(words)
        self.flat = self._room(self.flat, self.used + len(ids))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts, self.counts, self.uses = (self._room(x, n + m) for x in (self.starts, self.counts, self.uses))
        self.starts[n : n + m] = self.used + np.cumsum(counts) - counts
        self.counts[n : n + m] = counts
        self.used += len(ids)
        self.slots.update(zip(words, range(n, n + m), strict=True))

    def expand(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the word lists, flat, and the number of ids of each list."""
        return self.expand_flat(pa.array(chain.from_iterable(texts), pa.string()), np.fromiter(map(len, texts), np.int64, len(texts)))

    def expand_flat(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one array of words that holds `sizes` words a list; each different word is looked up once."""
        if len(self.slots) > self.limit:
            self._forget()
        coded = words.dictionary_encode()
        different, place = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.add([w for w in different if w not in self.slots])
        own = np.fromiter(map(self.slots.__getitem__, different), np.int64, len(different))
        self.uses[own] += np.bincount(place, minlength=len(own))
        slots = own[place]
        counts = self.counts[slots]
        ends = np.cumsum(counts)
        flat = self.flat[np.repeat(self.starts[slots] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)]
        at = np.append(0, ends)[np.append(0, np.cumsum(sizes))]
        return flat, np.diff(at)

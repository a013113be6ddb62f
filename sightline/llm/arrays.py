"""Lists of numbers and of bytes as flat arrays, for work on many words at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Lists:
    """Lists of numbers in one array: ``n`` numbers each, from ``start`` on."""

    def __init__(self, flat: np.ndarray, n: np.ndarray) -> None:
        self.flat, self.n = flat, n.astype(np.int64)
        self.start = np.cumsum(self.n) - self.n

    @classmethod
    def of(cls, lists: list[list[int]]) -> Lists:
        return cls(np.array([x for some in lists for x in some], dtype=np.int64), np.array([len(some) for some in lists], dtype=np.int64))

    def take(self, at: np.ndarray) -> Lists:
        n = self.n[at]
        first = np.cumsum(n) - n
        return Lists(self.flat[np.repeat(self.start[at] - first, n) + np.arange(n.sum())], n)

    def joined(self, n: np.ndarray) -> Lists:
        """The first n[0] lists as one, the next n[1] as one, and so on."""
        ends = np.concatenate(([0], np.cumsum(self.n)))[np.concatenate(([0], np.cumsum(n)))]
        return Lists(self.flat, np.diff(ends))

    def __add__(self, other: Lists) -> Lists:
        return Lists(np.concatenate((self.flat, other.flat)), np.concatenate((self.n, other.n)))

    def lists(self) -> list[list[int]]:
        return [self.flat[a : a + n].tolist() for a, n in zip(self.start, self.n)]


def bytes_of_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, where each begins, and how many it has."""
    words = words.cast(pa.large_binary())
    _, ends, data = words.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8), at[:-1], np.diff(at)

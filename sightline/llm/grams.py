"""The words of many texts as arrays, for counting sequences of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text whose words are held as arrays at once, about; a longer text is taken alone.
SECTION = 8_000_000
#: Keys that a task holds before it sends their sums on, about.
HELD = 4_000_000

_LOWER = bytes(range(256)).lower()
#: Bytes of a word that are hashed as arrays; a longer word is hashed by itself.
SHORT = 64


class Words:
    """The words of some texts in order, A-Z in lower case.

    ``names`` are the distinct words, ``hashes`` their 64-bit hashes, ``ids`` says which of them
    each word is, ``doc`` which text it is in, and ``joined`` whether the next word follows it in
    the same text with no byte of ``breaks`` between.
    """

    def __init__(self, texts: list[bytes], spaces: bytes, breaks: bytes = b"") -> None:
        kind = np.zeros(256, np.uint8)
        kind[list(spaces)] = 1
        kind[list(breaks)] = 2
        # One byte that ends words lies between texts.
        raw = spaces[:1].join([*texts, b""])
        kinds = np.frombuffer(raw.translate(kind.tobytes()), dtype=np.uint8)
        inside = np.concatenate(([False], kinds == 0, [False]))
        start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        flat = raw.translate(_LOWER, spaces + breaks)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
        self.names, self.ids = found.dictionary, found.indices.to_numpy().astype(np.int64)
        self.hashes = word_hashes(self.names)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, ends), prepend=0))
        self.joined = np.zeros(len(start), bool)
        if len(start):
            self.joined[:-1] = self.doc[:-1] == self.doc[1:]
            if breaks:
                piece = np.cumsum(kinds == 2, dtype=np.int32)[start]
                self.joined[:-1] &= piece[:-1] == piece[1:]


def word_hashes(words: pa.LargeBinaryArray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes of all words at once."""
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    start, length = at[:-1], np.diff(at)
    found = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    left = np.flatnonzero((length > 0) & (length <= SHORT))
    if len(left):
        data = np.concatenate((np.frombuffer(words.buffers()[2], np.uint8), np.zeros(8, np.uint8)))
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        for done in range(0, SHORT, 8):
            more = length[left] - done
            beyond = (8 * (8 - np.minimum(more, 8))).astype(np.uint64)
            found[left] = _scrambled(found[left] ^ (eight[start[left] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> beyond)))
            left = left[more > 8]
    for i in np.flatnonzero(length > SHORT).tolist():
        found[i] = xxhash.xxh64_intdigest(words[i].as_py())
    return found


def _scrambled(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number as another one, all different."""
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def sections(batches: Iterable[pa.RecordBatch], size: int | None = None) -> Iterator[dict[str, list]]:
    """The rows of batches with a binary column ``text``, as columns, in parts of about ``size`` bytes."""
    size = size or SECTION
    for batch in batches:
        held: list[int] = []
        n = 0
        lengths = pc.binary_length(batch.column("text")).to_pylist()
        for i, more in enumerate(lengths):
            if held and n + more > size:
                yield {k: c.slice(held[0], len(held)).to_pylist() for k, c in zip(batch.schema.names, batch.columns)}
                held, n = [], 0
            held.append(i)
            n += more
        if held:
            yield {k: c.slice(held[0], len(held)).to_pylist() for k, c in zip(batch.schema.names, batch.columns)}


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit numbers."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys in ascending order, the place of each in ``keys``); equal keys in any order.

    Where key and place fit into 63 bits together, they are sorted as one number, several times as fast as by argsort.
    Halves of 32 bits are drawn together for that; -1 may stand for no key.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    bits, most = len(keys).bit_length(), int(keys.max())
    if int(keys.min()) >= -1 and most < (1 << 63) - 1:
        packed = keys.astype(np.int64) + 1
        if (most + 1).bit_length() + bits > 63:
            low = packed & 0xFFFFFFFF
            packed >>= 32
            width = int(low.max()) + 1
            if ((int(packed.max()) + 1) * width).bit_length() + bits > 63:
                packed = None
            else:
                packed = packed * width + low
        if packed is not None:
            packed = (packed << bits) | np.arange(len(keys))
            packed.sort()
            at = packed & ((1 << bits) - 1)
            return keys[at], at
    at = np.argsort(keys)
    return keys[at], at


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in ascending order, which of them each key is, one place of each, how often each occurs)."""
    keys, at = ordered(keys)
    new = np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    first = np.flatnonzero(new)
    which = np.empty(len(keys), np.int64)
    which[at] = np.cumsum(new) - 1
    return keys[first], which, at[first], np.diff(first, append=len(keys))


def sums_by_key(keys: np.ndarray, *values: np.ndarray, carried: int = 0) -> tuple[np.ndarray, ...]:
    """(distinct keys in ascending order, sums of each column by key); the last ``carried`` columns
    follow from the key and stay as they are."""
    if not len(keys):
        return keys, *(v.astype(np.int64) for v in values)
    keys, order = ordered(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    summing = len(values) - carried
    return keys[first], *(np.add.reduceat(v[order].astype(np.int64), first) for v in values[:summing]), *(v[order[first]] for v in values[summing:])


def summed(pairs: Iterable[tuple[np.ndarray, ...]], held: int | None = None, carried: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """``sums_by_key`` of about ``held`` keys at once."""
    held = held or HELD
    parts: list[tuple[np.ndarray, ...]] = []
    n = 0

    def together() -> tuple[np.ndarray, ...]:
        return sums_by_key(*(np.concatenate(x) for x in zip(*parts)), carried=carried)

    for p in pairs:
        parts.append(p)
        n += len(p[0])
        if n >= held:
            whole = together()
            if len(whole[0]) > held // 2:
                yield whole
                parts, n = [], 0
            else:
                parts, n = [whole], len(whole[0])
    if parts:
        yield together()

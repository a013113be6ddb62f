"""Encoding whole texts with a public tokenizer: each distinct word once, ids as raw little-endian bytes."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sightline.llm.arrays import Lists

#: Letters of text that are encoded at once, about.
LETTERS_AT_ONCE = 8_000_000
#: Letters of which each is one code point, normalised, with one lower case, then punctuation.
_PLAIN = r"\A(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-&(-/:-@\[-`{-~]*)\z"


class WordEncoder:
    """The ids of texts, as the tokenizers library gives them without special tokens.

    For tokenizers that never join text across a space or line break: those that drop
    white space before they merge (such as word_bpe_49k). The text is cut there, so that
    the library encodes each distinct word of a batch once. Where the tokenizer lower-cases,
    takes runs of letters as pieces and maps bytes to letters, a plain word is its letters
    and the punctuation after them, and the letters go straight to the library's model.
    Nothing is kept from one batch to the next.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spec = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", ())]
        cuts = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", ())]
        self.plain = steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"] and not spec["post_processor"]
        self.letters = {c: _byte_letters(chr(c)) for c in range(0xC0, 0x100)}

    def _any(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)] if words else []

    def _runs(self, runs: list[str]) -> list[list[int]]:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        return [[x.id for x in tokenize(r if r.isascii() else r.translate(letters))] for r in runs]

    def _ids_of(self, words: pa.Array) -> Lists:
        """The ids of each of some distinct words."""
        if not self.plain:
            return Lists.of(self._any(words.to_pylist()))
        cut = pc.extract_regex(words, _PLAIN)
        plain = np.asarray(cut.is_valid())
        odd = self._any(words.filter(pa.array(~plain)).to_pylist())
        cut = cut.drop_null()
        parts = []
        for name, encode in (("run", self._runs), ("mark", self._any)):
            some = pc.utf8_lower(cut.field(name)).dictionary_encode()
            parts.append(Lists.of(encode(some.dictionary.to_pylist())).take(some.indices.to_numpy()))
        half = int(plain.sum())
        both = (parts[0] + parts[1]).take(np.arange(2 * half).reshape(2, half).T.ravel()).joined(np.full(half, 2))
        at = np.empty(len(plain), np.int64)
        at[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = np.arange(len(plain))
        return (both + Lists.of(odd)).take(at)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text its ids in ``dtype``."""
        at = 0
        while at < len(texts):
            size, some = 0, []
            while at < len(texts) and size < LETTERS_AT_ONCE:
                some.append(texts[at])
                size += len(texts[at])
                at += 1
            words = pc.split_pattern(pc.replace_substring(pa.array(some, pa.string()), "\n", " "), " ")
            n, words = words.value_lengths().to_numpy(), words.flatten().dictionary_encode()
            found = self._ids_of(words.dictionary).take(words.indices.to_numpy()).joined(n)
            flat = found.flat.astype(self.dtype)
            for a, count in zip(found.start.tolist(), found.n.tolist()):
                yield flat[a : a + count].tobytes()


@lru_cache(256)
def _byte_letters(letter: str) -> str:
    """The letters that stand for a Latin-1 letter's UTF-8 bytes in byte-level vocabularies:
    printable bytes are themselves, the others count up from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return "".join(chr(b if b in printable else 256 + others.index(b)) for b in letter.encode())


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def crc_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return crc32(ids.astype("<u4").tobytes())

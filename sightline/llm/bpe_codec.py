"""Byte-level BPE encoding and decoding with a word lexicon.

The most frequent words are compiled, with their ids, into a minimal acyclic automaton:
words share prefixes and suffixes, the number of words below each edge gives a word its
rank, and the rank its ids. The automaton is flat arrays in one file that each worker maps
into memory. All other words are merged exactly, pair by pair in the order of the merges.
New words of a batch go through the automaton and the merges together, as rows of arrays.
"""

from __future__ import annotations

import json
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.arrays import Lists, bytes_of_words
from sightline.llm.common import checkpointed, released, texts

#: How byte-level BPE cuts a text before it merges.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of text that are encoded at once, about.
LETTERS_AT_ONCE = 8_000_000
#: Comes after every merge.
NONE = 1 << 30
#: A run of letters that stands alone whatever follows, then punctuation; both without a doubt one piece each.
_PLAIN = r"\A(?P<run> ?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-&(-/:-@\[-`{-~]*)\z"
LEXICON_WORDS = 32_768
#: Words seen less often aren't frequent.
LEAST_COUNT = 4


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1
    characters stand for themselves, the others for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary: exact merging, and the bytes of each id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.letters = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        #: The same as arrays: sorted keys of pairs with their ranks, and the new id of each rank.
        keys = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_key = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array([rank for rank, _ in self.pairs.values()], dtype=np.int64)[order], NONE)
        self.new_id = np.zeros(len(model["merges"]) + 1, dtype=np.int64)
        for rank, new in self.pairs.values():
            self.new_id[rank] = new
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        import regex

        self.pieces = regex.compile(PIECES).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def merge_many(self, pieces: pa.Array) -> Lists:
        """The ids of each piece. Always the pair of lowest rank merges first, the leftmost of
        equals; pieces of one length are rows of an array and take their steps together."""
        data, start, sizes = bytes_of_words(pieces)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == size)
            if size > 60:
                done += [(np.array([i]), np.array([self._merge_long(self.letters[data[start[i] : start[i] + size]].tolist())])) for i in at]
                continue
            x = self.letters[data[start[at][:, None] + np.arange(size)]]
            rank = self._ranks(x[:, :-1], x[:, 1:])
            for width in range(size, 1, -1):
                best = rank.argmin(axis=1)
                low = rank[np.arange(len(at)), best]
                live = low < NONE
                if not live.all():
                    done.append((at[~live], x[~live]))
                    at, x, rank, best, low = at[live], x[live], rank[live], best[live], low[live]
                x[np.arange(len(at)), best] = self.new_id[low]
                x = x[np.arange(width) != best[:, None] + 1].reshape(len(at), width - 1)
                rank = rank[np.arange(width - 1) != best[:, None]].reshape(len(at), width - 2)
                for here in (best - 1, best):
                    has = np.flatnonzero((here >= 0) & (here < width - 2))
                    i = here[has]
                    rank[has, i] = self._ranks(x[has, i], x[has, i + 1])
            done.append((at, x))
        n = np.zeros(len(sizes), np.int64)
        for at, x in done:
            n[at] = x.shape[1]
        found = Lists(np.zeros(n.sum(), np.int64), n)
        for at, x in done:
            found.flat[found.start[at][:, None] + np.arange(x.shape[1])] = x
        return found

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, pairs = len(ids), self.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(*found, i, ids[i], ids[i + 1]) for i in range(n - 1) if (found := pairs.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, new, a, b) for rank, new, i, a, b in heap]
        heapify(heap)
        while heap:
            _, i, new, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (found := pairs.get((ids[left], ids[right]))):
                    heappush(heap, (found[0], left, found[1], ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def cut(self, text: str) -> list[str]:
        """The pieces of any text; the strings of special tokens are pieces."""
        parts = self.split(text) if self.split else [text]
        return [p for part in parts for p in ([part] if part in self.special else self.pieces(part))]

    def encode(self, text: str) -> list[int]:
        """The ids of any text; the strings of special tokens are these tokens."""
        pieces = self.cut(text)
        found = self.merge_many(pa.array([b"" if p in self.special else p.encode("utf-8", "surrogatepass") for p in pieces], pa.binary()))
        return [i for p, ids in zip(pieces, found.lists()) for i in ([self.special[p]] if p in self.special else ids)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Lexicon:
    """Words with ids as a minimal acyclic automaton in flat arrays. An edge's key is its
    state and label (256 state + label); keys ascend."""

    FIELDS = ("edge_key", "edge_target", "edge_skip", "final", "id_start", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.arrays, self.final = arrays, arrays["final"]

    @classmethod
    def build(cls, entries: dict[bytes, list[int]]) -> Lexicon:
        """Words in sorted order, so that each state is final once its last word is behind:
        it is then replaced by an equal one that exists already, or kept."""
        words = sorted(entries)
        known: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []

        def keep(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in known:
                known[key] = len(states)
                states.append(key)
            return known[key]

        # A node that is still open: [final, edges]; the path of the last word is open.
        path: list[list] = [[False, []]]
        last = b""

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], keep(node)))

        for word in words:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common)
            path += [[False, []] for _ in range(len(word) - common)]
            path[-1][0], last = True, word
        close(0)
        root = keep(path[0])
        below = [0] * len(states)  # targets come before their sources
        for i, (final, edges) in enumerate(states):
            below[i] = final + sum(below[t] for _, t in edges)
        order = [root, *(i for i in range(len(states)) if i != root)]
        number = {s: i for i, s in enumerate(order)}
        key, target, skip, finals = [], [], [], []
        for s in order:
            final, edges = states[s]
            passed = int(final)
            for b, t in edges:
                key.append(number[s] << 8 | b)
                target.append(number[t])
                skip.append(passed)
                passed += below[t]
            finals.append(final)
        ids = [entries[w] for w in words]
        return cls({
            "edge_key": np.array(key, dtype="<i8"), "edge_target": np.array(target, dtype="<i4"),
            "edge_skip": np.array(skip, dtype="<i4"), "final": np.array(finals, dtype="u1"),
            "id_start": np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<i4"), "ids": np.array([i for x in ids for i in x], dtype="<i4"),
        })

    def to_bytes(self) -> bytes:
        head, parts, at = {}, [], 0
        for name in self.FIELDS:
            raw = self.arrays[name].tobytes()
            raw += bytes(-len(raw) % 8)
            head[name] = [at, len(self.arrays[name]), self.arrays[name].dtype.str]
            parts.append(raw)
            at += len(raw)
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        return len(text).to_bytes(8, "little") + text + b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes | mmap.mmap) -> Lexicon:
        n = int.from_bytes(raw[:8], "little")
        head = json.loads(raw[8 : 8 + n])
        arrays = {k: np.frombuffer(raw, dtype=t, count=c, offset=8 + n + a) for k, (a, c, t) in head.items()}
        return cls(arrays)

    @classmethod
    def mapped(cls, raw: bytes) -> Lexicon:
        """The same from a file that is mapped into memory; its name is gone at once."""
        with tempfile.TemporaryFile() as f:
            f.write(raw)
            f.flush()
            return cls.from_bytes(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def words(self) -> Lists:
        """The ids of the words, in sorted order."""
        return Lists(self.arrays["ids"].astype(np.int64), np.diff(self.arrays["id_start"]))

    def find_many(self, words: pa.Array) -> np.ndarray:
        """The rank of each word in sorted order, -1 if it isn't there; words of one length walk together."""
        key, target, skip, final = (self.arrays[name] for name in self.FIELDS[:4])
        data, start, sizes = bytes_of_words(words)
        out = np.full(len(sizes), -1)
        for size in np.unique(sizes[sizes > 0]).tolist() if len(key) else ():
            at = np.flatnonzero(sizes == size)
            state, rank = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for k in range(size):
                wanted = state << 8 | data[start[at] + k]
                edge = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                has = key[edge] == wanted
                if not has.all():
                    at, rank, edge = at[has], rank[has], edge[has]
                    if not len(at):
                        break
                state, rank = target[edge].astype(np.int64), rank + skip[edge]
            if len(at):
                out[at] = np.where(final[state] == 1, rank, -1)
        return out

    def find(self, word: bytes) -> list[int] | None:
        rank = int(self.find_many(pa.array([word], pa.binary()))[0])
        return None if rank < 0 else self.words().take(np.array([rank])).flat.tolist()


class Codec:
    """Encodes and decodes whole texts word by word.

    A single space between two characters that are not white space always begins a piece,
    so a text is cut there; texts with other white space runs are cut by the pattern. Of
    the distinct words of a batch, the lexicon is asked for whole words, then for their
    pieces; what it doesn't have is merged.
    """

    def __init__(self, path: str, lexicon: bytes | None) -> None:
        import regex

        self.merges = merges(path)
        self.lexicon = Lexicon.mapped(lexicon) if lexicon else Lexicon.build({})
        self.odd = regex.compile(r"\s\s|\s\Z|\0").search
        top = max(self.merges.bytes_of) + 1
        self.decimal = pa.array([str(i) for i in range(top)])
        self.raw = pa.array([self.merges.bytes_of.get(i, b"") for i in range(top)], pa.binary())

    def _ids_of_pieces(self, pieces: pa.Array) -> Lists:
        rank, words = self.lexicon.find_many(pieces), self.lexicon.words()
        new = np.flatnonzero(rank < 0)
        special = Lists(np.array([*self.merges.special.values()], np.int64), np.ones(len(self.merges.special)))
        known = words + self.merges.merge_many(pieces.take(pa.array(new))) + special
        rank[new] = len(words.n) + np.arange(len(new))
        for i, name in enumerate(self.merges.special):
            if (at := pc.index(pieces, name).as_py()) >= 0:
                rank[at] = len(words.n) + len(new) + i
        return known.take(rank)

    def ids_of(self, words: pa.Array) -> Lists:
        """The ids of each word (a string array)."""
        rank, known = self.lexicon.find_many(words), self.lexicon.words()
        new = np.flatnonzero(rank < 0)
        cut = pc.extract_regex(words.take(pa.array(new)), _PLAIN)
        plain = np.asarray(cut.is_valid())
        odd = [self.merges.cut(w) for w in words.take(pa.array(new[~plain])).to_pylist()]
        cut = cut.drop_null()
        pieces = pa.concat_arrays([cut.field("run"), cut.field("mark"), pa.array([p for some in odd for p in some], pa.string())]).dictionary_encode()
        # Runs and marks take turns, then come the pieces of the others.
        half = int(plain.sum())
        order = np.concatenate((np.arange(2 * half).reshape(2, half).T.ravel(), np.arange(2 * half, len(pieces))))
        of_pieces = self._ids_of_pieces(pieces.dictionary).take(pieces.indices.to_numpy()[order])
        n = np.concatenate((np.full(half, 2), np.array([len(some) for some in odd], np.int64)))
        rank[np.concatenate((new[plain], new[~plain]))] = len(known.n) + np.arange(len(new))
        return (known + of_pieces.joined(n)).take(rank)

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and how many each text has."""
        odd = np.array([self.odd(t) is not None for t in texts], dtype=bool)
        spaced = pc.split_pattern(pc.replace_substring(pa.array([t for t, o in zip(texts, odd) if not o], pa.string()), " ", "\0 "), "\0")
        others = pa.array([self.merges.cut(t) for t, o in zip(texts, odd) if o], pa.list_(pa.string()))
        words = pa.concat_arrays([spaced, others]).take(pa.array(np.argsort(odd, kind="stable").argsort()))
        return words.flatten(), words.value_lengths().to_numpy()

    def encode_many(self, texts: list[str]) -> Lists:
        words, n = self._cut(texts)
        words = words.dictionary_encode()
        return self.ids_of(words.dictionary).take(words.indices.to_numpy()).joined(n)

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text (number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        at = 0
        while at < len(texts):
            size, some = 0, []
            while at < len(texts) and size < LETTERS_AT_ONCE:
                some.append(texts[at])
                size += len(texts[at])
                at += 1
            found = self.encode_many(some)
            ends, ids = pa.array(np.append(found.start, len(found.flat)), pa.int64()), pa.array(found.flat)
            listed = pc.binary_join(pa.LargeListArray.from_arrays(ends, self.decimal.take(ids)), ",")
            decoded = pc.binary_join(pa.LargeListArray.from_arrays(ends, self.raw.take(ids)), b"")
            for n, a, b in zip(found.n.tolist(), listed, decoded):
                yield n, sha256(a.as_buffer()).hexdigest(), sha256(b.as_buffer().to_pybytes().decode("utf-8", "replace").encode()).hexdigest()

    def digest(self, text: str) -> tuple[int, str, str]:
        return next(self.digests([text]))

    def encode(self, text: str) -> list[int]:
        return self.merges.encode(text)


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, lexicon: bytes | None, key: str) -> Codec:
    """One codec for each worker process and lexicon."""
    if (path, key) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, key] = Codec(path, lexicon)
    return _CODECS[path, key]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; every word but a text's first has its space in front."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                counts.update(text.split(" ")[1:])
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    rows = texts(docs).select("text").mapInArrow(released(work), "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).select(F.concat(F.lit(" "), "word").alias("word"), "n")


def build_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON_WORDS) -> bytes:
    """The automaton of the most frequent words, at most ``size``, of at most 64 bytes each.

    Counts cover all texts. A histogram of them, by steps of about a hundredth, says from
    which count on all words fit; only these go to the driver.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 64)
    counts = checkpointed(word_counts(docs).filter((F.col("n") >= LEAST_COUNT) & F.octet_length("word").between(2, 64)).withColumn("step", step))
    least, total = None, 0
    for row in counts.groupBy("step").agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        total += row["words"]
        if total > size:
            break
        least = row["step"]
    top = [x["word"] for x in counts.filter(F.col("step") >= least).select("word").collect()] if least is not None else []
    return Lexicon.build(dict(zip([w.encode() for w in top], Codec(tokenizer, None).ids_of(pa.array(top, pa.string())).lists()))).to_bytes()


def round_trip(docs: DataFrame, tokenizer: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    Null and empty texts have no ids and decode to the empty string; null doc_ids and
    repeated rows are kept; an empty table gives an empty result; other columns are ignored.
    """
    own = texts(docs)
    raw = build_lexicon(docs, tokenizer, lexicon_words)
    shared, key = docs.sparkSession.sparkContext.broadcast(raw), sha256(raw).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using = codec(tokenizer, shared.value, key)
        for batch in batches:
            found = list(using.digests(batch.column("text").to_pylist()))
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return own.mapInArrow(released(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""An interpolated modified Kneser-Ney model, counted in Spark and read from mapped files.

Tokens are numbered by their place in a table of word hashes. An n-gram's key is the number of
its first n-1 tokens in the table one order below and the number of its last token, in 64 bits
together. Every table is a set of sorted arrays of keys with one or more arrays of numbers, one
pair of files a partition in the shared folder; a key's partition follows from the key. Workers
map the files into memory and look the distinct keys of many texts up by bisection, in ascending
order. The driver sees one row of sums a file.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import filesystem, new_folder, parallelism, released
from sightline.llm.grams import Words, mixed, numbered, sections, summed, sums_by_key, word_hashes

SPACES = b" \t\n\x0b\x0c\r"
#: The end of a text as a token; no word holds white space.
END = word_hashes(pa.array([b"\n"], pa.large_binary()))[0]
#: Numbers below this can be the first part of a key.
LARGEST = 1 << 31


@dataclass
class Table:
    """Files of sorted keys and their numbers, by partition."""

    columns: int
    parts: int
    paths: list[str]
    sizes: list[int]
    types: list[list[str]]
    sums: list[int]
    #: How many keys have the first number 1, 2, 3, 4.
    seldom: list[int]
    #: First parts of keys that have so many keys that these are dealt out one by one.
    hot: np.ndarray | None = None
    first: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.first = np.concatenate(([0], np.cumsum(self.sizes))).tolist()

    @property
    def size(self) -> int:
        return self.first[-1]

    def part_of(self, keys: np.ndarray) -> np.ndarray:
        return part_of(keys, self.parts, self.hot)


def part_of(keys: np.ndarray, parts: int, hot: np.ndarray | None) -> np.ndarray:
    """The partition of a key: by its first part if ``hot`` is given, but by the whole key where that is hot."""
    own = keys.view(np.uint64)
    zero = np.zeros(len(own), np.uint64)
    whole = mixed(own, zero)
    if hot is not None:
        context = keys >> 32
        whole = np.where(np.isin(context, hot), whole, mixed(context.view(np.uint64), zero))
    return (whole % np.uint64(parts)).astype(np.int32)


def _mapped(path: str) -> np.ndarray:
    """The bytes of a file, mapped; one that isn't local goes to a nameless file of the worker first."""
    fs, at = filesystem(path)
    if fs.type_name == "local":
        return np.memmap(at, dtype=np.uint8, mode="r")
    with tempfile.TemporaryFile() as f, fs.open_input_stream(at) as source:
        while some := source.read(1 << 24):
            f.write(some)
        f.flush()
        return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), dtype=np.uint8)


class Lookup:
    """A table, mapped part by part when first needed."""

    def __init__(self, table: Table) -> None:
        self.table = table
        self.files: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}

    def _file(self, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
        if i not in self.files:
            self.files[i] = read_file(self.table.paths[i], self.table.sizes[i], self.table.types[i])
        return self.files[i]

    def find(self, keys: np.ndarray, *, with_values: bool = True) -> tuple[np.ndarray, list[np.ndarray]]:
        """(place of each key, -1 if it isn't there; its numbers, 0 if it isn't there). Keys are distinct and ascend."""
        place = np.full(len(keys), -1, np.int64)
        values = [np.zeros(len(keys), np.int64) for _ in range(self.table.columns if with_values else 0)]
        part = self.table.part_of(keys)
        # Places ascend within a part, by a radix sort where 16 bits do.
        order = np.argsort(part.astype(np.int16) if self.table.parts < 1 << 15 else part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(self.table.parts + 1))
        for p in np.unique(part).tolist():
            if not self.table.sizes[p]:
                continue
            own = order[bounds[p] : bounds[p + 1]]
            there, numbers = self._file(p)
            at = np.minimum(np.searchsorted(there, keys[own]), len(there) - 1)
            hit = there[at] == keys[own]
            own, at = own[hit], at[hit]
            place[own] = self.table.first[p] + at
            for out, column in zip(values, numbers):
                out[own] = column[at]
        return place, values


def read_file(path: str, size: int, types: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    raw, at, columns = _mapped(path), 8 * size, []
    for t in types:
        kind = np.dtype(t)
        columns.append(raw[at : at + size * kind.itemsize].view(kind))
        at += size * kind.itemsize
    return raw[: 8 * size].view("<i8"), columns


def _smallest(values: np.ndarray) -> np.ndarray:
    top = int(values.max()) if len(values) else 0
    return values.astype(next(t for t in ("<u1", "<u2", "<u4", "<i8") if top <= np.iinfo(t).max))


def write_table(rows: DataFrame, columns: int, parts: int, folder: str, hot: np.ndarray | None = None, carried: int = 0) -> Table:
    """``rows`` (part, key, v0, v1 ...) as a table; numbers of equal keys are added up, but for the last ``carried`` ones.

    A task holds one partition's numbers; it writes a file of a new name, and only files that
    the driver is told of count, so that tasks may run again.
    """
    names = [f"v{i}" for i in range(columns)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        current = None

        def close(part: int, held: list) -> pa.RecordBatch:
            keys, *values = sums_by_key(*(np.concatenate(x) for x in zip(*held)), carried=carried)
            path = f"{folder}/{uuid.uuid4().hex}.table"
            fs, at = filesystem(path)
            fs.create_dir(at.rpartition("/")[0], recursive=True)
            small = [_smallest(v) for v in values]
            with fs.open_output_stream(at) as out:
                out.write(keys.astype("<i8").tobytes())
                for v in small:
                    out.write(v.tobytes())
            seldom = [int((values[0] == k).sum()) for k in (1, 2, 3, 4)]
            return pa.RecordBatch.from_pylist([{"part": part, "path": path, "n": len(keys), "types": [v.dtype.str for v in small], "sums": [int(v.sum()) for v in values[: columns - carried]], "seldom": seldom}], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("types", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("seldom", pa.list_(pa.int64()))])
        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)]):
                if a == b:
                    continue
                if current is not None and current != part[a]:
                    yield close(current, found.pop(current))
                current = int(part[a])
                held = found.setdefault(current, [])
                held.append(tuple(batch.column(x).to_numpy()[a:b] for x in ("key", *names)))
                if sum(len(h[0]) for h in held[1:]) > max(1 << 20, 2 * len(held[0][0])):  # equal keys don't pile up
                    found[current] = [sums_by_key(*(np.concatenate(x) for x in zip(*held)), carried=carried)]
        if current is not None:
            yield close(current, found.pop(current))

    dealt = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key").select("part", "key", *names)
    kinds = "part int, path string, n long, types array<string>, sums array<long>, seldom array<long>"
    by_part = {r["part"]: r for r in dealt.mapInArrow(released(work), kinds).collect()}
    every = [by_part.get(p) for p in range(parts)]
    total = lambda name, k: [sum(r[name][i] for r in by_part.values()) for i in range(k)]
    return Table(columns, parts, [r["path"] if r else "" for r in every], [r["n"] if r else 0 for r in every], [r["types"] if r else [] for r in every], total("sums", columns - carried), total("seldom", 4), hot)


def table_rows(spark: SparkSession, table: Table, kinds: str, work: Callable[[np.ndarray, list[np.ndarray], int], tuple[np.ndarray, ...]]) -> DataFrame:
    """The rows that ``work`` makes of each file's keys, numbers and first place, as columns of ``kinds``."""
    files = [(p, s, t, f) for p, s, t, f in zip(table.paths, table.sizes, table.types, table.first) if s]
    if not files:
        return spark.createDataFrame([], kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = work(*read_file(r["path"], r["n"], r["types"]), r["first"])
                names = [x.strip().split(" ")[0] for x in kinds.split(",")]
                arrays = [pa.array(x) for x in found]
                for a in range(0, len(arrays[0]), 1 << 18):
                    yield pa.record_batch([x.slice(a, 1 << 18) for x in arrays], names=names)

    made = spark.createDataFrame(files, "path string, n long, types array<string>, first long")
    return made.repartition(len(files)).mapInArrow(released(run), kinds)


@dataclass
class Model:
    """Tables by order (from 1): ``grams`` numbers the n-grams below the highest order and has the counts of
    the words, ``seen`` has the counts that probabilities are made of, ``contexts`` (from order 2) the sum of these and how many
    are 1, 2 and more; ``discounts`` what is taken off a count of 1, 2 and more."""

    order: int
    tokens: int
    words: int
    grams: dict[int, Table]
    seen: dict[int, Table]
    contexts: dict[int, Table]
    discounts: dict[int, list[float]]
    whole: list[int]


def discounts(seldom: list[int]) -> list[float]:
    """Of counts 1, 2, 3 and more, from how many n-grams have the counts 1 to 4; where one of these numbers is missing
    or gives an amount outside 0 to the count, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = seldom
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return found if all(0 <= d <= k for k, d in enumerate(found, 1)) else [0.5, 1.0, 1.5]


class Reader:
    """Numbers of tokens and n-grams in the tables of a model, and their probabilities."""

    def __init__(self, grams: dict[int, Table], model: Model | None = None) -> None:
        self.grams = {n: Lookup(t) for n, t in grams.items()}
        self.model = model
        if model:
            self.seen = {n: Lookup(t) for n, t in model.seen.items()}
            self.contexts = {n: Lookup(t) for n, t in model.contexts.items()}

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token of the texts, ends included: its number (-1 if it is unknown), its count, and its text; where texts begin."""
        words = Words(texts, SPACES)
        hashes = np.concatenate((words.hashes, [END])).view(np.int64)
        keys, back = np.unique(hashes, return_inverse=True)
        place, (count,) = self.grams[1].find(keys)
        n = np.bincount(words.doc, minlength=len(texts)) + 1
        begin = np.cumsum(n) - n
        doc = np.repeat(np.arange(len(texts)), n)
        which = np.full(len(doc), len(words.hashes))
        which[np.arange(len(words.ids)) + words.doc] = words.ids
        return place[back][which], count[back][which], doc, begin

    def keys(self, ids: np.ndarray, begin: np.ndarray, order: int) -> dict[int, np.ndarray]:
        """By order from 2, the key of the n-gram that ends at each token, -1 if it holds something unknown before its last token or there."""
        out = {}
        number = ids
        for n in range(2, order + 1):
            context = np.empty(len(ids), np.int64)
            context[1:] = number[:-1]
            context[begin] = self.grams[n - 1].table.size  # the beginning of a text, as if it were one more n-gram
            out[n] = np.where((context >= 0) & (ids >= 0), context << 32 | np.maximum(ids, 0), -1)
            if n < order:
                keys, back, *_ = numbered(out[n])
                number = self.grams[n].find(keys, with_values=False)[0][back]
        return out

    def logs(self, ids: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """log10 of each token's probability."""
        m = self.model
        if not m.tokens:
            return np.zeros(len(ids))
        keys, back, *_ = numbered(ids)
        count = self.seen[1].find(keys)[1][0][back]
        p = self._share(count, m.discounts[1], [np.float64(x) for x in m.whole], np.full(len(ids), 1 / (m.words + 1)))
        number = ids
        for n, found in self.keys(ids, begin, m.order).items():
            keys, back, *_ = numbered(found)
            count = self.seen[n].find(keys)[1][0][back]
            context = np.empty(len(ids), np.int64)
            context[1:] = number[:-1]
            context[begin] = self.grams[n - 1].table.size
            keys, back, *_ = numbered(context)
            at, values = self.contexts[n].find(keys)
            known = (at >= 0)[back]
            whole = [v[back][known].astype(np.float64) for v in values]
            p[known] = self._share(count[known], m.discounts[n], whole, p[known])
            if n < m.order:
                keys, back, *_ = numbered(found)
                number = self.grams[n].find(keys, with_values=False)[0][back]
        return np.log10(p)

    @staticmethod
    def _share(count: np.ndarray, d: list[float], whole: list, below: np.ndarray) -> np.ndarray:
        """Of sum, ones, twos and more of a context: the discounted count and the share of what is ``below``."""
        off = np.array([0.0, *d])[np.minimum(count, 3)]
        total, *kinds = whole
        return (count - off + sum(x * n for x, n in zip(d, kinds)) * below) / total


def learnt_from(doc_id: F.Column) -> F.Column:
    """Texts that the model is learnt from; those with a null id among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 != 2, F.lit(True))


def _pieces(docs: DataFrame, columns: int, hot: np.ndarray | None, parts: int, counts: Callable[[], Callable[[list[bytes]], tuple[np.ndarray, ...]]], carried: int = 0) -> DataFrame:
    """(part, key, v0 ...) of what ``counts()`` makes of the texts of each section."""
    names = ["part", "key", *(f"v{i}" for i in range(columns))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counts()
        for keys, *values in summed((of(rows["text"]) for rows in sections(batches)), carried=carried):
            arrays = [part_of(keys, parts, hot), keys, *values]
            for a in range(0, len(keys), 1 << 18):
                yield pa.record_batch([pa.array(x[a : a + (1 << 18)]) for x in arrays], names=names)

    return docs.select("text").mapInArrow(released(work), "part int, key long" + "".join(f", v{i} long" for i in range(columns)))


def fit(docs: DataFrame, order: int = 2) -> Model:
    """A model of the texts (binary column ``text``), of order 2 or more."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    parts, folder = parallelism(spark), new_folder(spark, "language-model")

    def words() -> Callable[[list[bytes]], tuple[np.ndarray, ...]]:
        def of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
            found = Words(texts, SPACES)
            return np.concatenate((found.hashes, [END])).view(np.int64), np.concatenate((np.bincount(found.ids, minlength=len(found.names)), [len(texts)]))

        return of

    grams = {1: write_table(_pieces(docs, 1, None, parts, words), 1, parts, folder)}
    tokens, vocabulary = grams[1].sums[0] if grams[1].size else 0, grams[1].size
    if not tokens:
        return Model(order, 0, 0, grams, {1: grams[1]}, {}, {}, [])

    raw = dict(grams)
    for n in range(2, order + 1):
        if grams[n - 1].size >= LARGEST:
            raise ValueError(f"{grams[n - 1].size} n-grams of order {n - 1} do not fit into 31 bits")
        shared = spark.sparkContext.broadcast(dict(grams))

        def counts(n: int = n, shared=shared) -> Callable[[list[bytes]], tuple[np.ndarray, ...]]:
            reader = Reader(shared.value)

            def of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
                ids, _, _, begin = reader.tokens(texts)
                found = reader.keys(ids, begin, n)
                keys, _, at, m = numbered(found[n])
                return (keys, m) if n == 2 else (keys, m, found[n - 1][at])

            return of

        carried = int(n > 2)  # the n-gram without its first token; that of a pair is in its key
        hot = _hot(spark, grams[n - 1], tokens, parts)
        raw[n] = write_table(_pieces(docs, 1 + carried, hot, parts, counts, carried), 1 + carried, parts, folder, hot, carried)
        if n < order:
            grams[n] = raw[n]
    seen = {order: raw[order]}
    for n in range(order - 1, 0, -1):
        seen[n] = _continuations(spark, raw[n + 1], n, grams[n].hot, parts, folder)
    contexts = {n: _contexts(spark, seen[n], parts, folder) for n in range(2, order + 1)}
    one = seen[1]
    whole = [one.sums[0], *one.seldom[:2], one.size - sum(one.seldom[:2])]
    return Model(order, tokens, vocabulary, grams, seen, contexts, {n: discounts(t.seldom) for n, t in seen.items()}, whole)


def _hot(spark: SparkSession, table: Table, tokens: int, parts: int) -> np.ndarray:
    """N-grams before more than a quarter of a partition's share of all tokens, four times the partitions at most, and the beginning of texts."""
    bar = tokens / (4 * parts)
    some = table_rows(spark, table, "place long", lambda keys, values, first: (first + np.flatnonzero(values[0] > bar),))
    return np.array(sorted([r["place"] for r in some.collect()] + [table.size]), np.int64)


def _continuations(spark: SparkSession, longer: Table, n: int, hot: np.ndarray | None, parts: int, folder: str) -> Table:
    """Of each n-gram, how many different tokens come before it."""

    def work(keys: np.ndarray, values: list[np.ndarray], first: int) -> tuple[np.ndarray, ...]:
        own, count = np.unique(keys & 0xFFFFFFFF if n == 1 else values[1], return_counts=True)
        return part_of(own, parts, hot), own, count

    return write_table(table_rows(spark, longer, "part int, key long, v0 long", work), 1, parts, folder, hot)


def _contexts(spark: SparkSession, table: Table, parts: int, folder: str) -> Table:
    """Of each context, the sum of its n-grams' numbers, and how many are 1, 2 and more."""

    def work(keys: np.ndarray, values: list[np.ndarray], first: int) -> tuple[np.ndarray, ...]:
        v = values[0].astype(np.int64)
        own, *sums = sums_by_key(keys >> 32, v, v == 1, v == 2, v > 2)
        return part_of(own, parts, None), own, *sums

    kinds = "part int, key long, v0 long, v1 long, v2 long, v3 long"
    return write_table(table_rows(spark, table, kinds, work), 4, parts, folder)


def scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    ``docs`` holds doc_id and text; other columns are ignored. The model is learnt from the rows
    that ``learnt_from`` names. Tokens are words without white space, A-Z in lower case, and one end for each text;
    a null text is empty and has its end alone. Rows with null or repeated ids are learnt from and scored like any
    other; an empty table gives an empty result. Where nothing is learnt, both scores are those of one class of
    tokens that takes all: 0. Words are told apart by 64-bit hashes.

    Before a text's first token stand ``order`` - 1 beginnings. The highest order has counts, lower ones the
    number of different tokens before; the lowest is mixed with the same chance for every known token and one
    for all unknown ones. A context that wasn't seen leaves the chance to the order below.
    """
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), learnt_from(F.col("doc_id")).alias("learnt"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(own.filter("learnt"), order))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model.grams, model)
        for rows in sections(batches):
            ids, count, doc, begin = reader.tokens(rows["text"])
            n = len(rows["text"])
            add = lambda x: np.bincount(doc, x, n)
            base = np.log10((count + 1) / (model.tokens + model.words + 1))
            columns = {
                "doc_id": pa.array(rows["doc_id"], pa.int64()), "held_out": pa.array([not x for x in rows["learnt"]]), "n_tokens": pa.array(np.bincount(doc, minlength=n)),
                "n_known": pa.array(np.bincount(doc[count > 0], minlength=n)), "train_tokens": pa.array([model.tokens] * n, pa.int64()),
                "base_score": pa.array(add(base)), "score": pa.array(add(reader.logs(ids, begin))),
            }
            yield pa.record_batch(columns)

    return own.mapInArrow(released(work), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

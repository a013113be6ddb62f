"""Repeated substrings: prefix doubling over sampled positions, then removal of what repeats.

Every window of ``length`` bytes owns one anchor, the leftmost gram with the smallest hash
that starts in it, so that equal windows own equal grams at equal offsets. Prefix doubling
starts at these grams and not at single bytes: positions with a unique gram are dropped,
and so are contexts (all windows of one anchor) that are equal as a whole or unique. Where
contexts of one gram differ, the names of two neighbouring strings, which are 64-bit hashes
and not ranks, are paired to that of the string of twice the length at ``gram, 2 gram, ...``, in
the task that has the gram, until a position is unique or the length is reached; grams with many contexts
are compared by Spark in blocks of windows instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed, released, texts, unused

CHUNK = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and powers of an odd base and of its inverse, mod 2**64."""
    byte = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

    def powers(base: int) -> np.ndarray:
        p = np.full(CHUNK + 1, base, dtype=np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return byte, powers(_ODD), powers(pow(_ODD, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hashes:
    """Hashes of any substrings of up to CHUNK bytes, from prefix sums."""

    def __init__(self, b: np.ndarray) -> None:
        byte, up, self.down = _tables()
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(byte[b] * up[: len(b)], out=self.sums[1:])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start])


def gram_size(length: int) -> int:
    return max(1, (length + 4) // 5)


def anchors(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, hash of the gram, hash of the context) of each anchor.

    Long texts go through in chunks; a context cut at their borders is only compared more
    closely, so that results don't depend on it.
    """
    k, found = gram_size(length), []
    w = length - k + 1
    step = CHUNK - length
    for begin in range(0, max(0, len(b) - length + 1), step):
        part = b[begin : begin + step + length - 1]
        h = Hashes(part)
        start = np.arange(len(part) - k + 1)
        gram = h.at(start, start + k)
        least = (gram & _U(~(CHUNK - 1) & (2**64 - 1))) | start.astype(np.uint64)
        span = 1
        while span * 2 <= w:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        if w > span:
            least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
        at = (least & _U(CHUNK - 1)).astype(np.int64)
        lo = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        hi = np.append(lo[1:], len(at)) - 1
        found.append((lo + begin, hi + begin, gram[at[lo]], h.at(lo, hi + length)))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found))


def _bytes_of(batch: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    for x in batch.column(column):
        yield np.frombuffer(x.as_buffer() or b"", dtype=np.uint8)


def _keys(raw: F.Column) -> tuple[F.Column, F.Column]:
    """The MD5 of bytes as two longs."""
    part = lambda a, n: F.conv(F.substring(F.md5(raw), a, n), 16, 10).cast("long")
    return part(1, 15), part(16, 15) * 4 + part(31, 2) % 4


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text as bytes, and its MD5 as two longs."""
    k1, k2 = _keys(F.col("raw"))
    return texts(docs).select("doc_id", F.encode("text", "utf-8").alias("raw")).select("doc_id", "raw", k1.alias("k1"), k2.alias("k2"))


def _anchor_rows(keyed: DataFrame, length: int, only_hashes: bool) -> DataFrame:
    """Of each text of at least ``length`` bytes its anchors: gram, context, text and windows.

    Only whether a context occurs twice matters, so a task sends those of a text that it
    has had before once more and then no longer.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            k1, k2, out, size = batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), [], 0
            for i, b in enumerate(_bytes_of(batch, "raw")):
                if len(b) < length or (had := seen.get((k1[i], k2[i]), 0)) > 1:
                    continue
                seen[k1[i], k2[i]] = had + 1
                lo, hi, gram, context = anchors(b, length)
                n = len(lo)
                row = [gram.view(np.int64), context.view(np.int64)]
                if not only_hashes:
                    row += [np.full(n, k1[i]), np.full(n, k2[i]), (lo << 16) | (hi - lo)]
                out.append(row)
                size += n
                if size > 100_000:
                    yield _batch(out, only_hashes)
                    out, size = [], 0
            if out:
                yield _batch(out, only_hashes)

    names = "gram long, context long" + ("" if only_hashes else ", k1 long, k2 long, place long")
    return keyed.select("raw", "k1", "k2").mapInArrow(released(work), names)


def _batch(rows: list, only_hashes: bool) -> pa.RecordBatch:
    names = ["gram", "context", "k1", "k2", "place"][: 2 if only_hashes else 5]
    return pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows)], names=names)


def _twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once, found by sorting them."""
    order = np.argsort(keys)
    same = np.diff(keys[order]) == 0
    again = np.zeros(len(keys), dtype=bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    return again


def repeated_windows(group: np.ndarray, contexts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each context, whether each of its windows occurs in another one of its group.

    Prefix doubling: names of what starts at each position are paired at offsets of the
    length reached so far; the pairs of windows that are not unique yet are sorted, and
    those that have become unique drop out.
    """
    k = gram_size(length)
    sizes = np.array([len(c) for c in contexts])
    base = np.concatenate(([0], np.cumsum(sizes)))
    data = np.concatenate(contexts)
    name = np.zeros(len(data), dtype=np.uint64)  # those over a border aren't used
    for a in range(0, len(data), CHUNK // 2):
        part = data[a : a + CHUNK // 2 + k - 1]
        start = np.arange(max(0, len(part) - k + 1))
        name[a : a + len(start)] = Hashes(part).at(start, start + k)
    n_windows = sizes - length + 1
    window = np.concatenate([base[i] + np.arange(n) for i, n in enumerate(n_windows)])
    of = np.repeat(_mix(group.astype(np.int64).view(np.uint64)), n_windows)
    alive = np.zeros(len(window), dtype=bool)
    live, have = np.arange(len(window)), k
    while len(live):
        if have < length:
            more = min(have, length - have)
            name, have = _mix(name[:-more] * _U(_ODD) + name[more:]), have + more
        live = live[_twice(_mix(name[window[live]] ^ of[live]))]
        if have == length:
            break
    alive[live] = True
    return np.split(alive, np.cumsum(n_windows)[:-1])


def _compare_classes(rows: DataFrame, length: int) -> DataFrame:
    """Spans of windows that repeat, of contexts sorted by gram."""

    def finish(group: pa.Table) -> pa.RecordBatch | None:
        group = group.combine_chunks()
        gram, context = (group.column(c).to_numpy() for c in ("gram", "context"))
        order = np.lexsort((context, gram))
        first = np.ones(len(order), dtype=bool)
        first[1:] = (gram[order][1:] != gram[order][:-1]) | (context[order][1:] != context[order][:-1])
        order = order[first]
        raw = group.column("raw")
        parts = [np.frombuffer(raw[int(i)].as_buffer(), dtype=np.uint8) for i in order]
        alone, k1, k2, lo = (group.column(c).to_numpy()[order] for c in ("alone", "k1", "k2", "lo"))
        out = []
        for i, again in enumerate(repeated_windows(gram[order], parts, length)):
            if alone[i] and again.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
                out += [(k1[i], k2[i], lo[i] + a, lo[i] + z - 1 + length) for a, z in edge.reshape(-1, 2)]
        if out:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["k1", "k2", "a", "z"])
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            gram = held.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
            if cut >= 2000 and (out := finish(held.slice(0, cut))) is not None:
                yield out
            if cut >= 2000:
                held = held.slice(cut)
        if held is not None and held.num_rows and (out := finish(held)) is not None:
            yield out

    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(released(work), "k1 long, k2 long, a long, z long")


def _compare_hot(rows: DataFrame, length: int, sizes: tuple[int, ...] = (32, 8, 1)) -> DataFrame:
    """The same for grams with very many contexts, dealt by what the windows hold.

    Windows are compared in aligned blocks that shrink. A block whose whole text occurs
    twice repeats in all its windows; one whose core (what all its windows share) is unique
    repeats in none; only the rest, and one of each repeated text for them to meet, is cut
    into smaller blocks.
    """
    fields = "gram long, o long, n long, k1 long, k2 long, p long, alone boolean, raw binary, whole long, core long"
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()] + [pa.int64()] * 2
    k = gram_size(length)

    def cut(size: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                cells = zip(*(batch.column(c).to_pylist() for c in ("gram", "o", "k1", "k2", "p", "alone")))
                for (gram, o, k1, k2, p, alone), b in zip(cells, _bytes_of(batch, "raw")):
                    h, n = Hashes(b), len(b) - length + 1
                    if o is None:  # how far the anchor is from the first window
                        start = np.arange(len(b) - k + 1)
                        o = int(np.flatnonzero(h.at(start, start + k).view(np.int64) == gram)[0])
                    i = 0
                    while i < n:
                        m = (o - i) // size
                        z = min(n, o - m * size + 1)  # windows i to z - 1 are of block m
                        # The core runs from the start of the block's last window to the end of its first one.
                        at = np.array([i, o - m * size]), np.array([z - 1 + length, o - m * size - size + 1 + length])
                        if size >= length or at[0][1] >= len(b) or at[1][1] <= at[0][1]:
                            core = 0
                        else:
                            core = int(h.at(at[0][1:], at[1][1:]).view(np.int64)[0])
                        whole = int(h.at(at[0][:1], at[1][:1]).view(np.int64)[0])
                        out.append((gram, o - i, z - i, k1, k2, p + i, alone, b[i : z - 1 + length].tobytes(), whole, core))
                        i = z
                    if len(out) > 5000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                        out = []
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        return work

    left = rows.dropDuplicates(["gram", "context"]).select("gram", F.lit(None).cast("long").alias("o"), "k1", "k2", F.col("lo").alias("p"), "alone", "raw")
    found = None
    for size in sizes:
        blocks = checkpointed(left.mapInArrow(released(cut(size)), fields).withColumn("m", F.floor(F.col("o") / size)))
        shared = blocks.groupBy("gram", "m", "core").agg(F.count("*").alias("c")).filter("c > 1").drop("c")
        blocks = blocks.join(shared, ["gram", "m", "core"], "left_semi")
        same = blocks.groupBy("gram", "o", "n", "whole").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "p")).alias("one")).filter("c > 1").drop("c")
        blocks = checkpointed(blocks.join(same, ["gram", "o", "n", "whole"], "left"))
        spans = blocks.filter("one is not null and alone").select("k1", "k2", F.col("p").alias("a"), (F.col("p") + F.col("n") - 1 + length).alias("z"))
        found = spans if found is None else found.unionByName(spans)
        again = blocks.filter(F.col("one") == F.struct("k1", "k2", "p")).withColumn("alone", F.lit(False))
        left = blocks.filter("one is null").unionByName(again).select("gram", "o", "k1", "k2", "p", "alone", "raw")
    return found


def repeated_spans(keyed: DataFrame, length: int, class_limit: int = 512) -> DataFrame:
    """(k1, k2, a, z): spans of the texts that are covered by repeated windows; they may overlap."""
    # The windows of an anchor are counted in 16 bits.
    if length < 1 or length - gram_size(length) > 0xFFFF:
        raise ValueError("lengths are from 1 to 81919 bytes")
    grams = _anchor_rows(keyed, length, True).groupBy("gram").agg(
        F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1")
    ).filter("n > 1").select("gram", (F.col("c0") != F.col("c1")).alias("mixed"))
    rows = checkpointed(_anchor_rows(keyed, length, False).join(grams, "gram"))
    lo = F.shiftright("place", 16)
    span = lambda d: d.select("k1", "k2", lo.alias("a"), (lo + F.col("place").bitwiseAND(0xFFFF) + length).alias("z"))
    mixed = rows.filter("mixed")
    contexts = checkpointed(mixed.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "place")).alias("at")))
    classes = contexts.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    to_compare = checkpointed(
        contexts.join(classes.filter("least = 1"), "gram")
        .select("gram", "context", "at.*", (F.col("n") == 1).alias("alone"), (F.col("m") > class_limit).alias("hot"))
    )
    by_text = to_compare.groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "context", "place", "alone", "hot")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            k1, k2, out = batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), []
            found = batch.column("found")
            for i, b in enumerate(_bytes_of(batch, "raw")):
                if (k1[i], k2[i]) in seen:
                    continue
                seen.add((k1[i], k2[i]))
                for x in found[i].as_py():
                    p = x["place"] >> 16
                    out.append((x["gram"], x["context"], k1[i], k2[i], p, x["alone"], x["hot"], b[p : p + (x["place"] & 0xFFFF) + length].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.binary()])], names=["gram", "context", "k1", "k2", "lo", "alone", "hot", "raw"])

    pieces = keyed.join(by_text, ["k1", "k2"]).select("raw", "k1", "k2", "found").mapInArrow(
        released(cut), "gram long, context long, k1 long, k2 long, lo long, alone boolean, hot boolean, raw binary"
    )
    pieces = checkpointed(pieces)
    full = span(rows.filter("not mixed")).unionByName(
        span(mixed.join(contexts.filter("n > 1").select("gram", "context"), ["gram", "context"], "left_semi"))
    )
    found = full.unionByName(_compare_classes(pieces.filter("not hot"), length)).unionByName(_compare_hot(pieces.filter("hot"), length))
    return found.distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """Every row's text without the bytes that repeat: doc_id, n_bytes, spans (array of
    (a, z), maximal, half open), kept (binary: the rest, concatenated).

    A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere
    else, in this text or another; matches lie within one text. Null texts are empty, texts
    shorter than ``length`` stay whole, equal texts of at least ``length`` bytes go
    altogether, also where rows repeat. An empty table gives an empty result, null
    doc_ids stay null, and other columns are ignored.
    """
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, length).groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "z")).alias("found"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
        for batch in batches:
            found = batch.column("found").to_pylist()
            size, spans, kept = [], [], []
            for raw, some in zip(batch.column("raw"), found):
                b = memoryview(raw.as_buffer() or b"")
                gone = merged([(x["a"], x["z"]) for x in some or ()])
                edges = [0, *(x for s in gone for x in s), len(b)]
                size.append(len(b))
                spans.append([{"a": a, "z": z} for a, z in gone])
                kept.append(b"".join(b[a:z] for a, z in zip(edges[::2], edges[1::2])))
            yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "raw", "found").mapInArrow(
        released(work), "doc_id long, n_bytes long, spans array<struct<a: long, z: long>>, kept binary"
    )


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the text of every row cut to what ``remove_repeats`` keeps, and its
    n_chars with it if there is such a column; all other columns and rows stay.

    Bytes of a character that is cut in part go with it. Texts that nothing is cut from,
    null ones too, are left as they were.
    """
    k1, k2, spans_of = unused(docs, "k1", "k2", "found")
    spans = repeated_spans(_keyed(docs), length).groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "z")).alias(spans_of))
    spans = spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), spans_of)

    @F.pandas_udf("string")
    def cut(texts, found):
        import pandas as pd

        def one(text: str | None, some: list | None) -> str | None:
            if some is None or text is None:
                return text
            b = text.encode("utf-8", "surrogatepass")
            edges = [0, *(x for s in merged([(x["a"], x["z"]) for x in some]) for x in s), len(b)]
            return b"".join(b[a:z] for a, z in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")

        return pd.Series([one(t, f) for t, f in zip(texts, found)], dtype=object)

    own = _keys(F.encode(F.coalesce("text", F.lit("")), "utf-8"))
    out = docs.join(spans, (own[0] == F.col(k1)) & (own[1] == F.col(k2)), "left").withColumn("text", cut("text", spans_of))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans_of).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)

"""Packing token sequences by minimum bin slack over a histogram of lengths.

Documents may be cut: whole windows of ``capacity`` come off each document first, and what
remains of each is an item of 1 to ``capacity - 1`` tokens. A window that starts with the
longest item left takes the multiset of remaining lengths that leaves the least slack: a
subset-sum over bitsets of reachable totals, with the counts backtracked. Since only
lengths matter, the plan needs just their histogram, and a multiset is used as often as
the counts allow, so that the plan's size does not depend on the number of documents. The
windows with the most slack are then dissolved: their items follow each other in a stream
that is cut to fill the slack of the others, and what is left of it, less than a window, is
cut into powers of two, which need no padding.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed, released, texts
from sightline.llm.tokens import crc_of, word_encoder

ROWS_IN_BUCKET = 50_000


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, times), within the counts, whose total comes closest to ``room`` from below."""
    full, mask = 1 << room, (1 << (room + 1)) - 1
    steps, bits = [], 1
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        if bits & full:
            break
        steps.append((length, bits))
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            bits |= (bits << (length * times)) & mask
            left, times = left - times, times * 2
    chosen, rest = [], bits.bit_length() - 1
    for length, before in reversed(steps):
        times = 0
        while not before >> rest & 1:
            rest, times = rest - length, times + 1
        if times:
            chosen.append((length, times))
    return chosen


def least_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths and times of a window, number of such windows): all items, each window with as
    little slack as what is left allows."""
    left, out = {n: c for n, c in histogram.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        window = dict(fill(left, capacity - longest))
        left[longest] += 1
        window[longest] = window.get(longest, 0) + 1
        again = min(left[n] // c for n, c in window.items())
        for n, c in window.items():
            left[n] -= again * c
            if not left[n]:
                del left[n]
        out.append((window, again))
    return out


class Plan:
    """Where the item of a given length and rank goes."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        found = [(sum(n * c for n, c in window.items()), window, again) for window, again in least_slack(histogram, capacity)]
        demand, supply, stream = sum((capacity - total) * again for total, _, again in found), 0, {}
        kept = []
        for total, window, again in sorted(found, key=lambda x: -x[0]):
            kept.append([total, window, again])
        while supply < demand:
            total, window, again = kept[-1]
            # Each window that goes takes its slack with it and adds its items.
            gone = min(again, -(-(demand - supply) // capacity))
            demand, supply = demand - gone * (capacity - total), supply + gone * total
            for n, c in window.items():
                stream[n] = stream.get(n, 0) + gone * c
            kept[-1][2] -= gone
            if not kept[-1][2]:
                kept.pop()
        #: By length: first ranks of the steps, and (first window, times in a window, offset).
        self.first: dict[int, list[int]] = {}
        self.steps: dict[int, list[tuple[int, int, int]]] = {}
        #: Of the stream: where each kind of slack begins in it, and (first window, offset there, slack).
        self.slack_first, self.slacks = [], []
        used, self.windows, filled = dict.fromkeys(histogram, 0), 0, 0
        for total, window, again in kept:
            offset = 0
            for n, c in window.items():
                self.first.setdefault(n, []).append(used[n])
                self.steps.setdefault(n, []).append((self.windows, c, offset))
                offset += n * c
                used[n] += again * c
            if total < capacity:
                self.slack_first.append(filled)
                self.slacks.append((self.windows, total, capacity - total))
                filled += again * (capacity - total)
            self.windows += again
        self.filled = filled
        self.stream_first = {n: used[n] for n in stream}
        self.stream_base, total = {}, 0
        for n in sorted(stream):
            self.stream_base[n] = total
            total += n * stream[n]
        rest = total - filled
        tail = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        for i, size in enumerate(tail):
            self.slack_first.append(filled)
            self.slacks.append((self.windows + i, 0, size))
            filled += size
        self.sequences = self.windows + len(tail)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the item, length, sequence, offset) of each of its pieces."""
        if rank < self.stream_first.get(length, rank + 1):
            i = bisect_right(self.first[length], rank) - 1
            window, times, offset = self.steps[length][i]
            nth = rank - self.first[length][i]
            return [(0, length, window + nth // times, offset + nth % times * length)]
        at, out, done = self.stream_base[length] + (rank - self.stream_first[length]) * length, [], 0
        while done < length:
            i = bisect_right(self.slack_first, at + done) - 1
            window, offset, size = self.slacks[i]
            nth, into = divmod(at + done - self.slack_first[i], size)
            take = min(length - done, size - into)
            out.append((done, take, window + nth, offset + into))
            done += take
        return out


def _lengths(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int) -> DataFrame:
    """Of each row its number of tokens, and the crc32 of each whole window and of the rest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            n, whole, rest = [], [], []
            for raw in encoder.encode(batch.column("text").to_pylist()):
                ids = np.frombuffer(raw + end, dtype=encoder.dtype)
                cut = len(ids) // capacity * capacity
                n.append(len(ids))
                whole.append([crc_of(ids[a : a + capacity]) for a in range(0, cut, capacity)])
                rest.append(crc_of(ids[cut:]))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("k"), pa.array(n, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(rest, pa.int64())],
                names=["doc_id", "k", "n", "whole", "rest_crc"],
            )

    return docs.mapInArrow(released(work), "doc_id long, k string, n long, whole array<long>, rest_crc long")


def _crcs_of_cuts(docs: DataFrame, cuts: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """(k, start, length, cut_crc) of the pieces (doc_id, k, start, length) of items that were cut, from their texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()
        for batch in batches:
            rows = []
            for k, raw, wanted in zip(batch.column("k").to_pylist(), encoder.encode(batch.column("text").to_pylist()), batch.column("wanted").to_pylist()):
                ids = np.frombuffer(raw + end, dtype=encoder.dtype)
                rows += [(k, x["start"], x["length"], crc_of(ids[x["start"] : x["start"] + x["length"]])) for x in wanted]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] + [pa.int64()] * 3)], names=["k", "start", "length", "cut_crc"])

    # Of copies of a text, one is encoded again.
    wanted = cuts.groupBy("k").agg(F.collect_set(F.struct("start", "length")).alias("wanted"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("of"))
    wanted = wanted.select("k", "wanted", F.col("of.doc_id").alias("doc_id")).alias("w")
    held = docs.alias("d").join(wanted, (F.col("d.k") == F.col("w.k")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.k", "d.text", "w.wanted")
    held = held.groupBy("k").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    return held.select("k", "text", "wanted").mapInArrow(released(work), "k string, start long, length long, cut_crc long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int | None = 2) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id lies in exactly one piece and each sequence is filled without gaps from 0;
    sequences have ``capacity`` ids, but for the last ones, which have a power of two, so
    that nothing is padded. ``end_id`` closes each document. Null texts are empty documents
    (their end id alone), null doc_ids stay null, repeated rows are packed each, an empty
    table gives no pieces, and other columns are ignored.

    The driver sees one row for each length under ``capacity``. Ranks within a length are
    counted in buckets of about ROWS_IN_BUCKET rows, so that a length that many documents
    share is never sorted in one task.
    """
    keyed = texts(docs).withColumn("k", F.md5("text"))
    own = checkpointed(
        _lengths(keyed, tokenizer, end_id, capacity)
        .select("*", (F.col("n") % capacity).alias("rest"), F.floor(F.col("n") / capacity).alias("n_whole"))
    )
    histogram = {x["rest"]: x["c"] for x in own.groupBy("rest").agg(F.count("*").alias("c")).collect()}
    n_rows = sum(histogram.values())
    plan = Plan({n: c for n, c in histogram.items() if n}, capacity)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(plan)
    n_buckets = max(16, -(-n_rows // ROWS_IN_BUCKET))
    order = ("doc_id", "k")
    ranked = own.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k", "rest"), F.lit(n_buckets))).select(
        "*",
        (F.row_number().over(Window.partitionBy("bucket", "rest").orderBy(*order)) - 1).alias("rank_here"),
        (F.sum("n_whole").over(Window.partitionBy("bucket").orderBy("rest", *order, F.col("rest_crc")).rowsBetween(Window.unboundedPreceding, -1))).alias("whole_here"),
    )
    sizes = own.groupBy(F.pmod(F.xxhash64("doc_id", "k", "rest"), F.lit(n_buckets)).alias("bucket"), "rest").agg(F.count("*").alias("c"), F.sum("n_whole").alias("w"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole_base = sizes.groupBy("bucket").agg(F.sum("w").alias("w")).select("bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("whole_base"))
    rank_base = sizes.select("bucket", "rest", F.coalesce(F.sum("c").over(before.partitionBy("rest")), F.lit(0)).alias("rank_base"))
    placed = checkpointed(
        ranked.join(rank_base, ["bucket", "rest"]).join(whole_base, "bucket").select(
            "doc_id", "k", "n", "whole", "rest", "rest_crc", (F.col("rank_here") + F.col("rank_base")).alias("rank"),
            (F.coalesce("whole_here", F.lit(0)) + F.col("whole_base")).alias("first_whole"),
        )
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        kinds = [pa.int64(), pa.string()] + [pa.int64()] * 6
        names = ["doc_id", "k", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows = []
            for doc, k, n, whole, rest, crc, rank, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "n", "whole", "rest", "rest_crc", "rank", "first_whole"))):
                rows += [(doc, k, i * capacity, capacity, c, n, plan.sequences + first + i, 0) for i, c in enumerate(whole)]
                if rest:
                    found = plan.place(rest, rank)
                    rows += [(doc, k, n - rest + a, m, crc if m == rest else None, n, s, o) for a, m, s, o in found]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    pieces = placed.mapInArrow(released(work), "doc_id long, k string, start long, length long, crc long, doc_tokens long, sequence_id long, offset long")
    cut = pieces.filter("crc is null").select("doc_id", "k", "start", "length")
    crcs = _crcs_of_cuts(keyed, cut, tokenizer, end_id)
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    whole = pieces.filter("crc is not null").withColumnRenamed("crc", "ids_crc32").select(*columns)
    rest = pieces.filter("crc is null").join(crcs, ["k", "start", "length"]).withColumnRenamed("cut_crc", "ids_crc32").select(*columns)
    return whole.unionByName(rest)

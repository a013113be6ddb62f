"""Near copies by SimHash and exact Jaccard similarity of word shingles: fingerprints in pigeonhole blocks, exact
check, then a prefix filter, bitmaps and the exact check for what fingerprints leave open, components.

Sets of shingles have SimHash fingerprints; those at most two bits apart are found as in simhash.near_links and checked
with the texts. That links copies with few edits. What stands in one component from there on isn't compared again.

Shingles have one order for all documents, rare ones first, by counts over all documents: what only some copies of a
text were given comes before what all of them hold, so that copies that differ in more than a prefix don't meet. Two sets whose similarity is at
least s share one of their first n - ceil(s n) + 1 shingles, so that documents which meet
nowhere there needn't be compared and no pair is missed. Those that meet are cut by size: the smaller of
a near pair has at least s times as many shingles as the larger. (Pigeonhole blocks of a 64-bit
SimHash alone can't reach this: pairs at 0.8 differ in about 10 bits and often in 16.)

Sets that meet are first compared by bitmaps in which each shingle flips one bit: two
bitmaps differ in at most as many bits as the sets do in shingles, so that no near pair is
dropped, and few others pass. Of those, only edges that connect what passes are checked
with the texts; pairs that a failed edge leaves open follow in a second round.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import broadcast_if_small, checkpointed, free_shuffles, released, stored, texts
from sightline.llm.graph import connected_components
from sightline.llm.simhash import BITS, least_rows, majority, near_links

#: Slots in which shingles are counted, a power of two; any order of shingles gives the same result.
SLOTS = 1 << 24
#: Classes that are compared with each other at once; more are cut into blocks of this size.
BLOCK = 4096


def shingles_of(text: str, width: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct shingles, sorted, as XXH64; words are those of simhash.fingerprint_of."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    rows = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.unique(np.array([xxh64_intdigest(s, seed) for s in rows], dtype=np.uint64).view(np.int64))


def _name(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(shingles.tobytes())
    return x - (1 << 64) if x >> 63 else x


def _fingerprint(shingles: np.ndarray) -> int:
    x = majority(shingles.view("<u8"))
    return x - (1 << BITS) if x >> (BITS - 1) else x


def prefix_length(n: int, least: Fraction) -> int:
    return n - -(-n * least.numerator // least.denominator) + 1 if n else 0


def shingle_counts(docs: DataFrame, width: int, seed: int) -> np.ndarray:
    """About how many documents hold the shingles of each of SLOTS slots (the low bits), as a number from 0 to 255 that
    rises with it. All documents are counted; one task tells up to 255 in a slot apart."""
    part = 1 << 14

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint8)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                slots = shingles_of(t, width, seed) & (SLOTS - 1)
                counts[slots] = np.minimum(counts[slots], 254) + 1
        for first in range(0, SLOTS // part, 64):
            out = []
            for k in range(first, min(first + 64, SLOTS // part)):
                own = counts[k * part : (k + 1) * part]
                if len(at := np.flatnonzero(own)):
                    out.append((k, at.astype(np.uint16).tobytes(), own[at].tobytes()))
            if out:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["unit", "slots", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sums = None, np.zeros(part, np.int64)

        def finish() -> pa.RecordBatch:
            ranks = np.minimum(10 * np.log2(1 + sums), 255).astype(np.uint8)
            return pa.record_batch([pa.array([unit], pa.int64()), pa.array([ranks.tobytes()], pa.binary())], names=["unit", "ranks"])

        for batch in batches:
            for u, slots, counts in zip(*(batch.column(c).to_pylist() for c in ("unit", "slots", "counts"))):
                if u != unit:
                    if unit is not None:
                        yield finish()
                    unit, sums = u, np.zeros(part, np.int64)
                sums[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, np.uint8)
        if unit is not None:
            yield finish()

    counted = texts(docs).select("text").mapInArrow(released(count), "unit long, slots binary, counts binary")
    ranks = np.zeros(SLOTS, np.uint8)
    for unit, raw in counted.repartition("unit").sortWithinPartitions("unit").mapInArrow(released(total), "unit long, ranks binary").collect():
        ranks[unit * part : (unit + 1) * part] = np.frombuffer(raw, np.uint8)
    return ranks


def _entries(own: DataFrame, ranks, least: Fraction, width: int, seed: int) -> DataFrame:
    """(token, fp, n, rest): the shingles of each prefix and how many shingles follow."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        seen: set[int] = set()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t in batch.column("text").to_pylist():
                s = shingles_of(t, width, seed)
                name, n = _name(s), len(s)
                # Copies within a task are one class.
                if not n or name in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(name)
                # A stable sort leaves shingles of one rank in their own order.
                order = s[np.argsort(rank[s & (SLOTS - 1)], kind="stable")]
                p = prefix_length(n, least)
                for o, x in zip(out, (order[:p], np.full(p, name), np.full(p, n), n - 1 - np.arange(p))):
                    o.append(x)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(o), pa.int64()) for o in out], names=["token", "fp", "n", "rest"])

    return own.select("text").mapInArrow(released(work), "token long, fp long, n long, rest long")


def _by_size(met: DataFrame, least: Fraction) -> DataFrame:
    """``met`` (token, n and more) with buckets cut where sizes leap: sets below ``least`` of the next
    larger one of their bucket are near to none that is larger. ``token`` names the part then."""
    sizes = Window.partitionBy("token").orderBy("n")
    leaps = met.withColumn("leap", (F.lag("n").over(sizes) * least.denominator < F.col("n") * least.numerator).cast("int"))
    cut = leaps.withColumn("part", F.coalesce(F.sum("leap").over(sizes), F.lit(0)))
    return cut.withColumn("token", F.xxhash64("token", "part")).select(*met.columns)


def overlaps(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``p`` shares with each of ``q``."""
    if len(p) == len(q) == 1:
        return np.array([[len(np.intersect1d(p[0], q[0], assume_unique=True))]])
    both = [*p, *q]
    values, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    # Only what several sets hold counts; a slice of columns at a time bounds the memory.
    new = np.cumsum(count > 1) - 1
    use = count[column] > 1
    row, column = row[use], new[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    found = np.zeros((len(p), len(q)), dtype=np.int64)
    width = 4096
    for a in range(0, int(new[-1]) + 1 if len(new) else 0, width):
        lo, hi = np.searchsorted(column, (a, a + width))
        x = np.zeros((len(both), width), dtype=np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        found += np.rint(x[: len(p)] @ x[len(p) :].T).astype(np.int64)
    return found


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the symmetric matrix ``near`` that connect all it connects."""
    out, todo = [], near.any(axis=1)
    while todo.any():
        root = int(np.flatnonzero(todo)[0])
        todo[root] = False
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(near[at] & todo)
            todo[new] = False
            front += new.tolist()
            out += [(at, int(x)) for x in new]
    return out


def _compare(rows: DataFrame, least: Fraction) -> DataFrame:
    """(src, dst): of rows (unit, side, fp, s), links that connect the near sets of each unit.
    Sets on side 0 are compared with those on side 1, and those on side 2 with each other."""

    def group(side: np.ndarray, names: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        p, q = _sides(side)
        if not len(p) or not len(q):
            return []
        n = np.array([len(x) for x in sets], dtype=np.int64)
        shared = overlaps([sets[i] for i in p], [sets[i] for i in q])
        near = shared * least.denominator >= (n[p][:, None] + n[q][None, :] - shared) * least.numerator
        full = np.zeros((len(side),) * 2, dtype=bool)
        full[np.ix_(p, q)] = near
        full |= full.T
        np.fill_diagonal(full, False)
        return [(int(names[a]), int(names[b])) for a, b in forest(full)]

    def compared(unit: int, side: list, fp: list, raw: list) -> list[tuple[int, int]]:
        return group(np.array(side), np.array(fp), [np.frombuffer(x, np.int64) for x in raw])

    return _by_unit(rows, ("side", "fp", "s"), compared, "src long, dst long")


def bitmap_of(shingles: np.ndarray) -> bytes:
    """A bit for each slot, set if an odd number of shingles fall into it; as many slots as
    shingles, rounded up to a power of two. Folding it in half gives the next smaller one."""
    slots = 1 << max(6, (len(shingles) - 1).bit_length())
    odd = np.bincount(shingles & (slots - 1), minlength=slots).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def _passing(n: np.ndarray, maps: list[bytes], p: np.ndarray, q: np.ndarray, least: Fraction) -> np.ndarray:
    """Which sets of ``p`` may be near those of ``q`` (places in ``n`` and ``maps``), by size and bitmaps."""
    found = np.zeros((len(p), len(q)), dtype=bool)
    words = np.array([len(m) // 8 for m in maps])
    for w in np.unique(words[p]):
        of_p = np.flatnonzero(words[p] == w)
        of_p = of_p[np.argsort(n[p[of_p]], kind="stable")]
        for v in (w // 2, w, 2 * w):
            of_q = np.flatnonzero(words[q] == v)
            if not len(of_q):
                continue
            width = min(w, v)
            a, b = (_folded([maps[i] for i in side], width) for side in (p[of_p], q[of_q]))
            for lo in range(0, len(of_p), 256):
                rows = of_p[lo : lo + 256]
                size = n[p[rows]][:, None], n[q[of_q]][None, :]
                both = size[0] + size[1]
                # That many at least are shared by near sets, and so that many at most are not.
                shared = -(-both * least.numerator // (least.numerator + least.denominator))
                fits = np.minimum(*size) * least.denominator >= np.maximum(*size) * least.numerator
                use = np.flatnonzero(fits.any(axis=0))
                if not len(use):
                    continue
                differ = np.zeros((len(rows), len(use)), dtype=np.int64)
                for k in range(width):
                    differ += np.bitwise_count(a[lo : lo + 256, k, None] ^ b[None, use, k])
                found[np.ix_(rows, of_q[use])] = fits[:, use] & (differ <= (both - 2 * shared)[:, use])
    return found


def _folded(maps: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(maps), dtype=np.uint64).reshape(len(maps), -1, width)
    return np.bitwise_xor.reduce(x, axis=1)


def _by_unit(rows: DataFrame, columns: tuple[str, ...], group, result: str) -> DataFrame:
    """What ``group`` yields from the columns of each unit's rows, taken one unit after another."""
    names = [x.split()[0] for x in result.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, out = None, [], []

        def finish() -> None:
            if held:
                out.extend(group(unit, *map(list, zip(*held))))

        for batch in batches:
            for u, *row in zip(*(batch.column(c).to_pylist() for c in ("unit", *columns))):
                if u != unit:
                    finish()
                    unit, held = u, []
                held.append(row)
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
                out = []
        finish()
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return rows.repartition("unit").sortWithinPartitions("unit", "side", "fp").select("unit", *columns).mapInArrow(released(work), result)


def _sides(side) -> tuple[np.ndarray, np.ndarray]:
    """The places that are compared with each other: all on side 2, or side 0 with side 1."""
    s = np.array(side)
    return (np.arange(len(s)),) * 2 if s[0] == 2 else (np.flatnonzero(s == 0), np.flatnonzero(s == 1))


def _first_edges(rows: DataFrame, least: Fraction) -> DataFrame:
    """(src, dst): edges that connect the sets of each unit (all on side 2) that may be near."""

    def group(unit: int, side: list, fp: list, n: list, maps: list) -> list[tuple[int, int]]:
        p, q = _sides(side)
        near = _passing(np.array(n), maps, p, q, least)
        np.fill_diagonal(near, False)
        return [(fp[a], fp[b]) for a, b in forest(near)]

    return _by_unit(rows, ("side", "fp", "n", "bits"), group, "src long, dst long")


def _open_pairs(rows: DataFrame, least: Fraction, most: int = 8) -> DataFrame:
    """(src, dst, unit): pairs of different components that may be near; of a unit with more
    than ``most`` times as many of them as sets, its name alone."""

    def group(unit: int, side: list, fp: list, n: list, maps: list, component: list) -> list[tuple]:
        p, q = _sides(side)
        of = np.array(component)
        near = _passing(np.array(n), maps, p, q, least) & (of[p][:, None] != of[q][None, :])
        if near.sum() > 2 * most * len(fp):
            return [(None, None, unit)]
        names = np.array(fp)
        pairs = {(int(min(a, b)), int(max(a, b))) for a, b in zip(*(names[s[i]] for s, i in zip((p, q), np.nonzero(near))))}
        return [(a, b, None) for a, b in pairs]

    return _by_unit(rows, ("side", "fp", "n", "bits", "component"), group, "src long, dst long, unit long")


def _checked(edges: DataFrame, texts_of, least: Fraction, width: int, seed: int, share: int = 256) -> DataFrame:
    """The edges (src, dst; distinct) whose sets are near, by the texts. What hangs on one
    ``src`` is dealt out in parts of about ``share``."""
    parts = edges.groupBy("src").agg(F.ceil(F.count("*") / share).alias("parts"))
    dealt = edges.join(parts, "src").select("src", "dst", F.pmod(F.xxhash64("dst"), F.col("parts")).alias("part"))
    rows = dealt.select("src", "part", F.col("src").alias("fp")).distinct().unionByName(dealt.select("src", "part", F.col("dst").alias("fp")))
    rows = texts_of(rows).withColumn("other", F.col("fp") != F.col("src"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for src, part, fp, text in zip(*(batch.column(c).to_pylist() for c in ("src", "part", "fp", "text"))):
                s = shingles_of(text, width, seed)
                if (src, part) != at:
                    at, own = (src, part), s
                elif len(shared := np.intersect1d(own, s, assume_unique=True)) * least.denominator >= (len(own) + len(s) - len(shared)) * least.numerator:
                    out.append((src, fp))
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], names=["src", "dst"])

    dealt_out = rows.repartition("src", "part").sortWithinPartitions("src", "part", "other", "fp").select("src", "part", "fp", "text")
    return dealt_out.mapInArrow(released(work), "src long, dst long")


def _fingerprint_edges(classes: DataFrame) -> DataFrame:
    """(src, dst): edges between the sets (fp) whose fingerprints (sim) connect within two bits; equal ones lead to the smallest fp."""
    heads = checkpointed(classes.groupBy("sim").agg(F.min("fp").alias("head"), F.count("*").alias("n")))
    end = lambda a, b: heads.select(F.col("sim").alias(a), F.col("head").alias(b))
    between = near_links(heads.select(F.col("sim").alias("fp"))).toDF("a", "b").join(end("a", "src"), "a").join(end("b", "dst"), "b")
    equal = classes.select("fp", "sim").join(heads.filter("n > 1"), "sim").filter("fp <> head").select(F.col("fp").alias("src"), F.col("head").alias("dst"))
    return checkpointed(between.select("src", "dst").unionByName(equal).distinct())


def _links(met: DataFrame, maps: DataFrame, known: DataFrame, linked: DataFrame, texts_of, least: Fraction, width: int, seed: int, pair_limit: int) -> DataFrame:
    """(src, dst): links that with those ``known`` connect all near sets. ``met`` has the entries
    (token, fp, n, rest, and c, the component by ``known``) of shingles that ``m`` > 1 sets of
    several components hold in front, ``maps`` each set's n and bits, ``linked`` the components
    (node, component) of ``known``; ``texts_of`` joins a table that has fp with the text of each.

    Buckets of up to ``pair_limit`` classes give pairs, larger ones stars; a component of
    these is cut into blocks of about BLOCK classes. Each block is compared with itself. Once what is near has one component, the
    buckets and pairs that hold several components in several blocks are compared, buckets
    of more than BLOCK classes in parts.
    """
    num, den = F.lit(least.numerator), F.lit(least.denominator)
    small = met.filter(F.col("m") <= pair_limit).select("token", "fp", "n", "rest", "c")
    other = small.select("token", F.col("fp").alias("fp2"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("c").alias("c2"))
    # The first shingle that both share bounds how many they can share at most.
    pairs = checkpointed(
        small.join(other, "token").filter("fp < fp2 and c <> c2").filter(F.least("n", "n2") * den >= F.greatest("n", "n2") * num)
        .groupBy("fp", "fp2").agg(F.first("n").alias("n"), F.first("n2").alias("n2"), F.max(F.least("rest", "rest2") + 1).alias("most"))
        .filter(F.col("most") * den >= (F.col("n") + F.col("n2") - F.col("most")) * num).select("fp", "fp2")
    )
    large = met.filter(F.col("m") > pair_limit).select("token", "fp", "m")
    stars = checkpointed(large.join(large.groupBy("token").agg(F.min("fp").alias("dst")), "token").filter("fp <> dst").groupBy(F.col("fp").alias("src"), "dst").agg(F.max("m").alias("m")))
    member = checkpointed(connected_components(checkpointed(pairs.toDF("src", "dst").unionByName(stars.select("src", "dst")))).withColumnRenamed("node", "fp"))
    sizes = member.groupBy("component").agg(F.count("*").alias("size"))
    # In a larger component, those that share their most common bucket stand together, in about as few blocks as hold it.
    home = large.groupBy("fp").agg(F.max(F.struct("m", "token")).alias("x")).select("fp", F.col("x.token").alias("home"))
    homed = member.join(sizes, "component").join(home, "fp", "left")
    homed = homed.select("fp", F.xxhash64("component", F.pmod(F.xxhash64("home"), F.ceil(F.col("size") / BLOCK))).alias("home"))
    homed = homed.join(homed.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("k")), "home")
    placed = checkpointed(homed.select("fp", F.xxhash64("home", F.pmod(F.xxhash64("fp"), F.col("k"))).alias("block")))

    def mapped(units: DataFrame) -> DataFrame:
        return units.join(maps, "fp")

    alone = placed.select(F.col("block").alias("unit"), F.lit(2).alias("side"), "fp")
    first = _first_edges(mapped(alone), least)
    # Each class is also tried with the first one of its most common bucket, which may be in another block.
    far = stars.groupBy("src").agg(F.max(F.struct("m", "dst")).alias("x")).select("src", "x.dst")
    # Edges inside a component of fingerprints say nothing new.
    of = lambda a, b: linked.select(F.col("node").alias(a), F.col("component").alias(b))
    tried = first.unionByName(far).distinct().join(of("src", "c"), "src", "left").join(of("dst", "c2"), "dst", "left")
    tried = checkpointed(tried.filter("coalesce(c, src) <> coalesce(c2, dst)").select("src", "dst"))
    good = checkpointed(_checked(tried, texts_of, least, width, seed))
    failed = tried.join(good, ["src", "dst"], "left_anti")
    named = placed.join(connected_components(good.unionByName(known)).withColumnRenamed("node", "fp"), "fp", "left")
    named = checkpointed(named.select("fp", "block", F.coalesce("component", "fp").alias("component")))

    # What is still open: blocks with a failed edge, and pairs and buckets of several blocks and components.
    again = failed.select(F.explode(F.array("src", "dst")).alias("fp")).join(placed, "fp").select("block").distinct()
    again = named.join(again, "block").select(F.xxhash64(F.lit("block"), "block").alias("unit"), F.lit(2).alias("side"), "fp", "component")
    crossing = pairs.join(named, "fp").join(named.toDF("fp2", "block2", "component2"), "fp2").filter("block <> block2 and component <> component2")
    pair_unit = F.xxhash64(F.lit("pair"), "fp")
    ends = crossing.select(pair_unit.alias("unit"), F.lit(0).alias("side"), "fp", "component").distinct().unionByName(crossing.select(pair_unit.alias("unit"), F.lit(1).alias("side"), F.col("fp2").alias("fp"), F.col("component2").alias("component")))
    held = checkpointed(large.select("token", "fp").join(named, "fp"))
    counts = held.groupBy("token", "component").agg(F.count("*").alias("n"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    top = F.max(F.struct("n", "component"))
    buckets = counts.groupBy("token").agg(F.sum("n").alias("n"), top.alias("top"), F.count("*").alias("components"), F.min("b0").alias("b0"), F.max("b1").alias("b1"))
    buckets = buckets.filter("components > 1 and b0 <> b1")
    # The largest component needn't be compared with itself: a bucket of k parts and few others has about one row a class.
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    shares = buckets.select("token", F.col("top.component").alias("c"), parts(F.col("top.n")).alias("k"), parts(F.col("n") - F.col("top.n")).alias("l"), (F.col("n") <= BLOCK).alias("whole"))
    inside = held.join(shares, "token").withColumn("own", F.col("component") == F.col("c"))
    inside = inside.withColumn("p", F.pmod(F.xxhash64("fp"), F.when(F.col("own"), F.col("k")).otherwise(F.col("l"))).cast("int"))
    unit = lambda *x: F.xxhash64(F.lit("bucket"), "token", *x)
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("q")
    seen = checkpointed(inside.select("token", "fp", "component", "own", "p", "k", "l", "whole"))
    of_top = seen.filter("own and not whole").select("*", to("l")).select(unit(F.lit("top"), "p", "q").alias("unit"), F.lit(0).alias("side"), "fp", "component")
    facing = seen.filter("not own and not whole").select("*", to("k")).select(unit(F.lit("top"), "q", "p").alias("unit"), F.lit(1).alias("side"), "fp", "component")
    among = seen.filter("not own and not whole").select("*", to("l")).select(
        unit(F.lit("rest"), F.least("p", "q"), F.greatest("p", "q")).alias("unit"),
        F.when(F.col("p") == F.col("q"), 2).when(F.col("p") < F.col("q"), 0).otherwise(1).alias("side"), "fp", "component",
    )
    few = seen.filter("whole").select(unit(F.lit("whole")).alias("unit"), F.lit(2).alias("side"), "fp", "component")
    met_in = few.unionByName(of_top).unionByName(facing).unionByName(among)
    units = checkpointed(again.unionByName(ends).unionByName(met_in))
    if units.isEmpty():
        return good
    left = checkpointed(_open_pairs(mapped(units), least))
    second = left.filter("unit is null").select("src", "dst").distinct().join(tried, ["src", "dst"], "left_anti")
    second = checkpointed(second.join(tried.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti"))
    good = good.unionByName(_checked(second, texts_of, least, width, seed))
    dense = left.filter("unit is not null").select("unit").distinct()
    whole = checkpointed(units.join(dense, "unit").select("unit", "side", "fp"))
    if whole.isEmpty():
        return good

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles_of(t, width, seed).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("fp"), pa.array(found, pa.binary())], names=["fp", "s"])

    own = texts_of(whole.select("fp").distinct()).select("fp", "text").mapInArrow(released(sets), "fp long, s binary")
    return good.unionByName(_compare(whole.join(own, "fp"), least))


def _components(docs: DataFrame, similarity: str, width: int, seed: int, pair_limit: int) -> DataFrame:
    """doc_id, h (hash of the text), fp (name of the set of shingles), component_id of every row."""
    spark, least = docs.sparkSession, Fraction(similarity)
    free_shuffles(spark)
    hashed = texts(docs).withColumn("h", F.xxhash64("text"))

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles_of(t, width, seed) for t in batch.column("text").to_pylist()]
            columns = pa.array(map(_name, found), pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(map(bitmap_of, found), pa.binary()), pa.array(map(_fingerprint, found), pa.int64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), *columns], names=["doc_id", "h", "fp", "n", "bits", "sim"])

    own = stored(hashed.mapInArrow(released(names), "doc_id long, h long, fp long, n long, bits binary, sim long"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("x")
    classes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("sim").alias("sim"), first).select("fp", "least", "sim", F.col("x.doc_id").alias("doc_id"), F.col("x.h").alias("h")))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """``wanted`` with the text of the row that stands for each fp."""
        keys = checkpointed(classes.drop("least", "sim").join(wanted.select("fp").distinct(), "fp"))
        found = hashed.alias("d").join(broadcast_if_small(keys).alias("c"), same("d", "c")).select("c.fp", "d.text")
        return wanted.join(found.groupBy("fp").agg(F.first("text").alias("text")), "fp")

    known = checkpointed(_checked(_fingerprint_edges(classes), texts_of, least, width, seed))
    linked = checkpointed(connected_components(known))
    ranks = spark.sparkContext.broadcast(shingle_counts(docs, width, seed))
    entries = _entries(hashed, ranks, least, width, seed).repartition("token").groupBy("token", "fp").agg(F.first("n").alias("n"), F.first("rest").alias("rest"))
    bucket = Window.partitionBy("token")
    met = stored(entries.withColumns({
        "m": F.count("*").over(bucket), "x": F.bit_xor(F.xxhash64("fp")).over(bucket), "y": F.bit_xor(F.xxhash64("fp", F.lit(1))).over(bucket), "r": F.sum("rest").over(bucket),
    }).filter("m > 1"))
    # Shingles that the same sets hold, such as those of one passage, are one bucket: that of the first of them in the order of all.
    chosen = met.groupBy("m", "x", "y").agg(F.max(F.struct("r", "token")).alias("first")).select(F.col("first.token").alias("token"))
    met = met.join(chosen, "token").select("token", "fp", "n", "rest").join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    met = checkpointed(_by_size(met.select("token", "fp", "n", "rest", F.coalesce("component", "fp").alias("c")), least))
    # A bucket whose sets fingerprints have linked already has nothing to add.
    mixed = met.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("m")).filter("c0 <> c1").select("token", "m")
    met = checkpointed(met.join(mixed, "token"))
    meeting = classes.join(met.select("fp").distinct(), "fp").select(F.col("fp").alias("c_fp"), "doc_id", "h").alias("c")
    maps = own.alias("d").join(meeting, (F.col("d.fp") == F.col("c.c_fp")) & same("d", "c")).select("d.fp", "d.n", "d.bits").dropDuplicates(["fp"])
    maps = stored(maps)
    links = checkpointed(known.unionByName(_links(met, maps, known, linked, texts_of, least, width, seed, pair_limit)))
    member = connected_components(links).withColumnRenamed("node", "fp")
    linked = member.join(classes.select("fp", "least"), "fp")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    of_class = classes.select("fp", "least").join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return own.select("doc_id", "h", "fp").join(of_class, "fp")


def components(docs: DataFrame, similarity: str = "0.8", width: int = 5, seed: int = 42, pair_limit: int = 16) -> DataFrame:
    """(doc_id, component_id) of every row: rows whose sets of ``width``-word shingles have a
    Jaccard similarity of at least ``similarity`` are linked, all of them. Texts without words
    are equal. Other cases are those of simhash.components."""
    return _components(docs, similarity, width, seed, pair_limit).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, similarity: str = "0.8", width: int = 5, seed: int = 42, pair_limit: int = 16) -> DataFrame:
    """One row of each component, all columns kept, chosen as simhash.drop_near_duplicates does."""
    return least_rows(docs, _components(docs, similarity, width, seed, pair_limit))

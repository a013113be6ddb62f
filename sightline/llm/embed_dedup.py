"""Near-duplicate vectors: binary codes by iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation is learnt that spreads the variance of the vectors evenly over balanced bits.
The code is cut into substrings; vectors of one label meet in a table if a substring
differs in one bit at most, each table holding one entry for each masked bit. What meets
is compared by the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed, released, smallest_hashes
from sightline.llm.graph import connected_components

#: Vectors that the rotation is learnt from at most: those with the smallest hash of their id.
SAMPLE_ROWS = 8_192
CODE_BITS, TABLES = 64, 4
#: Vectors that are compared with each other at once; larger table entries are cut into blocks of this size.
BLOCK = 512


class Quantiser:
    """Mean, and the projection whose signs are the bits of a code."""

    def __init__(self, mean: np.ndarray, projection: np.ndarray) -> None:
        self.mean, self.projection = mean, projection

    @property
    def bits(self) -> int:
        return self.projection.shape[1]

    @classmethod
    def fit(cls, x: np.ndarray, bits: int = CODE_BITS, rounds: int = 50, seed: int = 5) -> Quantiser:
        """Principal directions, then turns that bring the projections closest to their signs."""
        mean = x.mean(axis=0)
        centred = x - mean
        values, vectors = np.linalg.eigh(centred.T @ centred / max(1, len(x)))
        w = vectors[:, np.argsort(-values, kind="stable")[:bits]]
        v = centred @ w
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(w.shape[1],) * 2))[0]
        for _ in range(rounds):
            signs = np.where(v @ turn > 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(v.T @ signs)
            turn = u @ vt
        return cls(mean, w @ turn)

    def codes(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.projection > 0
        return (bits.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def substrings(self, tables: int = TABLES) -> list[tuple[int, int]]:
        """(first bit, width) of each substring."""
        edges = [round(self.bits * t / min(tables, self.bits)) for t in range(min(tables, self.bits) + 1)]
        return [(a, z - a) for a, z in zip(edges, edges[1:])]


def table_keys(codes: np.ndarray, substrings: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(entries of a table, their numbers): for each code one entry for each bit, which is masked."""
    keys, numbers, number = [], [], 0
    for first, width in substrings:
        part = (codes >> np.uint64(first)) & np.uint64((1 << width) - 1)
        for b in range(width):
            keys.append(part & ~np.uint64(1 << b))
            numbers.append(number)
            number += 1
    return np.array(keys, dtype=np.uint64).T, np.array(numbers, dtype=np.int64)


def first_meeting(a: np.ndarray, b: np.ndarray, substrings: list[tuple[int, int]]) -> np.ndarray:
    """The first entry number in which two codes meet, -1 if in none; so each pair is compared once."""
    differ = a[:, None] ^ b[None, :]
    out, number = np.full(differ.shape, -1, dtype=np.int64), 0
    for first, width in substrings:
        part = (differ >> np.uint64(first)) & np.uint64((1 << width) - 1)
        count = np.bitwise_count(part)
        new = (out < 0) & (count <= 1)
        bit = np.bitwise_count((part - np.uint64(1)) & ~part)  # the bit's place where one differs
        out[new] = number + np.where(count == 1, bit, 0)[new]
        number += width
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vector in doubles at length one, of rows that can link with others."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    top = F.aggregate(x, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    rows = vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x"), top.alias("top")).filter("top > 0")
    scaled = rows.select("vec_id", "label", F.transform("x", lambda v: v / F.col("top")).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return scaled.withColumn("norm", norm).select("vec_id", "label", F.transform("x", lambda v: v / F.col("norm")).alias("x"))


def _compare(rows: DataFrame, substrings: list[tuple[int, int]], least: float) -> DataFrame:
    """Of rows sorted by pair of blocks: (a, b, n): vector ``a`` has ``n`` links here, and is
    joined to ``b`` in the forest of these links (null where only counts matter)."""

    def group(numbers: np.ndarray, left: np.ndarray, reps: np.ndarray, codes: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> tuple[list, list, list]:
        own = left[0] == 2  # a block with itself
        p, q = (np.arange(len(reps)),) * 2 if own else (np.flatnonzero(left == 0), np.flatnonzero(left == 1))
        meet = first_meeting(codes[p], codes[q], substrings) == numbers[0]
        if own:
            meet &= np.arange(len(p))[:, None] < np.arange(len(q))[None, :]
        if not meet.any():
            return [], [], []
        near = meet & (x[p] @ x[q].T >= least)
        counts = np.zeros(len(reps), dtype=np.int64)
        np.add.at(counts, p, near @ sizes[q])
        np.add.at(counts, q, near.T @ sizes[p])
        a, n = list(reps[counts > 0]), list(counts[counts > 0])
        b: list[int | None] = [None] * len(a)
        # A forest instead of all links: breadth first over rows of the matrix.
        full = np.zeros((len(reps),) * 2, dtype=bool)
        full[np.ix_(p, q)] = near
        full |= full.T
        todo = counts > 0
        while todo.any():
            root = int(np.flatnonzero(todo)[0])
            todo[root] = False
            front = [root]
            while front:
                at = front.pop()
                new = np.flatnonzero(full[at] & todo)
                todo[new] = False
                front += new.tolist()
                a += reps[new].tolist()
                b += [int(reps[root])] * len(new)
                n += [0] * len(new)
        return a, b, n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            key = t.column("pair").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)]
            numbers, left, reps, sizes = (t.column(c).to_numpy() for c in ("number", "side", "rep", "size"))
            codes = t.column("code").to_numpy().view(np.uint64)
            lists = t.column("x").chunk(0) if t.column("x").num_chunks else pa.array([], pa.list_(pa.float64()))
            flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            out: tuple[list, list, list] = ([], [], [])
            for a, z in zip(edges, edges[1:]):
                if z - a > 1:
                    x = flat[at[a] : at[z]].reshape(z - a, -1)
                    for o, f in zip(out, group(*(c[a:z] for c in (numbers, left, reps, codes, sizes)), x)):
                        o.extend(f)
            if out[0]:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["a", "b", "n"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            key = held.column("pair").to_numpy()
            cut = int(np.flatnonzero(key == key[-1])[0]) if len(key) else 0
            if cut:
                yield from finish(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from finish(held)

    return rows.repartition("pair").sortWithinPartitions("pair", "side", "rep").mapInArrow(released(work), "a long, b long, n long")


def near_vectors(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``.

    Vectors link if their labels and dimensions are equal, their codes meet in a table and
    their cosine in double precision is at least ``least``. Vectors that are null, zero, or
    hold null or non-finite components, and those without a label, link with nothing; their
    component is their own id. Equal vectors of a label are one class, counted and not
    paired. Rows that repeat a vec_id with a vector are linked like different rows; a null
    vec_id never names a component; an empty table gives an empty result; other columns
    are ignored.

    Table entries with one class fall away before any vector is moved. Larger ones are cut
    into blocks of BLOCK classes, all pairs of which are compared in tasks of their own;
    only counts and a forest of each pair of blocks leave a task.
    """
    spark = vectors.sparkSession
    own = checkpointed(usable(vectors))
    classes = checkpointed(
        own.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
        .withColumn("rep", F.monotonically_increasing_id()).withColumn("d", F.size("x"))
    )
    own_class = own.join(classes.select("label", "x", "rep", "size"), ["label", "x"]).select("vec_id", "rep", "size")
    edges, counts = None, None
    # One quantiser for each dimension; the dimensions of a table are few.
    for d in [r["d"] for r in classes.select("d").distinct().collect()]:
        of_d = classes.filter(F.col("d") == d)
        sample = smallest_hashes(of_d, F.xxhash64("x"), sample_rows, "label").select("x").toPandas()
        quantiser = Quantiser.fit(np.stack(sample["x"].to_numpy()))
        e, c = _of_one_dimension(of_d, spark.sparkContext.broadcast(quantiser), quantiser.substrings(tables), least)
        edges, counts = (e, c) if edges is None else (edges.unionByName(e), counts.unionByName(c))
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if edges is None:
        return rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    member = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "rep")
    named = member.join(classes.select("rep", "least"), "rep")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("name")), "component").select("rep", "name")
    info = classes.select("rep", "least").join(counts.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(named, "rep", "left")
    info = info.select("rep", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("name", "least").alias("component_id"))
    linked = own_class.join(info, "rep").select("vec_id", (F.col("n") + F.col("size") - 1).alias("n_links"), "component_id")
    # The others, counted by id: a repeated id may stand on both sides.
    n_all, n_own = rest.groupBy("vec_id").agg(F.count("*").alias("n")), own.groupBy(F.col("vec_id").alias("_v")).agg(F.count("*").alias("m"))
    others = n_all.join(n_own, F.col("vec_id").eqNullSafe(F.col("_v")), "left").withColumn("k", F.col("n") - F.coalesce("m", F.lit(0))).filter("k > 0")
    alone = others.select("vec_id", F.explode(F.sequence(F.lit(1), F.col("k").cast("int")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _of_one_dimension(classes: DataFrame, shared, substrings: list[tuple[int, int]], least: float) -> tuple[DataFrame, DataFrame]:
    """(edges of forests, counts of links) among classes of one dimension."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            x = lists.flatten().to_numpy().reshape(len(lists), -1)
            codes = shared.value.codes(x) if len(x) else np.zeros(0, np.uint64)
            yield pa.record_batch([*(batch.column(c) for c in ("rep", "label", "size", "x")), pa.array(codes.view(np.int64))], names=["rep", "label", "size", "x", "code"])

    label = dict(classes.dtypes)["label"]
    coded = checkpointed(classes.select("rep", "label", "size", "x").mapInArrow(released(code), f"rep long, label {label}, size long, x array<double>, code long"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers = table_keys(batch.column("code").to_numpy().view(np.uint64), substrings)
            n, m = keys.shape if len(keys) else (0, 0)
            at = pa.array(np.repeat(np.arange(n), m))
            yield pa.record_batch(
                [batch.column("rep").take(at), batch.column("label").take(at), pa.array(np.tile(numbers, n)), pa.array(keys.reshape(-1).view(np.int64))],
                names=["rep", "label", "number", "entry"],
            )

    keyed = coded.select("rep", "label", "code").mapInArrow(released(entries), f"rep long, label {label}, number long, entry long")
    shared_entries = keyed.groupBy("label", "number", "entry").agg(F.count("*").alias("m")).filter("m > 1")
    met = checkpointed(keyed.join(shared_entries, ["label", "number", "entry"]))
    blocks = F.ceil(F.col("m") / BLOCK)
    placed = met.select("rep", "label", "number", "entry", blocks.alias("k"), F.pmod(F.xxhash64("rep"), blocks).alias("i"))
    pairs = placed.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("j")
    ).select(
        "rep", "number", F.xxhash64("label", "number", "entry", F.least("i", "j"), F.greatest("i", "j")).alias("pair"),
        F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("side"),
    )
    rows = pairs.join(coded.select("rep", "size", "code", "x"), "rep")
    found = checkpointed(_compare(rows, substrings, least))
    return found.filter("b is not null").select("a", "b"), found.filter("b is null").select(F.col("a").alias("rep"), "n")

"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import broadcast_if_small, checkpointed, released, texts, unused
from sightline.llm.graph import connected_components

BITS = 64


def fingerprint_of(text: str, width: int = 3, seed: int = 42) -> int:
    """The fingerprint, unsigned.

    A-Z are lower-cased and words lie between the ASCII white space characters. Every
    ``width`` words in a row, joined by a space, hash to XXH64 (UTF-8, ``seed``), repeats
    counted; fewer words are hashed as one shingle and no words give 0. A bit of the
    fingerprint is 1 if it is set in more than half of the hashes.
    """
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), seed)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    n = len(words) - width + 1
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), dtype="<u8", count=n)
    return majority(hashes)


def majority(hashes) -> int:
    """The bits that are set in more than half of the hashes (an array of 64-bit numbers), unsigned; none of no hashes."""
    import numpy as np

    n, ones = len(hashes), np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 4096):
        part = hashes[k : k + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, h, fp): the hash and the fingerprint of every whole text. A null text is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_of(t, width, seed) for t in batch.column("text").to_pylist()]
            signed = [x - (1 << BITS) if x >> (BITS - 1) else x for x in found]
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(signed, pa.int64())], names=["doc_id", "h", "fp"])

    return texts(docs).withColumn("h", F.xxhash64("text")).mapInArrow(released(work), "doc_id long, h long, fp long")


def _blocks(n_blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block; widths differ by one bit at most."""
    cuts = [round(BITS * k / n_blocks) for k in range(n_blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _keys(fp: Column, distance: int, n_blocks: int) -> Column:
    """One key for each choice of the blocks that must be equal: two fingerprints at most
    ``distance`` apart differ in at most so many blocks, and so share a key."""
    blocks, signed = _blocks(n_blocks), lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return F.array(*(
        F.struct(F.lit(i).cast("tinyint").alias("t"), fp.bitwiseAND(F.lit(signed(sum(((1 << w) - 1) << s for s, w in chosen)))).alias("masked"))
        for i, chosen in enumerate(combinations(blocks, n_blocks - distance))
    ))


def near_links(fps: DataFrame, distance: int = 2, n_blocks: int = 5, pair_limit: int = 16) -> DataFrame:
    """(src, dst): links whose components equal those of all pairs at most ``distance`` apart.

    ``fps`` holds distinct ``fp``. Each fingerprint goes to one bucket for every choice of
    ``n_blocks - distance`` blocks. Buckets of up to ``pair_limit`` are joined with
    themselves and each pair is verified by its Hamming distance. The members of larger
    buckets are linked exactly without pairs: for distance 2, two fingerprints are near if
    and only if flipping at most one bit of each can give the same number, so that each
    emits its 65 variants and all that meet in one are linked to the smallest of them
    (for another distance, variants with up to ``distance // 2`` flips, plus one bucketed
    wildcard bit where it is odd).
    """
    keyed = fps.select("fp", F.inline(_keys(F.col("fp"), distance, n_blocks)))
    # Buckets are counted, combined before the shuffle; those of one fingerprint fall away.
    sized = checkpointed(keyed.groupBy("t", "masked").agg(F.count("*").alias("n")).filter("n > 1"))
    small = keyed.join(sized.filter(F.col("n") <= pair_limit), ["t", "masked"]).select("t", "masked", "fp")
    other = small.withColumnRenamed("fp", "other")
    pairs = (
        small.join(other, ["t", "masked"]).filter("fp < other")
        .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
        .select(F.col("fp").alias("src"), F.col("other").alias("dst"))
    )
    large = keyed.join(sized.filter(F.col("n") > pair_limit), ["t", "masked"]).select("fp").distinct()
    met = large.select("fp", F.explode(_variants(F.col("fp"), distance)).alias("meet"))
    least = met.groupBy("meet").agg(F.min("fp").alias("dst"), F.count("*").alias("n")).filter("n > 1")
    stars = met.join(least, "meet").filter("fp <> dst").select(F.col("fp").alias("src"), "dst")
    return pairs.unionByName(stars).distinct()


def _variants(fp: Column, distance: int) -> Column:
    if distance == 0:
        return F.array(fp.cast("string"))
    if distance not in (1, 2):
        raise ValueError("distances over 2 are not supported")
    signed = [(1 << b) - (1 << BITS) if b == BITS - 1 else 1 << b for b in range(BITS)]
    if distance == 1:  # equal but for one wildcard bit
        return F.array(*(F.concat(F.lit(f"{b}:"), fp.bitwiseAND(F.lit(~m)).cast("string")) for b, m in enumerate(signed)))
    return F.array(fp, *(fp.bitwiseXOR(F.lit(m)) for m in signed))


def _components(docs: DataFrame, distance: int, width: int, seed: int, n_blocks: int) -> DataFrame:
    """doc_id, h (hash of the text), fp, component_id of every row."""
    own = checkpointed(fingerprints(docs, width, seed))
    # Equal fingerprints are one class, counted before the shuffle: only distinct ones are linked.
    classes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    member = connected_components(near_links(classes.select("fp"), distance, n_blocks)).withColumnRenamed("node", "fp")
    linked = member.join(classes, "fp")
    named = linked.join(linked.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    of_class = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # The classes grow with the documents: a plain join, split by Spark where one fingerprint is hot.
    return own.join(of_class, "fp")


def components(docs: DataFrame, distance: int = 2, width: int = 3, seed: int = 42, n_blocks: int = 5) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Null and empty texts have fingerprint zero, linked like any other. A row with a null
    doc_id keeps its component, but never names one unless it has no other member. Rows
    that repeat a doc_id each stay, in one component if their fingerprints are near. An
    empty table gives an empty result; other columns are ignored. ``component_id`` is the
    smallest doc_id reachable.
    """
    found = _components(docs, distance, width, seed, n_blocks)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, distance: int = 2, width: int = 3, seed: int = 42, n_blocks: int = 5) -> DataFrame:
    """One row of each component, all columns kept: the smallest doc_id's, of several of
    these that with the smallest hash of its text. Components without any doc_id keep one
    row for each fingerprint."""
    return least_rows(docs, _components(docs, distance, width, seed, n_blocks))


def least_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, by ``found``: doc_id, h, fp, component_id of every row."""
    i, h, nth, many = unused(docs, "id", "h", "nth", "many")
    found = checkpointed(found.select("doc_id", "h", "component_id", "fp"))
    nameless = F.when(F.col("component_id").isNull(), F.col("fp"))
    stay = found.groupBy("component_id", nameless.alias("f")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("x")).select("x.doc_id", "x.h", F.lit(True).alias("stays"))
    rows = found.groupBy("doc_id", "h").agg(F.count("*").alias("n")).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.h") == F.col("s.h"))
    # Most rows are alone in their component and unique: only the others are named.
    named = rows.join(stay.alias("s"), same, "left").filter("stays is null or n > 1").select(F.col("r.doc_id").alias(i), F.col("r.h").alias(h), F.col("stays").isNotNull().alias(many))
    named = checkpointed(named)
    repeated = not named.filter(F.col(many)).isEmpty()
    named = broadcast_if_small(named)
    hashed = docs.withColumn(nth, F.xxhash64(F.coalesce("text", F.lit(""))))
    marked = hashed.join(named, F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(nth) == F.col(h)), "left")
    alone = marked.filter(F.col(many).isNull()).select(*docs.columns)
    if not repeated:
        return alone
    # Rows equal in both are repeats of one document: that with the smallest hash of all its columns stays.
    whole = F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind))
    order = F.row_number().over(Window.partitionBy(i, h).orderBy(whole))
    repeats = marked.filter(F.col(many)).withColumn(nth, order).filter(F.col(nth) == 1).select(*docs.columns)
    return alone.unionByName(repeats)

"""Collocations: word sequences that are far more frequent than chance, by language.

All 1- to 4-word sequences of the texts become DataFrame rows with a count, hash-aggregated by
language; the parts of a phrase are joined, the score is taken in Decimal, phrases that mostly
occur inside one that is a word longer go by an anti-join, and a window ranks what is left.

Most sequences are seen once, and a row for each of them would be about ten times the text. A
sequence can only be as frequent as its first and its last words without one, so lengths are
counted one after the other, by hashes, and only for sequences both of whose parts are
frequent enough. What is known to be frequent is a table of 2^26 bits by hash, of one size whatever
the input: a bit that two sequences share lets a rare one pass, never keeps a frequent one out.
Sequences that pass are then counted as texts, and those counts alone are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import checkpointed, free_shuffles, released, stored
from sightline.llm.grams import Words, mixed, numbered, sections, summed

#: What separates words inside a piece, and what ends a piece.
SPACES, BREAKS = b" \t", b".,;:!?\x0a\x0b\x0c\x0d"
BITS = 26
#: Bits of a hash that are shuffled to count sequences; two that share them only let a rare one pass.
KEPT_BITS = 40
#: Positions in one row of Spark's bitmaps.
BITMAP = 32_768
#: Rows of one language are ranked in so many groups before they are ranked together.
GROUPS = 64
#: Phrases that are made at once.
SLICE = 65_536


class Sequences:
    """Sequences of growing length in a section of texts. ``start`` are the places where one of the
    present length begins, ``ids`` says which it is, ``first`` is one place of each, ``count`` how
    often it occurs, ``hashes`` its hash with the language."""

    def __init__(self, texts: list[bytes], languages: list[bytes]) -> None:
        import xxhash

        self.words, self.length = Words(texts, SPACES, BREAKS), 1
        codes = {x: i for i, x in enumerate(dict.fromkeys(languages))}
        self.languages = [*codes]
        self.language = np.array([codes[x] for x in languages], dtype=np.int64)[self.words.doc] if len(self.words.ids) else np.zeros(0, np.int64)
        by_code = np.array([xxhash.xxh64_intdigest(x) for x in codes], dtype=np.uint64)
        n = max(1, len(self.words.names))
        self._number(np.arange(len(self.words.ids)), self.language * n + self.words.ids)
        self.hashes = mixed(by_code[self.language[self.first]], self.words.hashes[self.words.ids[self.first]]) if len(self.first) else np.zeros(0, np.uint64)
        self.single, self.single_hashes, self.singles = self.ids, self.hashes, max(1, len(self.first))

    def _number(self, start: np.ndarray, key: np.ndarray) -> None:
        self.start = start
        _, self.ids, at, self.count = numbered(key)
        self.first = start[at]

    def keep(self, bits: np.ndarray) -> None:
        """Only those whose bit is set."""
        good = has_bit(bits, self.hashes)
        if good.all():
            return
        renamed = np.cumsum(good) - 1
        at = good[self.ids]
        self.start, self.ids = self.start[at], renamed[self.ids[at]]
        self.first, self.count, self.hashes = self.first[good], self.count[good], self.hashes[good]

    def grow(self) -> None:
        """Sequences of one more word, where both parts of the present length are there."""
        total = len(self.words.ids)
        which = np.full(total + 1, -1)
        which[self.start] = self.ids
        start = self.start[which[self.start + 1] >= 0]
        if self.length == 1:
            start = start[self.words.joined[start]]
        last = self.single[start + self.length] if len(start) else np.zeros(0, np.int64)
        hashes, before = self.hashes, which
        self._number(start, which[start] * self.singles + last)
        self.hashes = mixed(hashes[before[self.first]], self.single_hashes[self.single[self.first + self.length]]) if len(self.first) else np.zeros(0, np.uint64)
        self.length += 1


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _frequent_bits(docs: DataFrame, known: list, least: int) -> np.ndarray:
    """The bits of all sequences of ``len(known) + 1`` words that are frequent, and by chance some others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for rows in sections(batches):
                found = Sequences(rows["text"], rows["lang"])
                for bits in known:
                    found.keep(bits.value)
                    found.grow()
                yield found.hashes >> np.uint64(64 - KEPT_BITS), found.count

        for keys, n in summed(pairs()):
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "m"])

    counts = docs.mapInArrow(released(work), "h long, m long").groupBy("h").agg(F.sum("m").alias("m")).filter(F.col("m") >= least)
    slot = F.shiftrightunsigned("h", KEPT_BITS - BITS)
    rows = counts.groupBy(F.floor(slot / BITMAP).cast("int").alias("row")).agg(F.bitmap_construct_agg(slot % BITMAP).alias("bits"))
    out = np.zeros((1 << BITS) // 8, np.uint8)
    for r in rows.collect():  # 2,048 rows of 4 KB at most
        out[r["row"] * BITMAP // 8 :][: BITMAP // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def counted(docs: DataFrame, max_words: int = 4, least: int = 30) -> DataFrame:
    """lang, words, phrase, f: how often each sequence of up to ``max_words`` words occurs, of those that do so
    ``least`` times; with no words and an empty phrase: how many words the language has."""
    spark, own = docs.sparkSession, _texts(docs)
    free_shuffles(spark)  # one length's shuffle needn't lie beside the next one's
    bits: list = []
    for _ in range(max_words - 1):
        bits.append(spark.sparkContext.broadcast(_frequent_bits(own, bits, least)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.binary()), ("words", pa.int32()), ("phrase", pa.binary()), ("m", pa.int64())])
        for rows in sections(batches):
            found = Sequences(rows["text"], rows["lang"])
            names, ids, languages = found.words.names, found.words.ids, pa.array(found.languages, pa.binary())
            totals = np.bincount(found.language, minlength=len(languages))
            yield pa.record_batch([languages, pa.array([0] * len(languages), pa.int32()), pa.array([b""] * len(languages), pa.binary()), pa.array(totals)], schema=schema)
            for n in range(1, max_words + 1):
                if n > 1:
                    found.grow()
                if n < max_words:  # most of the longest ones whose parts are frequent are so, too
                    found.keep(bits[n - 1].value)
                # A slice at a time, as arrays: lists of words and phrases would take most of a task's memory.
                for lo in range(0, len(found.first), SLICE):
                    first = found.first[lo : lo + SLICE]
                    phrases = pc.binary_join_element_wise(*(names.take(pa.array(ids[first + i])) for i in range(n)), pa.scalar(b" ", names.type)).cast(pa.binary())
                    own = languages.take(pa.array(found.language[first]))
                    yield pa.record_batch([own, pa.array(np.full(len(first), n, np.int32)), phrases, pa.array(found.count[lo : lo + SLICE])], schema=schema)

    rows = own.mapInArrow(released(work), "lang binary, words int, phrase binary, m long")
    sums = rows.groupBy("lang", "words", "phrase").agg(F.sum("m").alias("f")).filter((F.col("words") == 0) | (F.col("f") >= least))
    return stored(sums.select(F.col("lang").cast("string").alias("lang"), "words", F.col("phrase").cast("string").alias("phrase"), "f"))


def _exact(name: str):
    return F.col(name).cast("decimal(20,0)")


def collocations(docs: DataFrame, max_words: int = 4, least: int = 30, within: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``top`` phrases of each language.

    ``docs`` holds text and lang; other columns are ignored. A null text is empty, a null lang is
    ``und``; a language without candidates has no rows, an empty table gives an empty result.
    Repeated rows count as often as they occur; equal scores are ordered by frequency and then by
    phrase (as UTF-8 bytes), so no two rows tie. A phrase goes that lies in a longer candidate
    with ``within`` percent of its occurrences; it then lies in one that is a word longer and at
    least as frequent, so those alone are looked at.
    """
    known = counted(docs, max_words, least)
    phrases = known.filter("words > 1").withColumnRenamed("f", "a")
    word = F.split("phrase", " ")
    part = lambda a, n: F.concat_ws(" ", F.slice(word, a, n))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    heads = known.filter("words > 0").select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = heads.select("lang", F.col("head").alias("tail"), F.col("l").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn(
        "score", F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    shorter = F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1)))
    longer = phrases.filter("words > 2").select("lang", shorter.alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    inside = (best["lang"] == longer["lang"]) & (best["phrase"] == longer["phrase"]) & (_exact("longer") * 100 >= _exact("a") * within)
    left = checkpointed(best.join(longer, inside, "left_anti").select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    few = left.withColumn("group", group).withColumn("place", F.row_number().over(Window.partitionBy("lang", "group").orderBy(*order))).filter(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    totals = known.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

"""Toxicity by a factorization machine over hashed terms.

Besides a weight, each hashed word has a short vector, and every pair of words in a text
adds the product of their vectors, so that words which are harmless alone can count
together. The pairs cost no more than the words: half of (the square of the sum minus the
sum of the squares).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.arrays import Lists
from sightline.llm.common import broadcast_if_small, checkpointed, filesystem, give_back, new_folder, released, smallest_hashes, texts, unused

#: Labelled rows that the machine is fitted on at most, those with the smallest hash of their id.
SAMPLE_ROWS = 16_000
SLOTS = 1 << 18
FACTORS = 6
PREFIXES = (4, 5)
#: How many different words of a text begin alike is a term, too, from these numbers on.
ALIKE = (2, 3)
#: Terms in so many rows of the sample at least stay if their chi-square against the labels is so high, or that of a pair that they are in.
LEAST_ROWS, LEAST_CHI = 5, 12.0
#: Terms whose pairs with all others are counted in one row of Spark's work.
PAIR_ROWS = 32
#: Rows without label 1 that pairs are counted over at first, by 64.
CLEAN_WORDS = 24
#: Letters of text that are scored at once, about.
LETTERS_AT_ONCE = 4_000_000
TOXIC_FROM = 0.7

_TRIM = re.compile(r"^\W+|\W+$")


def _slot(term: str) -> int:
    return crc32(term.encode("utf-8", "surrogatepass")) % SLOTS


def _alike(slots: np.ndarray, n: int) -> np.ndarray:
    """The slots of ``n`` or more words with one beginning, from that of the beginning."""
    return (slots * 2654435761 + n * 40503) % SLOTS


def slots_of(texts: list[str], used: np.ndarray | None = None) -> Lists:
    """The distinct slots of each whole text, in ascending order; of those ``used`` alone (a
    boolean for each slot), if given.

    Terms are the words without case and outer punctuation, their first 4 and 5 letters (of
    longer words), and that 2 or 3 different words of the text begin so. Each distinct word is hashed once.
    """
    words = pc.utf8_split_whitespace(pa.array(texts, pa.string()))
    n, words = words.value_lengths().to_numpy(), words.flatten().dictionary_encode()
    names: dict[str, int] = {}
    of_word = np.array([names.setdefault(_TRIM.sub("", w.lower()), len(names)) for w in words.dictionary.to_pylist()], dtype=np.int64)
    whole = np.array([_slot(x) if x else -1 for x in names], dtype=np.int64)
    begins = [np.array([_slot(f"{x[:k]}~{k}") if len(x) > k else -1 for x in names], dtype=np.int64) for k in PREFIXES]
    if used is not None:
        # The last place is that of words that have no such term.
        used = np.append(used, False)
        whole = np.where(used[whole], whole, -1)
        begins = [np.where((used[x] | np.any([used[_alike(x, k)] for k in ALIKE], axis=0)) & (x >= 0), x, -1) for x in begins]
    row, name = np.repeat(np.arange(len(n)), n), of_word[words.indices.to_numpy()]
    wanted = ((whole >= 0) | np.any([x >= 0 for x in begins], axis=0))[name]
    key = np.unique(row[wanted] * max(1, len(names)) + name[wanted])
    row, name = key // max(1, len(names)), key % max(1, len(names))
    found = [(row * SLOTS + whole[name])[whole[name] >= 0]]
    for x in begins:
        key, times = np.unique((row * SLOTS + x[name])[x[name] >= 0], return_counts=True)
        found.append(key)
        found += [key[times >= k] // SLOTS * SLOTS + _alike(key[times >= k] % SLOTS, k) for k in ALIKE]
    key = np.unique(np.concatenate(found))
    if used is not None:
        key = key[used[key % SLOTS]]
    return Lists(key % SLOTS, np.bincount(key // SLOTS, minlength=len(n)))


def in_parts(texts: list[str], letters: int = LETTERS_AT_ONCE) -> Iterator[list[str]]:
    """The texts in parts of about so many letters."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= letters:
            yield some
            some, size = [], 0
    if some:
        yield some


class Machine:
    """Bias, and a weight and a vector for each slot."""

    def __init__(self, bias: float, weight: np.ndarray, factor: np.ndarray) -> None:
        self.bias, self.weight, self.factor = bias, weight, factor
        self.square = (factor**2).sum(axis=1)

    @classmethod
    def empty(cls) -> Machine:
        return cls(0.0, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32))

    def scores(self, terms: Lists) -> np.ndarray:
        """The chance of label 1 of each text, from its distinct slots."""
        row = np.repeat(np.arange(len(terms.n)), terms.n)
        add = lambda x: np.bincount(row, x[terms.flat], len(terms.n))
        sums = np.column_stack([add(self.factor[:, k]) for k in range(FACTORS)])
        margin = self.bias + add(self.weight) + 0.5 * ((sums**2).sum(axis=1) - add(self.square))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))

    def score(self, terms: np.ndarray) -> float:
        return float(self.scores(Lists(terms, np.array([len(terms)])))[0])

    def used(self) -> np.ndarray:
        """The slots that count at all, as a boolean for each."""
        return (self.weight != 0) | (self.square != 0)

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, used: np.ndarray, epochs: int = 6, rate: float = 0.3, decay: float = 3e-4, positive_cost: float = 8.0, seed: int = 1) -> Machine:
        """AdaGrad on the logistic loss over the ``used`` slots (sorted); an error on a toxic
        text costs ``positive_cost`` times as much. One label alone gives its constant."""
        if not len(y):
            return cls.empty()
        if y.min() == y.max():
            return cls(30.0 if y[0] > 0 else -30.0, *(getattr(cls.empty(), k) for k in ("weight", "factor")))
        rng = np.random.default_rng(seed)
        local = np.full(SLOTS, -1)
        local[used] = np.arange(len(used))
        rows = [local[r][local[r] >= 0] for r in rows]
        n = len(used)
        w, v = np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))
        gw, gv = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2)
        cost = np.where(y > 0, positive_cost, 1.0)
        bias, gb = 0.0, 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(order), 64):
                batch = order[a : a + 64]
                size = np.array([len(rows[i]) for i in batch])
                term = np.concatenate([rows[i] for i in batch]) if size.sum() else np.zeros(0, np.int64)
                of = np.repeat(np.arange(len(batch)), size)
                sums = np.zeros((len(batch), FACTORS))
                vt = v[term]
                for k in range(FACTORS):
                    sums[:, k] = np.bincount(of, vt[:, k], len(batch))
                margin = bias + np.bincount(of, w[term], len(batch)) + 0.5 * ((sums**2).sum(1) - np.bincount(of, (vt**2).sum(1), len(batch)))
                err = cost[batch] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[batch])
                unique, at = np.unique(term, return_inverse=True)
                step = np.bincount(at, err[of], len(unique)) + decay * len(batch) * w[unique]
                gw[unique] += step**2
                w[unique] -= rate * step / np.sqrt(gw[unique])
                for k in range(FACTORS):
                    step = np.bincount(at, err[of] * (sums[of, k] - vt[:, k]), len(unique)) + decay * len(batch) * v[unique, k]
                    gv[unique, k] += step**2
                    v[unique, k] -= 0.1 * rate * step / np.sqrt(gv[unique, k])
                step = err.sum()
                gb += step**2
                bias -= rate * step / np.sqrt(gb)
        out = cls.empty()
        out.weight[used], out.factor[used], out.bias = w, v, float(bias)
        return cls(out.bias, out.weight, out.factor)


def _terms(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for some in in_parts(batch.column("text").to_pylist()) for x in slots_of(some).lists()]
            yield pa.record_batch([batch.column("h"), batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], names=["h", "toxic", "terms"])

    return docs.select(F.xxhash64("doc_id", "text").alias("h"), "toxic", "text").mapInArrow(released(work), "h long, toxic int, terms array<int>")


def chi_square(n, n1, t, a):
    """Of ``n`` rows, ``n1`` with label 1, how far the ``t`` rows with a term, ``a`` of them with
    label 1, are from what chance gives. Of numbers, arrays or columns."""
    cross = a * (n - n1 - (t - a)) - (t - a) * (n1 - a)
    return n * cross * cross, t * (n - t) * float(n1) * float(n - n1)


def least_counts(n: int, n1: int, bar: float) -> tuple[float, float]:
    """(rows with label 1 that a pair is in at least, if it tells of label 1; rows at all that it
    is in at least, if it tells of label 0) for its chi-square to reach ``bar``. For a given
    number of rows with label 1 it is highest without others, for a given number of rows with
    fewest of them; so no pair that reaches it is missed."""
    count = np.arange(1, n + 1, dtype=float)
    out = []
    for some in (count, np.zeros(n)):
        up, down = chi_square(float(n), float(n1), count, some)
        enough = np.flatnonzero((up >= bar * np.maximum(1.0, down)) & (count <= (n1 if some[0] else n)))
        out.append(float(count[enough[0]]) if len(enough) else np.inf)
    return out[0], out[1]


def best_terms(rows: DataFrame) -> tuple[np.ndarray, list[np.ndarray], float]:
    """(slots that tell the labels apart alone; two sets of slots, in one of which both terms of any pair that
    tells them apart are; the chi-square that such a pair has at least).

    Counted in Spark, over all rows of the sample; the driver gets ``SLOTS`` numbers at most.
    """
    n, n1 = (int(x or 0) for x in rows.agg(F.count("*"), F.sum("toxic")).first())
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("t"))
    up, down = chi_square(n, n1, F.col("t"), F.col("a"))
    counts = checkpointed(counts.filter(F.col("t") >= LEAST_ROWS).withColumn("chi", up / F.greatest(F.lit(1.0), down)))
    terms = counts.count()
    # The bar rises with the number of pairs that are tried.
    bar = LEAST_CHI + 2 * float(np.log(max(1, terms * (terms - 1) / 2)))
    toxic, clean = least_counts(n, n1, bar) if 0 < n1 < n else (np.inf, np.inf)
    some = (F.col("chi") >= LEAST_CHI, F.col("a") >= max(LEAST_ROWS, toxic), F.col("t") >= max(LEAST_ROWS, clean))
    alone, *tried = (np.sort(np.array([r["term"] for r in counts.filter(x).select("term").collect()], dtype=np.int64)) for x in some)
    return alone, tried, bar


def _some_rows(rows: Lists, size: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, term) of all terms, of so many rows at once."""
    for lo in range(0, len(rows.n), size):
        n = rows.n[lo : lo + size]
        first = int(rows.start[lo])
        yield lo + np.repeat(np.arange(len(n)), n), rows.flat[first : first + int(n.sum())]


def _bits(rows: Lists, y: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By 64 rows and term, which of the rows hold the term, as one number; of the rows with label 1, and of the others."""
    toxic = y > 0
    place = np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) - 1
    out = tuple(np.zeros((-(-int(x.sum()) // 64), len(terms)), np.uint64) for x in (~toxic, toxic))
    number = np.full(SLOTS, -1, np.int32)
    number[terms] = np.arange(len(terms), dtype=np.int32)
    for row, term in _some_rows(rows):
        at = number[term]
        row, at = row[at >= 0], at[at >= 0]
        for k in (0, 1):
            own = toxic[row] == bool(k)
            where = place[row[own]]
            np.bitwise_or.at(out[k], (where // 64, at[own]), np.uint64(1) << (where % 64).astype(np.uint64))
    return out[1], out[0]


def paired_terms(spark: SparkSession, rows: Lists, y: np.ndarray, tried: np.ndarray, bar: float, of_toxic: bool) -> np.ndarray:
    """The slots of ``tried`` that tell of label 1 (or of label 0) in a pair, and better than both alone do.

    All pairs are counted, each row of Spark's work those of PAIR_ROWS terms; what each task
    needs is a bit for each term and row of the sample. Pairs that tell of label 1 are first counted over the
    rows with it and some of the others: more of the others only lower their chi-square, so most need no more.
    """
    if len(tried) < 2 or not 0 < y.sum() < len(y):
        return tried[:0]
    n, n1 = float(len(y)), float(y.sum())
    # Through the shared folder, since a broadcast would stay in the driver's memory.
    path = new_folder(spark, "toxicity") + ".bits"
    fs, at = filesystem(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as out:
        for x in _bits(rows, y, tried):
            out.write(x.tobytes())
    width = len(tried)
    words = -(-int(n1) // 64)

    def counts(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
        out = np.zeros((hi - lo, x.shape[1] - lo), np.int32)
        for word in x:
            out += np.bitwise_count(word[lo:hi, None] & word[None, lo:])
        return out.astype(float)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(path)
        with fs.open_input_stream(at) as source:
            both = np.frombuffer(source.read(), dtype=np.uint64).reshape(-1, width)
        toxic, clean = both[:words], both[words:]
        alone = [np.bitwise_count(x).sum(axis=0, dtype=float) for x in (toxic, clean)]
        up, down = chi_square(n, n1, alone[0] + alone[1], alone[0])
        chi_alone = up / np.maximum(1.0, down)
        few = clean[:CLEAN_WORDS] if of_toxic else clean
        for batch in batches:
            good = np.zeros(toxic.shape[1], bool)
            for block in batch.column("block").to_pylist():
                lo, hi = block * PAIR_ROWS, min((block + 1) * PAIR_ROWS, toxic.shape[1])
                a = counts(toxic, lo, hi)
                t = a + counts(few, lo, hi)
                up, down = chi_square(n, n1, t, a)
                may = (up >= bar * np.maximum(1.0, down)) & ((a * n > t * n1) == of_toxic)
                may &= np.arange(lo, toxic.shape[1])[None, :] > np.arange(lo, hi)[:, None]
                first, second = np.nonzero(may)
                for k in range(0, len(first), 1 << 14):
                    i, j = lo + first[k : k + (1 << 14)], lo + second[k : k + (1 << 14)]
                    own = a[i - lo, j - lo]
                    all_rows = own + np.bitwise_count(clean[:, i] & clean[:, j]).sum(axis=0, dtype=float)
                    up, down = chi_square(n, n1, all_rows, own)
                    chi = up / np.maximum(1.0, down)
                    found = (all_rows >= LEAST_ROWS) & (chi >= bar) & (chi >= chi_alone[i] + chi_alone[j] + LEAST_CHI)
                    good[i[found]] = good[j[found]] = True
            yield pa.record_batch([pa.array(np.flatnonzero(good))], names=["at"])

    blocks = -(-len(tried) // PAIR_ROWS)
    found = spark.range(0, blocks, 1, min(blocks, 64)).select(F.col("id").alias("block")).mapInArrow(released(work), "at long").distinct().collect()
    return np.sort(tried[[r["at"] for r in found]]) if found else tried[:0]


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted on labelled rows that aren't held out, ``sample_rows`` at most."""
    known = labels.filter("toxic is not null").filter(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = smallest_hashes(known, F.xxhash64("doc_id"), sample_rows, "doc_id")
    rows = checkpointed(_terms(texts(docs).join(F.broadcast(own), "doc_id")))
    alone, tried, bar = best_terms(rows)
    wanted = np.zeros(SLOTS, bool)
    wanted[np.concatenate([alone, *tried])] = True
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [[x for x in some if shared.value[x]] for some in batch.column("terms").to_pylist()]
            yield pa.record_batch([batch.column("h"), batch.column("toxic"), pa.array(terms, pa.list_(pa.int32()))], names=["h", "toxic", "terms"])

    few = rows.mapInArrow(released(work), "h long, toxic int, terms array<int>")
    # As arrays from end to end: the sample is a few megabytes, as lists it would be hundreds.
    path = new_folder(spark, "toxicity")
    few.orderBy("h").limit(sample_rows).write.parquet(path)
    fs, at = filesystem(path)
    sample = pq.read_table(at, filesystem=fs).sort_by("h")
    y, held = sample.column("toxic").to_numpy().astype(float), sample.column("terms").combine_chunks()
    rows = Lists(held.flatten().to_numpy(), held.value_lengths().to_numpy())
    used = np.unique(np.concatenate([alone, *(paired_terms(spark, rows, y, some, bar, of_toxic) for some, of_toxic in zip(tried, (True, False)))]))
    wanted[:] = False
    wanted[used] = True
    terms: list[np.ndarray] = []
    for row, term in _some_rows(rows):
        row, term = row[wanted[term]], term[wanted[term]]
        terms += [np.sort(x) for x in np.split(term, np.searchsorted(row, np.arange(len(terms) + 1, min(len(terms) + 256, len(rows.n)))))]
    del sample, held, rows
    give_back()
    return Machine.fit(terms, y, used)


def scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, h (hash of the text), held_out, score, predicted of every row.

    The score sees the text alone. Null and empty texts get the score of no terms; rows
    without a label, with null or repeated ids are scored like any other (a null id is not
    held out); an empty table gives an empty result, and without labels every score is one
    half; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, labels, sample_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        used = machine.used()
        for batch in batches:
            found = [machine.scores(slots_of(some, used)) for some in in_parts(batch.column("text").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), pa.array(np.concatenate([*found, np.zeros(0)]))], names=["doc_id", "h", "score"])

    keyed = texts(docs).withColumn("h", F.xxhash64("text"))
    scored = keyed.mapInArrow(released(work), "doc_id long, h long, score double")
    return scored.select("doc_id", "h", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were, whatever
    their names. Rows with equal texts stay or go together, a null text counts as empty; an
    empty table gives an empty result."""
    (h,) = unused(docs, "h")
    gone = checkpointed(scores(docs, labels, sample_rows).filter("predicted = 1").select(F.col("h").alias(h)).distinct())
    return docs.join(broadcast_if_small(gone), F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(h), "left_anti")

"""Quality rules: counts over whole texts, and gradient-boosted trees over them.

The trees are fitted here on labelled rows, a bounded sample, and flattened into arrays of
nodes that score a batch with one gather per level. Chosen features are monotone: a text
with more symbols, repeats or repeated lines never scores better.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import broadcast_if_small, checkpointed, released, smallest_hashes, texts, unused

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct")
#: Rows that the trees are fitted on at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
#: A document goes if its estimated chance of good quality is below this.
KEEP_FROM = 0.3
#: Features of the trees with the direction in which the score may move (0: any).
FEATURES = (("log_words", 0), ("word_length", 0), ("symbols", -1), ("dup_lines", -1), ("repeats", -1), ("upper", -1), ("punct", -1))

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_PUNCT = re.compile(r"[!?]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def repeated_words(words: list[str], window: int = 3) -> int:
    """Words in windows that are found twice or more, the first ones included."""
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    counts, total, reach = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            total += i + window - max(i, reach)
            reach = i + window
    return total


def counts_of(text: str) -> tuple[int, ...]:
    """The COUNTS of a whole text; words are runs of anything but ASCII white space."""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)] if "\n" in text else []
    return (
        len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)),
        repeated_words(words), len(_UPPER.findall(text)), len(_PUNCT.findall(text)),
    )


def with_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of each row; a null text has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*map(counts_of, batch.column("text").to_pylist()))
            arrays = [pa.array(c, pa.int64()) for c in columns] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), *arrays], names=["doc_id", "h", *COUNTS])

    keyed = texts(docs).withColumn("h", F.xxhash64("text"))
    return keyed.mapInArrow(released(work), "doc_id long, h long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, FEATURES) from columns of COUNTS."""
    n = np.maximum(1.0, counts["n_words"])
    chars = np.maximum(1.0, counts["word_chars"])
    return np.column_stack([
        np.log1p(counts["n_words"]), counts["word_chars"] / n, counts["n_symbols"] / chars, counts["n_dup_lines"] / n,
        counts["n_repeat_words"] / n, counts["n_upper"] / chars, counts["n_punct"] / chars,
    ])


class Trees:
    """Boosted trees in flat arrays: feature (-1 at a leaf), threshold, left child (the right
    one follows it), value; the roots of the trees; the score before any tree."""

    def __init__(self, feature, threshold, left, value, roots, start: float, depth: int) -> None:
        self.feature, self.threshold, self.left, self.value, self.roots = feature, threshold, left, value, roots
        self.start, self.depth = start, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            right = x[row, np.maximum(f, 0)] > self.threshold[node]
            node = np.where(inner, self.left[node] + right, node)
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], n_trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, penalty: float = 2.0, least: float = 3.0) -> Trees:
        """Newton boosting of the logistic loss over histograms of quantile bins.

        A split on a monotone feature needs child values in its order, and both subtrees
        stay on their side of the middle between these values.
        """
        chance = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        start = float(np.log(chance / (1 - chance)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]) if len(x) else np.zeros(x.shape, int)
        feature, threshold, left, value, roots = [], [], [], [], []
        margin = np.full(len(y), start)

        def new(n: int) -> int:
            for column, empty in ((feature, -1), (threshold, 0.0), (left, 0), (value, 0.0)):
                column.extend([empty] * n)
            return len(feature) - n

        for _ in range(n_trees if len(y) else 0):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(1e-6, p * (1 - p))
            roots.append(new(1))
            todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
            while todo:
                at, rows, level, low, high = todo.pop()
                best = None
                if level < depth and len(rows) > 1:
                    total_g, total_h = g[rows].sum(), h[rows].sum()
                    for j, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                        gr, hr = total_g - gl, total_h - hl
                        vl = np.clip(-gl / (hl + penalty), low, high)
                        vr = np.clip(-gr / (hr + penalty), low, high)
                        gain = -(gl * vl + (hl + penalty) * vl**2 / 2 + gr * vr + (hr + penalty) * vr**2 / 2)
                        gain += total_g * np.clip(-total_g / (total_h + penalty), low, high) + (total_h + penalty) * np.clip(-total_g / (total_h + penalty), low, high) ** 2 / 2
                        gain[(hl < least) | (hr < least)] = -np.inf
                        if monotone[j]:
                            gain[monotone[j] * (vr - vl) < 0] = -np.inf
                        k = int(np.argmax(gain))
                        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                            best = (gain[k], j, k, vl[k], vr[k])
                if best is None:
                    v = float(np.clip(-g[rows].sum() / (h[rows].sum() + penalty), low, high))
                    value[at] = rate * v
                    margin[rows] += rate * v
                    continue
                _, j, k, vl, vr = best
                feature[at], threshold[at], left[at] = j, float(cuts[j][k]), new(2)
                goes = binned[rows, j] > k
                mid = (vl + vr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[j]]
                todo.append((left[at], rows[~goes], level + 1, *bounds[0]))
                todo.append((left[at] + 1, rows[goes], level + 1, *bounds[1]))
        return cls(*(np.array(c, dtype=t) for c, t in ((feature, np.int64), (threshold, float), (left, np.int64), (value, float), (roots, np.int64))), start, depth)


def fit_quality(counted: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on the labelled rows with the smallest hash of their id, ``sample_rows`` at most."""
    own = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    sample = smallest_hashes(counted.join(own, "doc_id"), F.xxhash64("doc_id"), sample_rows, "doc_id", "h")
    rows = sample.select("quality", *COUNTS).toPandas()
    x = features({c: rows[c].to_numpy(float) for c in COUNTS})
    return Trees.fit(x, rows["quality"].to_numpy(float), tuple(m for _, m in FEATURES))


def verdicts(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, h (hash of the text), the COUNTS, base_failed, score, kept of every row.

    Null texts have no words and so fail. Rows without a label, with null or repeated ids,
    and an empty table are scored like any other (with no labels at all every score is
    one half); other columns are ignored.
    """
    counted = checkpointed(with_counts(docs))
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(counted, labels, sample_rows))

    @F.pandas_udf("double")
    def score(*columns):
        import pandas as pd

        trees = shared.value
        return pd.Series(trees.score(features({c: s.to_numpy(float) for c, s in zip(COUNTS, columns)})))

    scored = counted.withColumn("base_failed", base_failed()).withColumn("score", score(*COUNTS))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_from))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules and the trees keep, all columns as they were,
    whatever their names. Rows that repeat a doc_id and text stay or go together, rows with
    a null doc_id by their text; an empty table gives an empty result."""
    i, h = unused(docs, "id", "h")
    gone = checkpointed(verdicts(docs, labels).filter("not kept").select(F.col("doc_id").alias(i), F.col("h").alias(h)).distinct())
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(broadcast_if_small(gone), F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (hashed == F.col(h)), "left_anti")

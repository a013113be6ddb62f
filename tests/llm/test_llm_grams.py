"""Phrases and the language model, against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import grams, language_model, phrases
from sightline.llm.queries import queries

DOCS = "doc_id long, text string, lang string, n long, h long, phrase string"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def brute_phrases(rows, max_words, least, within, top):
    f, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    out = []
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        score, k = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        inside = any(b * 100 >= within * a and other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in candidates.items())
        if not inside:
            out.append((lang, score, a, " ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    result = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        result += [(lang, i, p, a, l, r, totals[lang], score) for i, (_, score, a, p, l, r) in enumerate(own[:top], 1)]
    return sorted(result)


def odd_docs(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "é", "Ä", "a b", "x\x00", "o'er", "日本", "sat", "on"]
    seps = [" ", "  ", "\t", " ", " ", ", ", ".", "\n", "\r\n", ";", "\x0b"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.choice([0, 1, 5, 60, 400])))
        rows.append((i, rng.choice([text, text, text, None, "", " . "]), rng.choice(["en", "en", "de", None, "", "und"]), 1, 2, None))
    return rows + rows[:10]


@pytest.mark.parametrize(("seed", "top"), [(0, 2000), (1, 7)])
def test_phrases_odd(spark, seed, top):
    rows = odd_docs(seed)
    got = phrases.collocations(spark.createDataFrame(rows, DOCS).repartition(5), least=20, top=top).collect()
    assert sorted(map(tuple, got)) == brute_phrases([(r[1], r[2]) for r in rows], 4, 20, 80, top)


def test_phrases_do_not_depend_on_sections_or_bits(spark, monkeypatch):
    """Few bits let rare sequences through, many sections cut texts apart: the result is the same."""
    rows = odd_docs(2)
    monkeypatch.setattr(grams, "SECTION", 300)
    own = [(r[1] or "", r[2] or "") for r in rows]
    seen: Counter = Counter()
    batch = pa.record_batch([pa.array([x[0].encode() for x in own]), pa.array([x[1].encode() for x in own])], names=["text", "lang"])
    for some in grams.sections([batch]):
        found = phrases.Sequences(some["text"], some["lang"])
        for _ in range(3):
            found.keep(np.full((1 << phrases.BITS) // 8, 255, np.uint8))
            found.grow()
        for a, n in zip(found.first, found.count):
            seen[found.languages[found.language[a]], *(found.words.names[int(i)].as_py() for i in found.words.ids[a : a + 4])] += int(n)
    want: Counter = Counter()
    for text, lang in own:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            words = [w.encode() for w in re.findall(r"[^\x20\x09]+", piece)]
            want.update((lang.encode(), *words[i : i + 4]) for i in range(len(words) - 3))
    assert seen == want


def test_phrases_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, 0, 0, "")], DOCS)).collect() == []


def test_phrases_leave_no_shuffle_of_a_length_behind(spark):
    from pathlib import Path

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    assert phrases.counted(spark.createDataFrame(odd_docs(4), DOCS).repartition(3), least=20).count()
    assert not files() - before


def test_sums():
    parts = [(np.array([3, 1, 3]), np.array([1, 2, 4])), (np.array([2, 3]), np.array([5, 6])), (np.array([], np.int64), np.array([], np.int64))]
    got = Counter()
    for keys, n in grams.summed(iter(parts), held=3):
        assert all(a < b for a, b in pairwise(keys.tolist()))
        got.update(dict(zip(keys.tolist(), n.tolist())))
    assert got == {1: 2, 2: 5, 3: 11}


# --- Language model --------------------------------------------------------------------------------


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def brute_model(texts, order):
    """A function that gives log10 of each token's probability, from the definition."""
    start = "begin "
    counts = {n: Counter() for n in range(1, order + 1)}
    for t in texts:
        own = [start] * (order - 1) + tokens_of(t)
        for i in range(order - 1, len(own)):
            counts[order][tuple(own[i - order + 1 : i + 1])] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    words = {g[0] for g in counts[1]}
    off, kinds = {}, {}
    for n in range(1, order + 1):
        off[n] = [0, *language_model.discounts([sum(v == k for v in counts[n].values()) for k in (1, 2, 3, 4)])]
        kinds[n] = {}
        for g, v in counts[n].items():
            kinds[n].setdefault(g[:-1], []).append(v)

    def p(context, w):
        n = len(context) + 1
        below = 1 / (len(words) + 1) if n == 1 else p(context[1:], w)
        own = kinds[n].get(context)
        if own is None:
            return below
        v = counts[n][(*context, w)]
        return (v - off[n][min(v, 3)] + sum(off[n][min(x, 3)] for x in own) * below) / sum(own)

    def logs(text):
        own = [start] * (order - 1) + tokens_of(text)
        return [np.log10(p(tuple(own[i - order + 1 : i]), own[i])) for i in range(order - 1, len(own))]

    return logs, p, words


def check_scores(rows, got, order):
    learnt = [text for i, text in rows if i is None or crc32(str(i).encode()) % 7 != 2]
    count = Counter(w for t in learnt for w in tokens_of(t))
    total = sum(count.values())
    logs, _, _ = brute_model(learnt, order)
    want = sorted(
        ((-1 if i is None else i), i is not None and crc32(str(i).encode()) % 7 == 2, len(tokens_of(t)), sum(w in count for w in tokens_of(t)), total,
         sum(np.log10((count[w] + 1) / (total + len(count) + 1)) for w in tokens_of(t)), sum(logs(t)) if learnt else 0.0) for i, t in rows
    )
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], *tuple(r)[1:]) for r in got)
    assert [x[:5] for x in found] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in found], [x[5:] for x in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_odd(spark, order, monkeypatch):
    rows = [(r[0] if k % 9 else None, *r[1:]) for k, r in enumerate(odd_docs(3))]
    got = language_model.scores(spark.createDataFrame(rows, DOCS).repartition(3), order).collect()
    check_scores([(r[0], r[1]) for r in rows], got, order)


def test_model_query(spark, data):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries()["op13_language_model"](spark, data).collect()
    check_scores(docs, got, 2)
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    texts = ["a b a b c", "a b c d", "c c c a", "", "x y z a b"]
    for order in (2, 3):
        _, p, words = brute_model(texts, order)
        for context in [("a",), ("b",), ("q",), (None,)] if order == 2 else [("a", "b"), ("q", "a"), ("c", "c")]:
            assert sum(p(context, w) for w in [*words, "never"]) == pytest.approx(1)


def test_model_empty(spark):
    assert language_model.scores(spark.createDataFrame([], DOCS)).collect() == []
    held = next(i for i in range(100) if crc32(str(i).encode()) % 7 == 2)
    (row,) = language_model.scores(spark.createDataFrame([(held, "a b", None, 0, 0, "")], DOCS)).collect()
    assert tuple(row) == (held, True, 3, 0, 0, 0.0, 0.0)


def test_hot_contexts_are_split(spark):
    """A word before most others: its pairs lie in several partitions, and are found again."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"the w{rng.randrange(500)}" for _ in range(200)), "en", 0, 0, "") for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).select("doc_id", F.col("text").cast("binary").alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        model = language_model.fit(docs)
        got = language_model.scores(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(model.seen[2].hot) < 70 and max(model.seen[2].sizes) < model.seen[2].size / 4
    check_scores([(r[0], r[1]) for r in rows], got, 2)


def test_keys_are_numbered_as_numpy_does():
    """Keys that fit into one number with their place, whose halves fit, and that don't; -1 is a key."""
    rng = np.random.default_rng(5)
    for keys in (
        rng.integers(-1, 9, 500), rng.integers(0, 1 << 40, 500).astype(np.uint64), rng.integers(-1, 99, 500) << 32 | rng.integers(0, 99, 500), rng.integers(-(1 << 62), 1 << 62, 500),
        rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2), np.array([(1 << 63) - 1, -1, 0, -1]), np.zeros(0, np.int64),
    ):
        want, first, which, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        got = grams.numbered(keys)
        assert np.array_equal(got[0], want) and np.array_equal(got[1], which) and np.array_equal(got[3], count)
        assert np.array_equal(keys[got[2]], want)


def test_words_have_different_hashes_at_every_length():
    words = [b"a" * n for n in range(1, 200)] + [b"a" * n + b"\0" for n in range(200)] + [bytes([i, j]) for i in range(50) for j in range(50)]
    words = pa.array(sorted(set(words)), pa.large_binary())
    found = grams.word_hashes(words)
    assert len(np.unique(found)) == len(words)
    assert np.array_equal(grams.word_hashes(words.slice(7)), found[7:])

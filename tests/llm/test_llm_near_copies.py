"""Near copies against brute-force Jaccard similarity of five-word shingles."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from sightline.llm import near_copies


def brute_shingles(text: str | None) -> set:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_components(docs: dict) -> dict:
    ids, sets = sorted(docs), {d: brute_shingles(docs[d]) for d in docs}
    least = {d: d for d in ids}
    for j in ids:
        for i in ids:
            a, b = sets[i], sets[j]
            if i < j and least[i] != least[j] and 5 * len(a & b) >= 4 * len(a | b):
                lo, hi = sorted((least[i], least[j]))
                least |= {d: lo for d in ids if least[d] == hi}
    return least


@pytest.fixture(scope="module")
def copies() -> dict:
    """Ordinary texts, near copies with a few edited words, chains of them, a common passage, short texts."""
    rng = random.Random(8)
    passage = [f"common{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(8, 200))] + rng.choice([[], passage])
        texts.append(base)
        for _ in range(rng.randint(0, 6)):
            near = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(0, 1 + len(near) // 25)):
                near[rng.randrange(len(near))] = f"w{rng.randrange(3000)}"
            texts.append(near)
    hot = [f"h{i}" for i in range(150)]
    for _ in range(60):
        near = list(hot)
        for _ in range(rng.randint(0, 7)):
            near[rng.randrange(150)] = f"w{rng.randrange(3000)}"
        texts.append(near)
    docs = dict(enumerate(" ".join(t) for t in texts))
    return docs | {900: "", 901: None, 902: " \t", 903: "one two", 904: "One  TWO", 905: "one two three"}


@pytest.mark.parametrize(("limit", "block"), [(16, 256), (2, 8), (1000, 256), (1, 1)])
def test_components(spark, monkeypatch, copies, limit, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    df = spark.createDataFrame(list(copies.items()), "doc_id long, text string")
    rows = near_copies.components(df, pair_limit=limit).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(copies) and len(rows) == len(copies)


def test_stage_drops_edited_copies(spark, copies):
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in copies.items()], "doc_id long, text string, lang string, source string, n_chars long")
    rows = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(set(brute_components(copies).values()))


def test_fingerprints_link_copies_with_few_edits(spark):
    """Sets within two bits of SimHash are linked by it, equal and distant ones too only after the check of their texts."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(2000)]
    rows = [(k, " ".join([*base[:k], "edit", *base[k + 1 :]])) for k in range(0, 2000, 100)] + [(5001, " ".join(f"v{i}" for i in range(300)))]
    classes = [(i, near_copies._name(s), near_copies._fingerprint(s)) for i, s in ((i, near_copies.shingles_of(t)) for i, t in rows)]
    near = {frozenset((a, b)) for _, a, x in classes for _, b, y in classes if a != b and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2}
    edges = near_copies._fingerprint_edges(spark.createDataFrame(classes, "id long, fp long, sim long")).collect()
    assert near and edges and {x for e in edges for x in e} == {x for pair in near for x in pair}
    found = near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict.fromkeys(range(0, 2000, 100), 0) | {5001: 5001}


def test_buckets_are_cut_where_sizes_leap(spark):
    """No near pair is parted, and a bucket of sizes far apart gives a part for each of them."""
    from fractions import Fraction

    rows = [(1, k, n) for k, n in enumerate((5, 100, 80, 78, 63, 62, 400, 500, 500, 626))] + [(2, 20, 7)]
    cut = {r["fp"]: r["token"] for r in near_copies._by_size(spark.createDataFrame(rows, "token long, fp long, n long"), Fraction("0.8")).collect()}
    parts = sorted(sorted(n for _, k, n in rows if cut[k] == part) for part in set(cut.values()))
    assert parts == [[5], [7], [62, 63, 78, 80, 100], [400, 500, 500], [626]]


def test_no_join_multiplies_large_buckets(spark, monkeypatch):
    """What large buckets hold is joined with its components once, for all the ways of comparing it."""
    plans, own = [], near_copies.checkpointed

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return own(df)

    monkeypatch.setattr(near_copies, "checkpointed", seen)
    rng = random.Random(3)
    common = [f"c{i}" for i in range(30)]
    rows = [(k, " ".join([f"w{rng.randrange(9000)}" for _ in range(60)] + common)) for k in range(30)]
    found = near_copies.components(spark.createDataFrame(rows, "doc_id long, text string"), pair_limit=2).collect()
    assert len({r["component_id"] for r in found}) == 30
    most = max(p.count("Join Inner, (fp") for p in plans)
    assert most <= 4, most


def test_shuffles_go_when_a_query_ends(spark):
    from pathlib import Path

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = files()
    rows = [(k, f"{k} one two three four five six {k % 3}") for k in range(40)]
    near_copies.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not files() - before


def test_copies_that_differ_in_more_than_a_prefix_do_not_meet(spark, monkeypatch):
    """Texts with the same origin, each with many words of its own: what is theirs alone is rarer than what they share
    and comes first, in small groups too, so that no bucket holds them."""
    seen, own = [], near_copies._links

    def links(met, *rest):
        seen.append(met.count())
        return own(met, *rest)

    monkeypatch.setattr(near_copies, "_links", links)
    rng, texts = random.Random(6), []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(200)]
        texts += [" ".join(f"d{family}.{k}.{i}" if rng.random() < 0.15 else w for i, w in enumerate(base)) for k in range(3)]
    texts += [texts[0] + " end", texts[5]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.components(df).collect()}
    assert found == brute_components(dict(enumerate(texts))) and found[36] == 0 and found[37] == 5
    assert len(seen) == 1 and seen[0] < 36, seen


def test_shingles_are_counted_over_all_documents(spark):
    """Ranks follow the number of documents that hold a shingle, over several tasks, over 255 in one of them."""
    held = {"common": 700, "frequent": 60, "rare": 3, "single": 1}
    rows = [(k, " ".join(f"{w}{i}" for w, n in held.items() if k < n for i in range(5))) for k in range(700)]
    ranks = near_copies.shingle_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 5, 42)
    of = [int(ranks[near_copies.shingles_of(" ".join(f"{w}{i}" for i in range(5)))[0] & (near_copies.SLOTS - 1)]) for w in held]
    assert of[0] > of[1] > of[2] > of[3] > 0 and of[1:] == [59, 20, 10] and (ranks > 0).sum() <= 16

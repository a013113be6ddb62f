"""The operators on documents against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest


from sightline.llm import bpe_codec, packing, quality, simhash, suffix_dedup, token_store, toxicity
from sightline.llm.arrays import Lists
from sightline.llm.queries import queries, tokenizer_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp long, k string, bucket long"
LONG = "tail words of a long text " * 3000
TEXTS = ["", None, "one", "Two words", "the same text here " * 30, "the same text here " * 30, "a\tb\x0bc\n\nd  e ", "é ß 日本 🙂 <|endoftext|> 'll don't", LONG, "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats, repeated and null ids, and columns whose names clash."""
    rows = [(i, t, None, "s", None, 1, 2, "z", 3) for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], None, None, None, 1, 2, "z", 3)] * 2 + [(None, "no id at all", None, None, None, 1, 2, "z", 3), (None, None, None, None, None, 1, 2, "z", 3), (4, "another text with id four", "en", "s", 5, 1, 2, "z", 3)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(8)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


# --- suffix arrays ---------------------------------------------------------------------------------


def brute_gone(texts: list[bytes], length: int) -> list[bytearray]:
    """Of each text a byte for each of its bytes, 1 if it goes."""
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append(gone)
    return out


def brute_repeats(texts: list[bytes], length: int) -> list[bytes]:
    return [bytes(x for x, g in zip(t, gone) if not g) for t, gone in zip(texts, brute_gone(texts, length))]


@pytest.mark.parametrize(("length", "alphabet", "limit"), [(20, "ab", 512), (12, "abc ", 2), (30, "a", 2), (1, "abz", 512), (64, "ab", 1)])
def test_repeats(spark, monkeypatch, length, alphabet, limit):
    rng = random.Random(length)
    ts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 150))) for _ in range(30)]
    ts += [ts[3][:40] + ts[5][10:90] + "é" * rng.randint(0, 9) for _ in range(15)] + [ts[7]] * 3 + ["ab" * 70, None]
    plain = suffix_dedup.repeated_spans
    monkeypatch.setattr(suffix_dedup, "repeated_spans", lambda keyed, n: plain(keyed, n, class_limit=limit))
    out = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string"), length).collect()}
    assert [out[i] for i in range(len(ts))] == brute_repeats([(t or "").encode() for t in ts], length)


def test_repeats_query(spark, data):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    gone = dict(zip(docs, brute_gone(list(docs.values()), 200)))
    kept = dict(zip(docs, brute_repeats(list(docs.values()), 200)))
    rows = queries()["op3_suffix_array_dedup"](spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t, k = docs[r["doc_id"]], kept[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(t), len(t) - len(k), sha(k))
        assert r["n_spans"] == len(bytes(gone[r["doc_id"]]).replace(b"\0", b" ").split())


def test_repeats_odd(odd, none):
    rows = suffix_dedup.remove_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["kept"] == b"" for r in rows if r["doc_id"] in (5, 9))
    assert suffix_dedup.remove_repeats(none).collect() == []
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert suffix_dedup.without_repeats(none).collect() == []


def test_repeats_over_chunks(spark, monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh") for _ in range(3000))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1024)
    suffix_dedup._tables.cache_clear()
    try:
        both = [list(zip(*suffix_dedup.anchors(np.frombuffer(t.encode(), np.uint8), 200))) for t in (text, "xyz" + text)]
    finally:
        suffix_dedup._tables.cache_clear()
    assert [sum(int(hi) - int(lo) + 1 for lo, hi, _, _ in one) for one in both] == [len(text) - 199, len(text) - 196]


# --- SimHash ---------------------------------------------------------------------------------------


def brute_fingerprint(text: str) -> int:
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().translate(None).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids: list, fps: list[int], distance: int) -> dict:
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least: dict = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, d in enumerate(ids)}


def test_simhash_query(spark, data):
    docs = sorted((r["doc_id"], brute_fingerprint(r["text"] or "")) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    want = classes([d for d, _ in docs], [f for _, f in docs], 2)
    rows = queries()["op10_simhash_near_dedup"](spark, data).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(d, f"{f:016x}", want[d]) for d, f in docs}


@pytest.mark.parametrize("limit", [2, 1000])
def test_near_links(spark, limit):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(300):
        f = rng.choice(fps)
        for _ in range(rng.randint(1, 3)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2, 5, limit)
    found = {r["node"]: r["component"] for r in simhash.connected_components(links).collect()}
    want = classes(signed, fps, 2)
    assert {f: found.get(f, f) for f in signed} == want


def test_simhash_odd(odd, none):
    rows = simhash.components(odd).collect()
    assert len(rows) == odd.count()
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {0}
    assert simhash.components(none).collect() == []
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) == 1 and ids.count(0) == 1 and 1 not in ids and 5 not in ids
    assert simhash.drop_near_duplicates(none).collect() == []


# --- tokens ----------------------------------------------------------------------------------------


def ids_of(text: str | None, name: str) -> list[int]:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_store(spark, odd, none):
    rows = token_store.read_tokens(token_store.write_tokens(odd, tokenizer_path(WORD)), with_ids=True).orderBy("start").collect()
    source = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (doc, text) in zip(rows, source, strict=True):
        want = [*ids_of(text, WORD), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (doc, start, len(want), crc(want), want)
        start += len(want)
    assert token_store.read_tokens(token_store.write_tokens(none, tokenizer_path(WORD))).collect() == []


def test_keyed_access(tmp_path):
    rng = np.random.default_rng(2)
    keys = sorted(set(rng.integers(-(2**60), 2**60, 5000).tolist()) | {0, 1, 2})
    documents = [(None, b"")] + [(k, np.arange(k % 7, dtype="<u2").tobytes()) for k in keys] + [(keys[-1], b"\1\0")]
    token_store.write_shard(str(tmp_path / "a"), documents, "<u2")
    with token_store.Shard(str(tmp_path / "a")) as shard:
        for k in keys[:-1:97]:
            assert [x.tolist() for x in shard.get(k)] == [list(range(k % 7))]
        assert len(shard.get(keys[-1])) == 2
        absent = np.array([x for x in rng.integers(-(2**60), 2**60, 1000) if x not in set(keys)])
        assert (shard.find(absent)[0] == -1).all()
        slots = shard.index.slot(np.array(keys))
        assert sorted(slots.tolist()) == list(range(len(keys)))


def check_pieces(rows: list, source: dict, capacity: int) -> None:
    sequences: dict = {}
    documents: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == capacity or at & (at - 1) == 0
    for (doc, n), parts in documents.items():
        copies = source[doc, n]
        covered = Counter(p for r in parts for p in range(r["start"], r["start"] + r["length"]))
        assert all(covered[p] == len(copies) for p in range(n)) and len(covered) == n
        for r in parts:
            assert r["ids_crc32"] in {crc(c[r["start"] : r["start"] + r["length"]]) for c in copies}


@pytest.mark.parametrize("capacity", [16, 4096])
def test_packing(odd, none, capacity):
    source: dict = {}
    for r in odd.collect():
        ids = [*ids_of(r["text"], WORD), 2]
        source.setdefault((r["doc_id"], len(ids)), []).append(ids)
    rows = packing.pack(odd, tokenizer_path(WORD), capacity).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in rows} == set(source)
    check_pieces(rows, source, capacity)
    assert packing.pack(none, tokenizer_path(WORD)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([3, 60, rng.randint(1, 63)]) for _ in range(rng.randint(0, 400))]
    histogram = Counter(lengths)
    plan = packing.Plan(histogram, 64)
    filled: dict = {}
    for n, c in histogram.items():
        for rank in range(c):
            at = 0
            for a, m, s, o in plan.place(n, rank):
                assert a == at
                at += m
                filled.setdefault(s, []).extend(range(o, o + m))
            assert at == n
    assert set(filled) == set(range(plan.sequences))
    for cells in filled.values():
        n = len(cells)
        assert sorted(cells) == list(range(n)) and (n == 64 or n & (n - 1) == 0)


@pytest.mark.parametrize("seed", range(6))
def test_least_slack(seed):
    """Each window against all multisets of what is left."""
    rng = random.Random(seed)
    left = Counter(rng.randint(1, 23) for _ in range(rng.randint(1, 9)))
    for window, again in packing.least_slack(dict(left), 24):
        items = list(left.elements())
        longest = max(items)
        items.remove(longest)
        reach = {0}
        for n in items:
            reach |= {r + n for r in reach if r + n <= 24 - longest}
        assert sum(n * c for n, c in window.items()) == longest + max(reach)
        left -= Counter({n: c * again for n, c in window.items()})
    assert not left


def test_lengths_that_fill_nothing_share_windows():
    """Most items stay whole: slack is filled from as few as it takes."""
    plan = packing.Plan({3000: 1000, 700: 50}, 4096)
    cut = sum(len(plan.place(n, i)) > 1 for n, c in ((3000, 1000), (700, 50)) for i in range(c))
    assert plan.windows == 3035000 // 4096 and cut <= 262


def test_bpe_odd(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(BYTE))
    want = Counter()
    for r in odd.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids)).encode()), sha(t.decode(ids, skip_special_tokens=False).encode())] += 1
    assert Counter(map(tuple, bpe_codec.round_trip(odd, tokenizer_path(BYTE), 50).collect())) == want
    assert bpe_codec.round_trip(none, tokenizer_path(BYTE)).collect() == []


def test_bpe_and_words_fuzz():
    from tokenizers import Tokenizer

    from sightline.llm.tokens import word_encoder

    rng = random.Random(3)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "É", "ß", "'s", "'LL", "!", "...", "123", "½", "日本", "🙂", "\x1c", "\xa0", " ", "\x85", "<|endoftext|>", "Ω", "é", "x" * 70, "​", "\r\n", "　", "٣", "²", "Σ", "İ", "µ", "ſ", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]
    byte, word = (Tokenizer.from_file(tokenizer_path(n)) for n in (BYTE, WORD))
    codec, encoder = bpe_codec.Codec(tokenizer_path(BYTE), None), word_encoder(tokenizer_path(WORD))
    for text, got in zip(texts, encoder.encode(texts)):
        ids = byte.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.digest(text) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(byte.decode(ids, skip_special_tokens=False).encode()))
        assert np.frombuffer(got, encoder.dtype).tolist() == word.encode(text, add_special_tokens=False).ids


def test_lexicon():
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 7))): [rng.randrange(1000) for _ in range(rng.randint(0, 4))] for _ in range(2000)}
    for lexicon in (bpe_codec.Lexicon.build(words), bpe_codec.Lexicon.mapped(bpe_codec.Lexicon.build(words).to_bytes())):
        assert all(lexicon.find(w) == ids for w, ids in words.items())
        assert all(lexicon.find(w) is None for w in (b"", b"e", b"abcdabcdabcd") if w not in words)
    shared = bpe_codec.Lexicon.build({b"sing": [1], b"ring": [2], b"king": [3]})
    assert len(shared.final) == 5  # one state for each of the common letters


# --- quality and toxicity --------------------------------------------------------------------------


def brute_counts(text: str) -> tuple:
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, again = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            again |= {i, i + 1, i + 2}
    lines, dup, had = text.split("\n"), 0, set()
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in had
            had.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_quality_query(spark, data):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries()["op6_quality_rules"](spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute_counts(docs[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(q == k for q, k in judged) > 0.9 * len(judged)  # a few dozen labels


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.3 * rng.random(2000) < 0.6) ^ (rng.random(2000) < 0.05)).astype(float)
    trees = quality.Trees.fit(x, y, (-1, 0, 1))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.85
    for j, sign in ((0, -1), (2, 1)):
        line = np.repeat(x[:50], 40, axis=0)
        line[:, j] = np.tile(np.linspace(-0.1, 1.1, 40), 50)
        assert (sign * np.diff(trees.score(line).reshape(50, 40), axis=1) >= -1e-12).all()


def test_quality_and_toxicity_odd(spark, odd, none, labels):
    empty = labels.limit(0)
    for use in (labels, empty):
        assert quality.verdicts(odd, use).count() == odd.count()
        assert quality.verdicts(none, use).collect() == []
        rows = toxicity.scores(odd, use).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
        assert toxicity.scores(none, use).collect() == []
        assert quality.keep_good(odd, use).columns == odd.columns == toxicity.drop_toxic(odd, use).columns
    assert all(r["doc_id"] is not None or not r["held_out"] for r in toxicity.scores(odd, labels).collect())


def test_machine_learns_pairs():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(3000)]
    y = np.array([float(3 in r and 7 in r) for r in rows])
    machine = toxicity.Machine.fit(rows, y, np.arange(40), epochs=20)
    test = [np.unique(rng.integers(0, 40, 12)) for _ in range(1000)]
    want = np.array([3 in r and 7 in r for r in test])
    got = np.array([machine.score(r) for r in test])
    assert got[want].mean() > got[~want].mean() + 0.5


def test_score_is_the_sum_over_terms_and_pairs():
    rng = np.random.default_rng(4)
    machine = toxicity.Machine(-0.3, rng.normal(0, 0.3, toxicity.SLOTS), rng.normal(0, 0.3, (toxicity.SLOTS, toxicity.FACTORS)))
    texts = ["", " \n", "One one, ONE!", "some other words here", "Grüße aus München (heute)", "x" * 3000, "a b a b a"]
    found = machine.scores(toxicity.slots_of(texts))
    for text, got in zip(texts, found):
        terms = set()
        for word in text.split():
            bare = word.lower().strip("".join(c for c in word if not (c.isalnum() or c == "_")))
            terms |= {bare, *(f"{bare[:n]}~{n}" for n in (4, 5) if len(bare) > n)} - {""}
        at = {zlib.crc32(w.encode()) % toxicity.SLOTS for w in terms}
        for n in (4, 5):
            begins = Counter(w[:n] for w in terms if "~" not in w and len(w) > n)
            at |= {(zlib.crc32(f"{b}~{n}".encode()) % toxicity.SLOTS * 2654435761 + k * 40503) % toxicity.SLOTS for b, c in begins.items() for k in (2, 3) if c >= k}
        at = sorted(at)
        margin = machine.bias + sum(machine.weight[i] for i in at) + sum(float(machine.factor[i] @ machine.factor[j]) for i in at for j in at if i < j)
        assert abs(got - 1 / (1 + np.exp(-margin))) < 1e-9
    used = np.zeros(toxicity.SLOTS, bool)
    assert toxicity.slots_of(texts, used).n.tolist() == [0] * len(texts)


def test_toxicity_of_a_balanced_pair(spark):
    """Toxic if exactly one of two words is there: neither tells anything alone."""
    rng = random.Random(6)
    docs, labels, want = [], [], {}
    for i in range(5000):
        words = [f"w{rng.randrange(400)}" for _ in range(25)] + [w for w in ("insult", "group") if rng.random() < 0.5]
        docs.append((i, " ".join(rng.sample(words, len(words)))))
        want[i] = ("insult" in words) != ("group" in words)
        labels.append((i, int(want[i])))
    rows = toxicity.scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum((r["score"] >= 0.5) == want[r["doc_id"]] for r in held) > 0.9 * len(held)


def test_toxicity_of_a_rare_pair(spark):
    """Toxic if two words are there that are neutral alone and rarer than thousands of others."""
    rng = random.Random(8)
    docs, labels, want = [], [], {}
    for i in range(4000):
        kind = i % 20
        words = [f"w{rng.randrange(2500)}" for _ in range(60)]
        words += {0: ["insultx", "groupx"], 1: ["insultx"] * 2, 2: ["groupx"], 3: ["insultx"], 4: ["groupx"]}.get(kind, [])
        docs.append((i, " ".join(rng.sample(words, len(words)))))
        want[i] = kind == 0
        labels.append((i, int(want[i])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [r for r in toxicity.scores(*frames).collect() if r["held_out"]]
    assert all((r["score"] >= 0.5) == want[r["doc_id"]] for r in held if docs[r["doc_id"]][1].split().count("insultx") != 1 or want[r["doc_id"]])
    assert sum((r["score"] >= 0.5) == want[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_paired_terms_are_those_of_all_pairs(spark, monkeypatch):
    """Pairs that are counted by bits, against every pair counted plainly; and no pair that reaches the bar lies outside both sets."""
    rng = np.random.default_rng(3)
    n = 400
    rows = [np.unique(rng.integers(0, 90, 12)) for _ in range(n)]
    y = np.array([float((3 in r and 7 in r) or (rng.random() < 0.2 and not (11 in r and 12 in r))) for r in rows])
    n1, bar = y.sum(), 12.0
    rows = [np.union1d(r, [11, 12]) if rng.random() < 0.5 else r for r in rows]
    toxic, clean = toxicity.least_counts(n, int(n1), bar)
    t1 = {i: sum(i in r for r in rows) for i in range(90)}
    a1 = {i: sum(i in r and v for r, v in zip(rows, y)) for i in range(90)}

    def chi(t, a):
        up, down = toxicity.chi_square(float(n), n1, float(t), float(a))
        return up / max(1.0, down)

    want: set[int] = set()
    for i in range(90):
        for j in range(i):
            t = sum(i in r and j in r for r in rows)
            a = sum(i in r and j in r and v for r, v in zip(rows, y))
            if t >= toxicity.LEAST_ROWS and chi(t, a) >= bar and chi(t, a) >= chi(t1[i], a1[i]) + chi(t1[j], a1[j]) + toxicity.LEAST_CHI:
                want |= {i, j}
                assert min(a1[i], a1[j]) >= toxic or min(t1[i], t1[j]) >= clean
    for some in (1, 24):  # rows of the other label that are counted at first
        monkeypatch.setattr(toxicity, "CLEAN_WORDS", some)
        found = [toxicity.paired_terms(spark, Lists.of([r.tolist() for r in rows]), y, np.arange(90), bar, x).tolist() for x in (True, False)]
        assert {3, 7} <= want == {*found[0], *found[1]}


def test_toxicity_held_out(spark, tmp_path):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(1500):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(40)] + ([rng.choice(["idiotic", "idiots", "scum"])] if bad else [])
        docs.append((i, " ".join(rng.sample(words, len(words)))))
        labels.append((i, int(bad)))
    rows = toxicity.scores(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) > 0.97 * len(held)


def test_words_of_both_counts(spark, odd):
    n = bpe_codec.word_counts(odd).agg(F.sum("n")).first()[0]
    assert n == sum((r["text"] or "").count(" ") for r in odd.collect())


def test_repeats_of_lengths_beyond_a_chunk_are_refused(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for length in (0, 81_920, suffix_dedup.CHUNK, suffix_dedup.CHUNK + 1):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(docs, length)
    long = "".join(chr(97 + i * i % 23 * i % 25) for i in range(81_919))
    twice = spark.createDataFrame([(1, long), (2, "y" + long + "z")], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(twice, 81_919).collect()} == {1: b"", 2: b"yz"}


def test_the_repeat_that_stays_does_not_depend_on_partitions(spark):
    rows = [(1, "one two three four five six", lang, i) for i, lang in enumerate("abcdefgh")]
    found = {simhash.drop_near_duplicates(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, lang string, n long").repartition(k + 1)).first()["lang"] for k in range(4)}
    assert len(found) == 1

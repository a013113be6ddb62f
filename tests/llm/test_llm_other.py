"""The operators on pages and vectors, components, and the pipeline."""

from __future__ import annotations

import hashlib
import html
import io
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import embed_dedup, graph, near_copies, quality, simhash, suffix_dedup, toxicity, warc, wrappers
from sightline.llm.common import smallest_hashes
from sightline.llm.queries import queries
from tests.llm.test_llm_near_copies import brute_components
from tests.llm.test_llm_text import brute_repeats, check_pieces, ids_of

PAGES = "page_id long, url string, html string, host string, rules string, digest string"


@pytest.fixture(scope="module")
def odd_pages(spark):
    same = "<html><body><article><p>" + "same text " * 30 + "</p></article></body></html>"
    rows = [(5, "http://a/1", same), (3, "http://a/2\r\nX: 1", same), (4, None, same), (3, "http://a/2", same), (None, "http://b", same), (None, None, None), (7, "nonsense", ""), (8, "u", None), (9, "u", "<p>tiny"), (10, "u", "<p>tiny"), (11, "http://c", "<b>" * 5000 + "deep" + "</p>" * 10), (12, "http://c", "é<" * 20000)]
    return spark.createDataFrame([(*r, "h", "r", "d") for r in rows], PAGES)


# --- WARC ------------------------------------------------------------------------------------------


def test_warc_query(spark, data):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    first: dict = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    for r in queries()["op1_warc"](spark, data).collect():
        p = pages.pop(r["page_id"])
        again = len(p) >= 100 and first[p] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(p), hashlib.sha256(p).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[p]) if again else ("response", None))
    assert not pages


def test_warc_odd(spark, odd_pages):
    rows = warc.read_archives(spark, warc.write_archives(odd_pages, archive_bytes=2000), with_payload=True).collect()
    assert len(rows) == odd_pages.count()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in rows if r["payload_bytes"] > 300 and r["page_id"] not in (11, 12))
    assert kinds == [("3", "response", None), ("3", "response", None), ("4", "revisit", 3), ("5", "revisit", 3), ("None", "revisit", 3)]
    assert all(r["record_type"] == "response" for r in rows if r["page_id"] in (9, 10))
    assert "\n" not in next(r["url"] for r in rows if r["page_id"] == 3 and "X" in r["url"])
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in rows if r["payload"] is not None)
    assert warc.write_archives(odd_pages.limit(0)) == []
    assert warc.read_archives(spark, []).collect() == []


def test_warc_frames_and_faults():
    class Kept(io.BytesIO):
        def close(self) -> None:
            pass

    records = [warc.make_record(i, f"http://x/{i}", b"payload of a page " * (i + 5), hashlib.sha256(b"payload of a page " * (i + 5)).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(300)]
    out = Kept()
    writer = warc.ArchiveWriter(out)
    for r in records:
        writer.write(r)
    writer.close()
    raw = out.getvalue()
    assert struct.unpack("<I", raw[:4])[0] == warc.DICTIONARY_MAGIC
    assert raw.count(warc.FRAME_MAGIC) >= 301  # one frame a record, and the dictionary's own
    assert [r["page_id"] for r in warc.read_archive(io.BytesIO(raw), block=100)] == list(range(300))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-20])))
    good = records[7]
    for bad in (good[:-1], good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good.replace(b"payload of", b"payload if", 1), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# --- main text -------------------------------------------------------------------------------------


def test_extraction_query(spark, data):
    def article(raw: str) -> str:
        body = re.search(r"<article>(.*)</article>", raw, re.S)[1]
        return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body))).split())

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in queries()["op2_html_extraction"](spark, data).collect():
        want = article(pages[r["page_id"]]["html"])
        assert (r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], want, len(want))


def test_furniture():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav>menu</nav>
    <main><div class="post"><h2>Title &eacute;</h2><p>Hello <b>wor</b>ld&nbsp;x<br>y <p>Second<ul><li>one<li>two</ul><div class="ad">AD</div><form>f</form><p hidden>no</p>
    <!-- <p>c</p> --><script>var t="</p><p>no</p>"</script><div class="share">Share</div></div><aside>side</aside><section id="comments"><p>great post</p></section></main><footer>f</footer></body>"""
    assert wrappers.extract(page, None) == "Title é Hello world x y Second one two"


def test_wrapper_without_landmarks():
    def page(i: int) -> str:
        return f'<body><div class="top">Brand</div><div class="c"><h1>T{i}</h1><p>{f"word{i} " * 40}</p><p>text {i} more</p>{"<h3>Read on</h3>" if i % 2 else ""}<em>all rights</em></div><div class="s"><a href=1>x{i}</a> <a href=2>link</a></div></body>'

    w = None
    for i in range(8):
        one = wrappers.wrapper_of(wrappers.parse(page(i)))
        w = one if w is None else wrappers.align(w, one)
    assert "(<p> # </p>)+" in wrappers.to_regex(w) and "(<h3> # </h3>)?" in wrappers.to_regex(w)
    text = wrappers.extract(page(3), wrappers.rules_of(w))
    assert text.startswith("T3 word3") and "text 3 more" in text and "Brand" not in text and "link" not in text


def test_fold_and_align():
    w = wrappers.wrapper_of(wrappers.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl><ul><li>x<li>y<li>z</ul>"))
    assert wrappers.to_regex(w) == "<#root> <dl> (<dt> # </dt>)+ (<dd> # </dd>)+ </dl> <ul> (<li> # </li>)+ </ul> </#root>"


def test_extraction_odd(odd_pages):
    rows = wrappers.extract_text(odd_pages).collect()
    assert len(rows) == odd_pages.count()
    by_id = {r["page_id"]: r for r in rows}
    assert by_id[7]["text"] == by_id[8]["text"] == "" and by_id[9]["text"] == "tiny" and by_id[11]["text"] == "deep"
    assert by_id[5]["text"] == " ".join(["same text"] * 30) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert wrappers.extract_text(odd_pages.limit(0)).collect() == []


# --- vectors ---------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x double, rep long"


def brute_links(rows: list[tuple], least: float) -> dict:
    ok = [(i, np.array(v, float), k) for i, v, k in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i, _, _ in rows}
    for a, (i, v, k) in enumerate(ok):
        for j, w, m in ok[:a]:
            if k == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                near[i].append(j)
                near[j].append(i)
    return near


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(12, 32))
        for c in centres:
            for _ in range(rng.integers(1, 14)):
                rows.append((len(rows), (c + rng.normal(size=32) * 0.1 * rng.random()).astype(np.float32).tolist(), label))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(20)] + [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("nan")] * 32, 0), (903, [None] * 32, 0), (904, rows[0][1], None), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (907, [float("inf")] * 32, 1), (908, [], 1)]
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    df = spark.createDataFrame([(*r, 0.0, 1) for r in rows], VECTORS)
    near = brute_links(rows, 0.98)
    out = {r["vec_id"]: r for r in embed_dedup.near_vectors(df).collect()}
    assert set(out) == set(near)
    assert all(out[i]["n_links"] <= len(near[i]) for i in near)
    assert sum(out[i]["n_links"] for i in near) >= 0.9 * sum(map(len, near.values()))
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in near)
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i for i in (900, 901, 902, 903, 904, 907, 908))
    assert out[906]["component_id"] == 905 and out[906]["n_links"] == 1
    assert embed_dedup.near_vectors(df.limit(0)).collect() == []
    twice = embed_dedup.near_vectors(df.unionByName(df.filter("vec_id in (0, 900)"))).collect()
    assert len(twice) == len(rows) + 2 and sum(r["vec_id"] == 900 for r in twice) == 2


def test_vectors_query(spark, data):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    near = brute_links(rows, 0.98)
    out = {r["vec_id"]: r["n_links"] for r in queries()["op8_embedding_near_dedup"](spark, data).collect()}
    assert set(out) == set(near) and sum(out.values()) >= 0.9 * sum(map(len, near.values()))
    assert all(out[i] <= len(near[i]) for i in near)


# --- components and the pipeline -------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(200, 300 + i) for i in range(40)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(70)] + [(999, 999), (5, 4)]
    root: dict = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out == {x: find(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_pipeline(spark, data, tmp_path):
    """Each stage on the output of the last one, against brute force."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        stage(spark, docs, data).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        rows = after.collect()
        if name != "packing":
            assert after.columns == docs.columns
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality.verdicts(docs, labels).collect() if r["kept"]}
            assert {r["doc_id"] for r in rows} == want and len(rows) == len(want)
        elif name == "toxicity":
            want = {r["doc_id"] for r in toxicity.scores(docs, labels).collect() if not r["predicted"]}
            assert {r["doc_id"] for r in rows} == want
        elif name == "simhash_near_dedup":
            # The stage's rule: five-word shingles, similarity 0.8.
            group = brute_components({d: r["text"] for d, r in before.items()})
            assert sorted(r["doc_id"] for r in rows) == sorted(set(group.values()))
        elif name == "suffix_array_dedup":
            ids = sorted(before)
            want = dict(zip(ids, brute_repeats([(before[d]["text"] or "").encode() for d in ids], 200)))
            for r in rows:
                assert r["text"] == want[r["doc_id"]].decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])
        else:
            source: dict = {}
            for d, r in before.items():
                ids = [*ids_of(r["text"], "word_bpe_49k.json"), 2]
                source.setdefault((d, len(ids)), []).append(ids)
            check_pieces(rows, source, 4096)
        docs = after
    again = corpus_pipeline.run(spark, data)
    assert again.columns == docs.columns and again.count() == docs.count()


def test_spans_merge():
    assert suffix_dedup.merged([(5, 9), (0, 3), (3, 4), (8, 12)]) == [(0, 4), (5, 12)]
    assert simhash.fingerprint_of("") == 0


CLASHING = "id h nth k1 k2 found _id _h _nth _k1 _k2 _found id_ fp n bits component_id rest bucket score kept predicted held_out toxic quality".split()


def test_pipeline_functions_keep_clashing_columns(spark):
    rows = [(i, "one text of some words " * (i % 3 + 12), *[7] * len(CLASHING)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHING))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    for found in (quality.keep_good(docs, labels), toxicity.drop_toxic(docs, labels), simhash.drop_near_duplicates(docs), near_copies.drop_near_copies(docs), suffix_dedup.without_repeats(docs)):
        assert found.columns == docs.columns
        assert all(r[c] == 7 for r in found.collect() for c in CLASHING)
    assert toxicity.drop_toxic(docs, labels).count() == 9


def test_smallest_hashes(spark):
    df = spark.range(1000).selectExpr("if(id < 900, 5, id) as k", "id")
    want = sorted((r["h"] % (1 << 20), r["h"], r["id"]) for r in df.selectExpr("xxhash64(k) as h", "id").collect())
    for rows in (0, 3, 500, 950, 5000):
        found = smallest_hashes(df, F.xxhash64("k"), rows, "id").collect()
        assert sorted(r["id"] for r in found) == sorted(i for _, _, i in want[:rows])

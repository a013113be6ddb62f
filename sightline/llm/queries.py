"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe_codec, conversations, embed_dedup, language_model, packing, phrases, quality, simhash, suffix_dedup, token_store, toxicity, warc, wrappers
from sightline.llm.common import table


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers are; their files stay outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(spark, paths).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_text(table(spark, sf_dir, "pages"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_store.read_tokens(written)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=2)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"), distance=2, width=3, seed=42)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), max_words=4, least=30, within=80, top=2000)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(table(spark, sf_dir, "documents"), order=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_warc, op2_html_extraction, op3_suffix_array_dedup, op4_token_store, op5_packing, op6_quality_rules, op7_toxicity,
        op8_embedding_near_dedup, op9_bpe_codec, op10_simhash_near_dedup, op11_conversation_repair,
        op12_phrase_collocations, op13_language_model,
    )}


#: The others fit models, hash in ways SQL lacks, or are too slow in SQL; tests hold them against brute force.
ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, url, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to, url FROM f
    """,
    "op8_embedding_near_dedup": """
        WITH RECURSIVE ok AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.v, links.b FROM reach JOIN links ON reach.r = links.a),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
        SELECT v AS vec_id, coalesce(any_value(n_links), 0) AS n_links, min(r) AS component_id, min(r) = v AS kept FROM reach LEFT JOIN n ON n.a = v GROUP BY v
    """,
    "op12_phrase_collocations": """
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
        g AS (SELECT lang, words, unnest(list_transform(range(1, len(ws) - words + 2), lambda i: array_to_string(ws[i : i + words - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS words)),
        f AS (SELECT lang, words, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, words, phrase),
        totals AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
        known AS (SELECT * FROM f WHERE f >= 30),
        cuts AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, words, unnest(range(1, words)) AS k FROM known WHERE words > 1),
        scored AS (SELECT c.*, h.f AS l, t.f AS r, 2000000 * c.a // (h.f + t.f) AS score FROM cuts c
            JOIN known h ON h.lang = c.lang AND h.phrase = array_to_string(c.ws[1 : c.k], ' ') JOIN known t ON t.lang = c.lang AND t.phrase = array_to_string(c.ws[c.k + 1 : c.words], ' ')),
        best AS (SELECT lang, phrase, words, a, l, r, score FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (SELECT lang, f, words, ' ' || phrase || ' ' AS around FROM known WHERE words > 2),
        open AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = b.lang AND x.words > b.words AND 100 * x.f >= 80 * b.a AND contains(x.around, ' ' || b.phrase || ' '))),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM open)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

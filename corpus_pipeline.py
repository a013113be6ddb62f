"""A corpus pipeline: quality rules, toxicity, near-duplicates, repeated substrings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import near_copies, packing, quality, suffix_dedup, toxicity
from sightline.llm.common import free_shuffles, new_folder, small_batches, table
from sightline.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _prepare(spark: SparkSession) -> None:
    small_batches(spark)
    free_shuffles(spark)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. A null text is rejected; other cases are those of quality.keep_good."""
    _prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. Cases are those of toxicity.drop_toxic."""
    _prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more.
    Cases are those of near_copies.drop_near_copies."""
    _prepare(spark)
    return near_copies.drop_near_copies(docs, similarity="0.8", width=5).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that are found twice go from every text; documents stay.
    Cases are those of suffix_dedup.without_repeats."""
    _prepare(spark)
    return suffix_dedup.without_repeats(docs, length=200).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens. Cases are those of packing.pack."""
    _prepare(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("packing", pack),
]

#: SQL can't express the fitted models, components and packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

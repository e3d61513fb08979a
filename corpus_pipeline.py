"""Five stages from raw documents to token ids; each reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tetrafield.llm import bpe, exact_dedup, mixing, near_dedup, queries, toxicity
from tetrafield.llm.common import Written, table

NEAR_PERCENT = 80  # op8's contract alone asks for 85


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below the threshold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~queries.held_out("doc_id"))
    clash = {c: f"_own_{c}" for c in docs.columns if c in toxicity.ADDED}
    scored = toxicity.score(spark, docs.withColumnsRenamed(clash), toxicity.fit(spark, docs, labels))
    return scored.filter(F.col("predicted") == 0).select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text."""
    return exact_dedup.deduplicate(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near-duplicates, linked from a similarity of NEAR_PERCENT on."""
    return near_dedup.deduplicate(spark, docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's budget asks for."""
    return mixing.take(spark, docs, mixing.document_levels())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of every document."""
    path = queries.tokenizer_path()
    coded = bpe.encode(docs, path, bpe.build_lexicon(spark, docs, path))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None  # classification, similarity joins and merges aren't SQL; tests hold run() against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Written(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = keep(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
